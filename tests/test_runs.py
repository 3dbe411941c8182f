from trackloom.operators import segments
from trackloom.plans import runs
from trackloom.sources import files


def test_catalog_and_compression_from_files(spark, tmp_path):
    day = tmp_path / "2030-01-02"
    day.mkdir()
    points = [(60 * i, 33.11 - 0.04 * i, -97.026, 900 - 150 * i) for i in range(5)] + [(300, 32.9157, -97.026, 150)]
    lines = [f"{t},abc,{a},{b},0,AB1 ,{h}\n" for t, a, b, h in points]
    (day / "0.csv").write_text("".join(lines[:3]))
    (day / "3600.csv").write_text("".join(lines[3:]) + "9,zzz,,,0, ,5\n")
    (tmp_path / "runways.csv").write_text("runway_pair,latitude_a,longitude_a,latitude_b,longitude_b\n17C/35C,32.9157,-97.026,32.8,-97.026\n")
    (tmp_path / "fixes.csv").write_text("identifier,fix_type,latitude_deg,longitude_deg\nONE,waypoint,33.11,-97.026\nTWO,vor,32.99,-97.026\nNDB,ndb,33.07,-97.026\n")
    (tmp_path / "other.csv").write_text("arrival,AB1,ABC,5\n")
    made = runs.build_catalog(spark, str(day), str(tmp_path / "runways.csv"), str(tmp_path / "fixes.csv"), str(tmp_path / "out"), authoritative_csv=str(tmp_path / "other.csv"), radius_m=1000.0)
    assert {r.classification: r.segments for r in made.counts.collect()} == {"arrival": 1, "unclassified": 1}
    (event,) = spark.read.option("header", True).csv(str(tmp_path / "out/2030-01-02_landings_and_departures")).collect()
    assert (event.flight_id, event.runway, event.event_time, event.date) == ("AB1M1abc", "17C", "300", "2030-01-02")
    sequences = made.sequences.collect()
    assert [(r.flight_id, r.fix_sequence, r.fix_count, r.first_time) for r in sequences] == [("AB1M1abc", "ONE>TWO", 2, 0), ("M1zzz", "", 0, None)]
    assert spark.read.option("header", True).csv(str(tmp_path / "out/2030-01-02_differences")).first().side == "shared"

    flights = runs.compress_folder(spark, str(tmp_path), str(tmp_path / "small"))
    (f,) = flights.collect()
    assert (f.flight_id, f.raw_point_count, f.points[0].time, f.points[-1].time) == ("AB1M1abc", 6, 0, 300)
    assert spark.read.json(str(tmp_path / "small/metadata")).first().flight_count == 1
    (tmp_path / "ops.csv").write_text("flight_id,operation\nAB1M1abc,overflight\n")
    assert runs.compress_folder(spark, str(tmp_path), str(tmp_path / "none"), catalog_csv=str(tmp_path / "ops.csv")).count() == 0

    tracks = files.tracks(spark, str(day))
    assert segments.flight_track(tracks, "AB1", "ABC", segment=1).count() == 6
    assert segments.first_rows(tracks, 2).count() == 2


def test_procedures_from_a_file(spark, tmp_path):
    from tests.test_procedures import LINES, leg

    more = [leg("PE", "KTWO", "FAR", "ALL", 10, "ALPHA"), leg("PE", "KTWO", "FAR", "ALL", 20, "CHARL"), leg("PE", "KTWO", "FAR", "ALL", 30, "NOPE")]
    (tmp_path / "records.txt").write_text("\n".join(LINES + more) + "\n")
    legs, fixes = runs.extract_procedures(spark, str(tmp_path / "records.txt"), "KONE", str(tmp_path / "out"))
    rows = [(r.sid_star_approach_identifier, r.sequence_number, r.fix_identifier) for r in legs.collect()]
    assert rows == [("STAR1", "010", "CHARL"), ("SID1", "010", "ALPHA"), ("APP1", "020", "BRAVO"), ("APP1", "030", None), ("FAR", "010", "ALPHA"), ("FAR", "020", "CHARL")]
    assert fixes.count() == 5
    assert spark.read.text(str(tmp_path / "out/report")).first().value == "KONE filter_hits: 8"
