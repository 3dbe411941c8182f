import math

import pytest
from pyspark.sql import functions as F

from trackloom.operators import catalog, classify, compress, proximity, schedule, segments
from trackloom.sources import files, sinks

THRESHOLD = [(1, "17C", 32.9157, -97.026)]


def track(spark, rows, sign="AB12", icao="c0ffee"):
    """rows: (time, lat, lon, altitude)"""
    full = [(f"{sign}{icao}", sign, icao, t, a, b, h, 0.0, i) for i, (t, a, b, h) in enumerate(rows)]
    return spark.createDataFrame(full, "flight_id string, callsign string, icao24 string, time double, lat double, lon double, geoaltitude double, heading double, ordinal long")


def judged(spark, rows, radius=1000.0):
    split = segments.split_by_gap(track(spark, rows))
    every = split.select("source_flight", "segment", "flight_id", "callsign", "icao24").distinct()
    thresholds = spark.createDataFrame(THRESHOLD, "place_ord int, runway string, place_lat double, place_lon double")
    return classify.classify(segments.segment_rows(split), every, thresholds, radius)


def test_arrival_departure_and_both_in_one_flight(spark):
    inbound = [(60.0 * i, 33.11 - 0.04 * i, -97.026, 900.0 - 150 * i) for i in range(5)] + [(300.0, 32.9157, -97.026, 150.0)]
    outbound = [(0.0, 32.9157, -97.026, 100.0), (60.0, 32.9158, -97.026, 180.0)] + [(120.0 + 60 * i, 32.95 + 0.03 * i, -97.03, 400.0 + 200 * i) for i in range(4)]
    r = judged(spark, inbound).first()
    assert (r.classification, r.runway, r.event.time) == ("arrival", "17C", 300.0) and r.altitude_delta_m < 0 and r.distance_delta_m < 0
    r = judged(spark, outbound).first()
    assert (r.classification, r.event.time) == ("departure", 0.0) and r.altitude_delta_m > 0 and r.distance_delta_m > 0
    later = [(t + 5000, a, b, h) for t, a, b, h in inbound]
    both = judged(spark, outbound + later).orderBy("segment")
    assert [(r.flight_id, r.classification) for r in both.collect()] == [("AB12M1c0ffee", "departure"), ("AB12M2c0ffee", "arrival")]
    events = classify.events(both, "2030-01-02").orderBy("flight_id").collect()
    assert [e.operation for e in events] == ["departure", "arrival"] and len(events[0]) == 19 and events[0].event_time_utc == "1970-01-01T00:00:00Z"


def test_first_hit_counts_not_the_nearest(spark):
    r = judged(spark, [(0.0, 33.2, -97.2, 3500.0), (60.0, 32.953, -97.026, 2500.0), (120.0, 32.93, -97.026, 1400.0), (180.0, 32.916, -97.026, None)], 5000.0).first()
    assert (r.classification, r.event.time) == ("arrival", 60.0) and r.distance_delta_m < 0


def test_overflight_unclassified_and_empty(spark):
    high = [(60.0 * i, 32.95 - 0.01 * i, -97.026, 6000.0) for i in range(4)]
    assert judged(spark, high, 5000.0).first().classification == "overflight"
    still = [(60.0 * i, 32.9157, -97.026, 100.0) for i in range(3)]
    assert judged(spark, still, 5000.0).first().classification == "unclassified"
    assert judged(spark, [(0.0, None, None, 100.0)]).first().classification == "unclassified"
    assert judged(spark, []).count() == 0


def test_gap_must_be_longer_and_nulls_do_not_split(spark):
    rows = segments.split_by_gap(track(spark, [(0.0, 1.0, 1.0, 1.0), (1500.0, 1.0, 1.0, 1.0), (3000.5, 1.0, 1.0, 1.0), (None, 1.0, 1.0, 1.0)])).orderBy("ordinal").collect()
    assert [r.segment for r in rows] == [1, 1, 2, 2] and rows[0].flight_id == "AB12M1c0ffee" and rows[2].callsign == "AB12M2"


def test_blank_callsign_is_unknown_until_split(spark):
    from trackloom.functions import scalars

    r = spark.range(1).select(scalars.flight_id(scalars.callsign(F.lit("  ")), F.lit("abc")).alias("a"), scalars.segment_id(F.lit(""), F.lit(1), F.lit("abc")).alias("b")).first()
    assert (r.a, r.b) == ("UNKNOWN_abc", "M1abc")


def test_last_of_repeated_seconds_stays(spark):
    rows = segments.keep_last(track(spark, [(10.0, 1.0, 1.0, 1.0), (10.0, 2.0, 1.0, 1.0), (11.0, 1.0, None, 1.0), (12.0, 1.0, 1.0, None)])).collect()
    assert [(r.time, r.lat) for r in rows] == [(10, 2.0)]


def test_fix_sequence_resets_away_from_fixes(spark):
    fixes = spark.createDataFrame([("ONE", 1, 10.0, 10.0), ("TWO", 2, 10.5, 10.0)], "identifier string, place_ord int, place_lat double, place_lon double")
    rows = [(0.0, 10.0, 10.0, 1.0), (1.0, 10.0001, 10.0, 1.0), (2.0, 10.2, 10.0, 1.0), (3.0, 10.0, 10.0, 1.0), (4.0, 10.5, 10.0, 1.0)]
    r = proximity.fix_sequences(segments.segment_rows(segments.split_by_gap(track(spark, rows))), fixes).first()
    assert (r.fix_sequence, r.fix_count, r.first_time, r.last_time) == ("ONE>ONE>TWO", 3, 0.0, 4.0)
    away = proximity.fix_sequences(segments.segment_rows(segments.split_by_gap(track(spark, [(0.0, 50.0, 50.0, 1.0)]))), fixes).first()
    assert (away.fix_sequence, away.fix_count) == ("", 0)


@pytest.mark.parametrize("lat0", [0.0, 45.0, -70.0])
def test_grid_join_finds_all_near_pairs(spark, lat0):
    import random

    rng = random.Random(int(lat0))
    points = [(i, lat0 + rng.uniform(-0.2, 0.2), rng.uniform(-0.3, 0.3)) for i in range(120)]
    places = [(i, lat0 + rng.uniform(-0.2, 0.2), rng.uniform(-0.3, 0.3)) for i in range(40)]
    found = proximity.near(spark.createDataFrame(points, "p int, lat double, lon double"), spark.createDataFrame(places, "place_ord int, place_lat double, place_lon double"), 6000.0)

    def distance(a, b, c, d):
        a, b, c, d = map(math.radians, (a, b, c, d))
        h = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
        return 6_371_000.0 * 2 * math.asin(math.sqrt(h))

    plain = {(i, j) for i, a, b in points for j, c, d in places if round(distance(a, b, c, d), 3) <= 6000.0}
    assert {(r.p, r.place_ord) for r in found.collect()} == plain and plain


def test_seed_state(spark):
    t = track(spark, [(0.0, 0.0, 0.0, 1.0), (10.0, 0.0, 0.01, 1.0), (20.0, 0.0, 0.02, 1.0)])
    wanted = lambda x: t.select("flight_id").distinct().withColumn("first_time", F.lit(x))
    speed = 6_371_000.0 * math.radians(0.01) / 10
    assert segments.seeds(t, wanted(0.0)).first().ground_speed_mps == pytest.approx(speed)
    assert segments.seeds(t, wanted(20.0)).first().ground_speed_mps == pytest.approx(speed)
    assert segments.seeds(t, wanted(5.0)).count() == 0
    assert segments.seeds(track(spark, [(0.0, 0.0, 0.0, 1.0)]), wanted(0.0)).count() == 0


def test_bounds(spark):
    t = track(spark, [(5.0, 0.0, 0.0, 1.0), (9.0, 0.0, 0.0, 1.0)])
    segments.check_bounds(t, 5, 9)
    for a, b in ((6, 9), (5, 8)):
        with pytest.raises(ValueError):
            segments.check_bounds(t, a, b)
    with pytest.raises(ValueError):
        segments.check_bounds(t.limit(0), 0, 1)


def test_breakpoints():
    import numpy as np

    assert compress.spatial_breakpoints(np.array([0.0, 1, 2]), np.array([0.0, 9, 0]), 1.0).tolist() == [True] * 3
    assert compress.spatial_breakpoints(np.array([0.0, 1, 2]), np.array([0.0, 1, 0]), 1.0).tolist() == [True, False, True]  # not above
    assert compress.series_breakpoints(np.array([0.0, 10, 20]), np.array([0.0, 90, 0]), 10.0).tolist() == [True] * 3
    assert compress.series_breakpoints(np.array([5.0, 5, 5]), np.array([0.0, 90, 0]), 10.0).tolist() == [True] * 3
    # Distance is to the endless line: a point beyond the span's end lies on it.
    assert compress.spatial_breakpoints(np.array([0.0, 5, 2]), np.array([0.0, 0, 0]), 1.0).tolist() == [True, False, True]
    assert compress.spatial_breakpoints(np.array([0.0, 5, 0]), np.array([0.0, 0, 0]), 1.0).tolist() == [True] * 3
    assert compress.breakpoints(0, lambda a, b: None, 1.0).tolist() == []


def test_compression_marks_and_manifest(spark):
    t = track(spark, [(0.0, 32.0, -97.0, 0.0), (10.0, 32.0, -96.99, 0.0), (20.0, 32.01, -96.99, 500.0), (30.0, 32.02, -96.99, 0.0)])
    kept = compress.compress(t, 10.0, 10.0)
    masks = {r.time: r.mask for r in kept.collect()}
    assert masks[0] == masks[30] == 3 and masks[20] & 2 and masks[10] & 1
    flights = compress.compressed_flights(t, kept, 10.0, 10.0)
    r = sinks.flight_manifest(flights).first()
    assert (r.raw_point_count, r.compressed_point_count, r.compression_ratio) == (4, len(masks), f"{len(masks) / 4:.6f}")
    m = sinks.run_metadata(flights, 10.0, 10.0).first()
    assert m.flight_count == 1 and m.raw_point_count == 4
    assert sinks.run_metadata(flights.limit(0), 10.0, 10.0).first().compression_ratio == 0.0


def test_hourly_files(spark, tmp_path):
    (tmp_path / "day").mkdir()
    line = "1700000000,abc123,32.5,-97.1,180.0,AB12  ,900.5\n"
    for name, text in (("1700000000.csv", line + "x,abc123, ,-97.1,,,NaN\n"), ("._1700000000.csv", line), ("notes.csv", line), ("1700003600.txt", line), ("12a.csv", line), ("day/1700007200.csv", line)):
        (tmp_path / name).write_text(text)
    rows = files.tracks(spark, str(tmp_path)).orderBy("time").collect()
    assert len(rows) == 2 and rows[1].flight_id == "AB12abc123" and rows[1].geoaltitude == 900.5
    assert (rows[0].time, rows[0].lat, rows[0].geoaltitude, rows[0].flight_id) == (None, None, None, "UNKNOWN_abc123")
    assert files.tracks(spark, str(tmp_path), recursive=True).count() == 3
    (tmp_path / "none").mkdir()
    with pytest.raises(FileNotFoundError):
        files.require_tracks(files.tracks(spark, str(tmp_path / "none")))


def test_tables_from_files(spark, tmp_path):
    p = tmp_path / "r.csv"
    p.write_text("runway_pair,length_ft,latitude_a,longitude_a,latitude_b,longitude_b\n13L/31R,9000,32.9,-97.02,32.8,-97.0\n")
    rows = files.runway_thresholds(files.table(spark, str(p), ["runway_pair"])).orderBy("place_ord").collect()
    assert [(r.runway, r.place_lat, r.place_lon) for r in rows] == [("13L", 32.9, -97.02), ("31R", 32.8, -97.0)]
    with pytest.raises(ValueError, match="a_column, z_column"):
        files.table(spark, str(p), ["z_column", "a_column", "runway_pair"])
    for text in ("flight_type,callsign,icao24,event_time\narrival,A,b,5\n", "arrival,A,b,5\n"):
        p.write_text(text)
        assert [tuple(r) for r in files.authoritative_catalog(spark, str(p)).collect()] == [("arrival", "A", "b", "5")]
    p.write_text("flight_type,callsign,icao24\narrival,A,b\n")
    assert [tuple(r) for r in files.authoritative_catalog(spark, str(p)).collect()] == [("arrival", "A", "b", None)]
    rows = spark.createDataFrame([("aa", "Waypoint", "1", "2"), ("bb", "vor", "1", None), ("cc", "ndb", "1", "2")], "identifier string, fix_type string, latitude_deg string, longitude_deg string")
    assert [r.identifier for r in files.fixes(rows).collect()] == ["aa"]


def serving_files(spark, folder):
    import json

    events = [("DEP2", "departure", "17R", 200), ("ARR1", "Arrival", "35C", 500), ("DEP1", "departure", "18L", 100), ("ARR2", "arrival", "36L", 600)]
    header = ",".join(files.EVENT_COLUMNS)
    (folder / "e.csv").write_text(header + "\n" + "".join(f"d,{i},C{i},x, {o} ,{r},{t},z\n" for i, o, r, t in events))
    (folder / "s.csv").write_text(",".join(files.SEQUENCE_COLUMNS) + "\nd,ARR1,c,x,300,500,FIXA>FIXB,2\nd,ARR2,c,x,250,600,,0\n")
    flight = {"flight_id": "ARR1", "callsign": "CARR1", "icao24": "x", "columns": ["time"], "points": [[300, 32.0, -97.0, 1000.0, 3]], "first_time": 300}
    (folder / "f.jsonl").write_text(json.dumps(flight | {"first_time": 1}) + "\n\n" + json.dumps(flight) + "\n")
    return files.events(spark, str(folder / "e.csv")), files.fix_sequences(spark, str(folder / "s.csv")), files.compressed_flights(spark, str(folder / "f.jsonl"))


def test_schedules_and_health(spark, tmp_path):
    events, sequences, flights = serving_files(spark, tmp_path)
    assert [(r.flight_id, r.departure_time) for r in schedule.departures(events).collect()] == [("DEP1", 100), ("DEP2", 200)]
    (r,) = schedule.arrivals(events, sequences, flights).collect()
    assert (r.flight_id, r.arrival_time, r.arrival_time_utc, r.runway, r.original_fix_sequence, r.original_fix_count) == ("ARR1", 300, "1970-01-01T00:05:00Z", "35C", "FIXA>FIXB", 2)
    assert r.points == [[300.0, 32.0, -97.0, 1000.0, 3.0]]
    h = schedule.health(events, sequences, flights).first()
    assert (h.events_count, h.arrivals_count, h.departures_count, h.compressed_flights_count) == (4, 2, 2, 1)
    assert (h.arrivals_missing_fix_sequences_count, h.arrivals_missing_trajectories_count, h.departures_missing_trajectories_count) == (0, 1, 2)
    assert schedule.intervention_diff(spark).count() == 0
    assert schedule.apply_diff(flights, schedule.intervention_diff(spark)).first().callsign == "CARR1"
    patch = spark.createDataFrame([("ARR1", "callsign", "CARR1", "NEW")], "flight_id string, field string, before string, after string")
    assert schedule.apply_diff(flights, patch).first().callsign == "NEW"


def test_strict_readers_raise(spark, tmp_path):
    (tmp_path / "e.csv").write_text(",".join(files.EVENT_COLUMNS) + "\nd,a,b,c,arrival,r,soon,z\n")
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        files.events(spark, str(tmp_path / "e.csv")).collect()
    (tmp_path / "s.csv").write_text(",".join(files.SEQUENCE_COLUMNS) + "\nd,a,b,c,,5,x,1\n")
    with pytest.raises(Exception, match="first_time is missing"):
        files.fix_sequences(spark, str(tmp_path / "s.csv")).collect()
    (tmp_path / "f.jsonl").write_text('{"callsign": "x"}\n')
    with pytest.raises(Exception, match="no flight_id"):
        files.compressed_flights(spark, str(tmp_path / "f.jsonl")).collect()
    with pytest.raises(Exception, match="is NaN"):
        sinks.json_lines(spark.createDataFrame([(float("nan"),)], "x double"), str(tmp_path / "out"))


def test_manifests(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"iap": [{"ILS": "https://x.y/a/b%20c.pdf?z=1"}], "star": [{"ONE": "https://x.y/one.pdf"}, {"TWO": "https://x.y/two.pdf"}]}')
    rows = files.chart_entries(spark, str(tmp_path / "m.json")).orderBy("section_no", "place").collect()
    assert [(r.section, r.label, r.file_name) for r in rows] == [("star", "ONE", "one.pdf"), ("star", "TWO", "two.pdf"), ("iap", "ILS", "b c.pdf")]
    assert files.json_object(spark, str(tmp_path / "m.json"))["star"][0] == {"ONE": "https://x.y/one.pdf"}
    (tmp_path / "l.json").write_text("[1]")
    with pytest.raises(ValueError):
        files.json_object(spark, str(tmp_path / "l.json"))
    (tmp_path / "a.PDF").write_bytes(b"1")
    (tmp_path / "b.pdf").write_bytes(b"1")
    assert files.pdf_files(spark, str(tmp_path)).count() == 2


def test_catalog_difference(spark):
    derived = spark.createDataFrame([("arrival", "AB1M2", "ABC"), ("departure", "X1M1", "d")], "operation string, callsign string, icao24 string")
    other = spark.createDataFrame([("arrival", "AB1", "abc"), ("arrival", "Q9", "e")], "flight_type string, callsign string, icao24 string")
    found = {r.side: (r["keys"], r.examples) for r in catalog.difference(derived, other).collect()}
    assert found == {"shared": (1, ""), "derived only": (1, "departure|X1|d"), "authoritative only": (1, "arrival|Q9|e")}


def test_catalog_range_is_inclusive(spark):
    rows = spark.createDataFrame([("arrival", "A", "a", "10"), ("arrival", "B", "b", "20"), ("arrival", "C", "c", "21"), ("arrival", "D", "d", "x"), ("arrival", "E", "e", None)], "flight_type string, callsign string, icao24 string, event_time string")
    assert sorted(r.callsign for r in catalog.pruned(rows, 10, 20).collect()) == ["A", "B"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("d1", 1.5), ("d2", 2.5)], "date string, x double")
    sinks.csv(df, str(tmp_path / "c"), ["date"])
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 2
    sinks.json_lines(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


def test_nan_is_refused_at_any_depth(spark, tmp_path):
    nan = float("nan")
    for row, kind in (([[[1.0, nan]]], "x array<array<double>>"), ([[(1, nan)]], "x array<struct<a: int, b: double>>"), ([{"a": nan}], "x map<string,double>"), ([((nan,),)], "x struct<a: struct<b: double>>")):
        with pytest.raises(Exception, match="x is NaN"):
            sinks.json_lines(spark.createDataFrame([tuple(row)], kind), str(tmp_path / "bad"))
    good = spark.createDataFrame([([[1.0], None], {"a": None}, None)], "x array<array<double>>, y map<string,double>, z struct<a: double>")
    sinks.json_lines(good, str(tmp_path / "good"))
    assert spark.read.json(str(tmp_path / "good")).count() == 1


def test_pdf_suffix_in_any_case_and_skipped_rows(spark, tmp_path):
    for name in ("a.pdf", "b.pDf", "c.PDF", "d.txt", "pdf"):
        (tmp_path / name).write_bytes(b"x")
    assert [r.path[-5:] for r in files.pdf_files(spark, str(tmp_path)).collect()] == ["a.pdf", "b.pDf", "c.PDF"]
    row = schedule.skipped(spark.createDataFrame([("f", "c", 1)], "flight_id string, callsign string, icao24 int"), "no track").first()
    assert (row.icao24, row.first_time, row.raw_point_count, row.status, row.reason) == ("1", None, 0, "skipped", "no track")


def test_the_last_row_of_the_last_file_counts(spark, tmp_path):
    """A larger file is dealt out first, whatever its name."""
    head = "identifier,latitude_deg,longitude_deg,elevation_ft\n"
    (tmp_path / "a.csv").write_text(head + "x,1,1,\n" * 500 + "x,2,2,\n")
    (tmp_path / "b.csv").write_text(head + "x,3,3,\n")
    rows = files.fix_catalog(files.table(spark, str(tmp_path), ["identifier"])).collect()
    assert [(r.identifier, r.latitude_deg) for r in rows] == [("X", 3.0)]


def test_nearest_of_many_places_sorts_no_pairs(spark):
    places = spark.createDataFrame([(k, f"P{k}", 32.0 + (k % 5) * 0.001, -97.0) for k in range(200)] + [(7, "Q", 32.0, -97.0005)], "place_ord long, identifier string, place_lat double, place_lon double")
    points = spark.createDataFrame([("a", k, 32.0 + (k % 9) * 0.0005, -97.0) for k in range(90)] + [("b", 0, 50.0, 50.0)], "f string, rn int, lat double, lon double")
    near = proximity.near(points, places, 2000.0).collect()
    want = {}
    for r in near:
        want[r.f, r.rn] = min(want.get((r.f, r.rn), (9e9, 0, "")), (r.distance_m, r.place_ord, r.identifier))
    found = proximity.nearest(points, ["f", "rn"], places, 2000.0)
    assert {(r.f, r.rn): (r.distance_m, r.identifier) for r in found.collect()} == {k: (v[0], v[2]) for k, v in want.items()} and len(want) == 90
    assert "Window" not in found._jdf.queryExecution().toString()
