import math

import pytest
from pyspark.sql import functions as F

from trackloom.functions import flight, geo, interp, scalars
from trackloom.operators import nav, profiles, proximity, routes, verify
from trackloom.sources import remote, sinks


def point(section, airport, ident, lat="N32300000", lon="W097300000", elevation=""):
    head = f"SUSA{section[0]}{section[1:] if section[0] != 'P' and len(section) > 1 else ' '}{airport:<4}{'K4' if section[0] == 'P' else '  '}{section[1] if section[0] == 'P' else ' '}{ident:<6}"
    return f"{head:<32}{lat}{lon}{'':<15}{elevation:<5}{'':<40}"


def leg(section, airport, name, transition, sequence, fix, altitude="", altitude2=""):
    head = f"SUSAP {airport:<4}K4{section[1]}{name:<6}4{transition:<5} {sequence:03d}{fix:<5}K4PC0"
    return f"{head:<84}{altitude:<5}{altitude2:<5}{'':<20}"


LINES = [
    point("PC", "KONE", "ALPHA", "N33533935", "W098402606"),
    point("PC", "KTWO", "BRAVO"),
    point("EA", "ENRT", "CHARL", "S32164632", "E099530109"),
    point("D", "", "DLT"),
    point("PG", "KONE", "RW17C", elevation="00562"),
    point("PC", "KONE", "ALPHA", "N33000000", "W098000000"),
    point("EA", "ENRT", "CHARL", "N01000000", "W001000000"),
    leg("PE", "KONE", "STAR1", "CHARL", 10, "CHARL"),
    leg("PD", "KONE", "SID1", "DLT", 10, "ALPHA"),
    leg("PF", "KONE", "APP1", "RW17C", 20, "BRAVO"),
    leg("PF", "KONE", "APP1", "RW35C", 30, ""),
    leg("PE", "KTWO", "OTHER", "ALPHA", 10, "ALPHA"),
    "SUSAP KONE short",
]


def parsed(spark):
    return nav.parse(spark.createDataFrame(list(enumerate(LINES)), "line_no long, line string"))


def test_extraction(spark):
    p = parsed(spark)
    legs = nav.legs(p, "KONE")
    assert [r.sid_star_approach_identifier for r in legs.orderBy("line_no").collect()] == ["STAR1", "SID1", "APP1", "APP1"]
    found = nav.resolve(nav.reference_tokens(legs), p, "KONE")
    by = {r.token: r for r in found.collect()}
    assert set(by) == {"CHARL", "DLT", "ALPHA", "RW17C", "BRAVO", "RW35C"}
    assert by["CHARL"].uses == 1 and by["RW35C"].fix_type is None
    assert (by["ALPHA"].fix_type, by["ALPHA"].latitude_deg, by["ALPHA"].airport_icao) == ("waypoint", 33.0, "KONE")  # the last record
    assert by["CHARL"].latitude_deg == pytest.approx(-(32 + 16 / 60 + 46.32 / 3600)) and by["CHARL"].longitude_deg == pytest.approx(99 + 53 / 60 + 1.09 / 3600)  # the first
    assert (by["BRAVO"].airport_icao, by["DLT"].fix_type, by["RW17C"].elevation_ft) == ("KTWO", "vor", 562)
    s = nav.summary(p, legs, found, "SUSAP KONE*").first()
    assert (s.filter_hits, s.legs, s.fixes_added, s.unresolved_references, s.unresolved_identifiers, s.parse_failures, s.duplicates) == (8, 4, 5, 1, 1, 1, 0)
    lost = nav.failures(found, p, "KONE")
    assert [(r.token, r.kind, r.reason) for r in lost.collect()] == [("RW35C", "runway", "no record")]
    report = [r.line for r in sinks.extraction_report(lost, nav.summary(p, legs, found, "SUSAP KONE*"), "KONE").collect()]
    assert report[0] == "KONE filter_hits: 8" and report[-1].startswith("KONE RW35C | runway | 1")


def rows(spark, items):
    """(line, procedure, sequence, fix)"""
    return spark.createDataFrame([(n, "PD", p, "4", "T", s, f) for n, p, s, f in items], "line_no long, section_code string, sid_star_approach_identifier string, route_type string, transition_identifier string, sequence_number string, fix_identifier string")


def test_links_and_runs(spark):
    r = rows(spark, [(1, "A", "020", "Y"), (2, "A", "010", "X"), (3, "A", "030", None), (4, "A", "040", "Z"), (5, "A", "050", "W"), (6, "B", "x", "Q"), (7, "B", "001", "R")])
    assert {(x.from_fix, x.to_fix) for x in nav.links(r).collect()} == {("X", "Y"), ("Z", "W"), ("Q", "R")}
    scope = spark.createDataFrame([("X",), ("Y",), ("W",), ("R",)], "identifier string")
    runs = nav.scoped_runs(r, scope, nav.GROUP).orderBy("place").collect()
    assert [(x.fix_identifier, x.sequence_number) for x in runs] == [("X", "010"), ("Y", "020")]


def test_supplement_equals_the_sequential_pass(spark):
    import random

    rng = random.Random(4)
    items, n = [], 0
    for p in range(30):
        for s in range(rng.randint(2, 6)):
            n += 1
            items.append((n, f"P{p:02d}", f"{s:03d}", f"F{rng.randrange(8)}"))
    r = rows(spark, items)
    scope = spark.createDataFrame([(f"F{i}",) for i in range(6)], "identifier string")
    base = spark.createDataFrame([("F1", "F2"), ("F3", "F0")], "from_fix string, to_fix string")
    found = {x.run.group_line * 100 + x.run.outside: x.new_links for x in nav.supplement(nav.scoped_runs(r, scope, nav.GROUP), base).collect()}
    seen, plain = {("F1", "F2"), ("F3", "F0")}, {}
    for p in range(30):
        own = [i for i in items if i[1] == f"P{p:02d}"]
        run, outside, runs = [], 0, []
        for i in own:
            if i[3] in ("F6", "F7"):
                runs.append((outside, run))
                run, outside = [], outside + 1
            else:
                run.append(i[3])
        runs.append((outside, run))
        for k, fixes in runs:
            links = set(zip(fixes, fixes[1:]))
            if links - seen:
                plain[own[0][0] * 100 + k] = len(links - seen)
                seen |= links
    assert found == plain


def one(spark, *columns):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(columns))).first()


def test_scalars(spark):
    lit = F.lit
    r = one(spark, scalars.altitude_ft(lit("FL260")), scalars.altitude_ft(lit(" 08000")), scalars.altitude_ft(lit("")), scalars.latitude(lit("S32")), scalars.longitude(lit("W0970130xx")), scalars.elevation_ft(lit(" -012ft")), scalars.elevation_ft(lit("x")))
    assert tuple(r) == (26000.0, 8000.0, None, None, None, -12, None)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        one(spark, scalars.altitude_ft(lit("high")))
    r = one(spark, scalars.route_tokens(lit("a> b>>NaN"), lit("17c")), scalars.route_tokens(lit(None).cast("string"), lit("9")), scalars.path_tokens(lit(" A  B\tC ")), scalars.coordinate_token(lit("32.5/-97"), lit(3)), scalars.coordinate_token(lit("ALPHA"), lit(3)))
    assert r.c0 == ["A", "B", "RW17C"] and r.c1 == ["RW9"] and r.c2 == ["A", "B", "C"] and tuple(r.c3) == ("COORD03", 32.5, -97.0) and r.c4 is None
    r = one(spark, scalars.quoted_printable(lit("a=\nb=3Dc=20d=")), scalars.anchors(lit('<p><a class="x" href="u?a=1">One <b>two</b>&amp;&nbsp;</a><A HREF=\'v\' x>3</A>')), scalars.local_clock(lit(0)), scalars.range_label(lit("2025-01-01").cast("timestamp"), lit("2025-01-02").cast("timestamp"), lit("KX")), scalars.day_start(lit("1970-01-02 05:00:00").cast("timestamp")))
    assert r.c0 == "ab=c d=" and [tuple(x) for x in r.c1] == [("u?a=1", "One two &"), ("v", "3")] and r.c2 == "18:00:00" and r.c3 == "2025-01-01_to_2025-01-02_kx" and r.c4 == 86400
    assert tuple(one(spark, scalars.segment_mark(lit("AB1m1")), scalars.segment_mark(lit("AB1"))).c0) == ("AB1", "M1")


def test_geometry(spark):
    lit = F.lit
    r = one(spark, geo.haversine_m(lit(0.0), lit(0.0), lit(0.0), lit(1.0)), geo.equirectangular_m(lit(0.0), lit(0.0), lit(1.0), lit(0.0)), geo.wrap_rad(lit(3 * math.pi + 0.1)), geo.heading_to_math_rad(lit(90.0)), geo.latitude_of(geo.local_north_m(lit(33.0), lit(32.0)), lit(32.0)), geo.longitude_of(geo.local_east_m(lit(32.0), lit(-96.0), lit(-97.0)), lit(32.0), lit(-97.0)))
    degree = 6_371_000.0 * math.pi / 180
    assert list(r) == pytest.approx([degree, degree, 0.1 - math.pi, 0.0, 33.0, -96.0])
    box = one(spark, geo.extent(lit(89.9), lit(0.0), lit(1113.2))).c0
    assert (box.north - 89.9, box.east) == pytest.approx((0.01, 0.05))


def test_interpolation(spark):
    x, y = F.array(*(F.lit(v) for v in (0.0, 10.0, 20.0))), F.array(*(F.lit(v) for v in (0.0, 10.0, 30.0)))
    at = (-5.0, 0.0, 5.0, 10.0, 15.0, 99.0)
    assert list(one(spark, *(interp.value_at(x, y, F.lit(v)) for v in at))) == [0.0, 0.0, 5.0, 10.0, 20.0, 30.0]
    assert list(one(spark, *(interp.slope_at(x, y, F.lit(v)) for v in at))) == [1.0, 1.0, 1.0, 1.0, 2.0, 2.0]
    assert one(spark, interp.between(F.lit(1.0), F.lit(7.0), F.lit(1.0), F.lit(9.0), F.lit(1.0))).c0 == 7.0


def test_profiles_share_a_grid(spark):
    curves = {"hl": [(0, 450), (15000, 1400), (40000, 3000)], "hu": [(0, 500), (10000, 1300), (40000, 3150)], "vl": [(0, 68), (8000, 70), (40000, 82)]}
    nodes = spark.createDataFrame([(1, c, float(s), float(y)) for c, ps in curves.items() for s, y in ps], "k int, curve string, s double, y double")
    found = {(r.curve, r.s): r.value for r in profiles.on_merged_grid(nodes, "k", "curve").collect()}
    assert len(found) == 15 and found["hl", 8000.0] == pytest.approx(956.6666666666666) and found["hu", 8000.0] == pytest.approx(1140.0)
    rising = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (2, 0, 1.0), (2, 1, 1.0)], "k int, idx int, s double")
    assert {r.k: r.increasing for r in profiles.strictly_increasing(rising, "k").collect()} == {1: True, 2: False}


def test_altitude_constraints(spark):
    legs = nav.legs(nav.parse(spark.createDataFrame([(1, leg("PE", "KONE", "STAR1", "ALL", 10, "AAA", "FL120", "09000")), (2, leg("PE", "KONE", "STAR1", "ALL", 20, "BBB", "08000")), (3, leg("PE", "KONE", "STAR1", "ALL", 30, "CCC"))], "line_no long, line string")), "KONE")
    assert sorted(map(tuple, profiles.constraints_by_fix(legs, "star1", "all").collect())) == [("AAA", 9000.0, 12000.0), ("BBB", 8000.0, 8000.0)]


def test_flight_mechanics(spark):
    lit = F.lit
    r = one(spark, flight.density(lit(0.0), lit(0.0)), flight.cas_of(flight.tas_of(lit(120.0), lit(5000.0), lit(10.0)), lit(5000.0), lit(10.0)), flight.stall_bank_limit(lit(60.0), lit(0.0)), flight.stall_bank_limit(lit(60.0), lit(78.0)), flight.cas_ceiling(lit(None).cast("double")), flight.target_cas(lit("clean"), lit(150.0), lit(90.0), lit(70.0), lit(3000.0)), flight.cubic_height(lit(0.0), lit(10.0), lit(3.0), lit(7.0), lit(0.1), lit(0.2)), flight.cubic_height(lit(10.0), lit(10.0), lit(3.0), lit(7.0), lit(0.1), lit(0.2)), flight.cubic_slope(lit(10.0), lit(10.0), lit(3.0), lit(7.0), lit(0.1), lit(0.2)), flight.top_of_descent_guess(lit(100.0), lit(0.0), lit(1e6)))
    assert list(r) == pytest.approx([1.225, 120.0, 0.0, 0.0, math.inf, 250 * 0.514444, 3.0, 7.0, 0.2, 100 / math.tan(math.radians(3))], rel=1e-4)


def test_defects_vanish_on_a_straight_glide(spark):
    """A constant flight path angle at constant speed, thrust balancing drag and weight, has no defects."""
    nodes = spark.createDataFrame([(1, i, 1000.0 * i, -math.tan(-0.05) * 1000.0 * i, 80.0, 12.5 * i, -0.05, 0.0) for i in range(5)], "plan_id int, idx int, s double, h double, v double, t double, gamma double, thrust double")
    rated = verify.rates(nodes, 6e4, 120.0, 0.02, 0.04).withColumn("dv_ds", F.lit(0.0))
    worst = {r.state: r.worst for r in verify.worst_defects(verify.defects(rated)).collect()}
    assert worst["h"] < 1e-9 and worst["t"] < 1e-9 and worst["v"] < 1e-9
    m = nodes.withColumns({"h_lower": F.lit(-1.0), "h_upper": F.lit(150.0), "v_lower": F.lit(70.0), "v_upper": F.lit(90.0)})
    found = {r.family: (r.holds, r.at_s) for r in verify.margins(m).collect()}
    assert found["h below upper"] == (False, 4000.0) and found["time order"][0] and len(found) == 5
    assert verify.around(nodes, spark.createDataFrame([(1, 2)], "plan_id int, centre_idx int"), 1).count() == 3
    metrics = spark.createDataFrame([(True, 0.0, 0.0, 1.0), (True, 0.0, None, 1.0), (True, 0.0, 0.0, 501.0)], "success boolean, max_slack double, max_defect double, replay_error double")
    assert [r.usable for r in verify.usable(metrics).collect()] == [True, False, False]


def test_polar_fit_recovers_a_polar(spark):
    rows = spark.createDataFrame([("clean", c / 10, 0.02 + 0.045 * (c / 10) ** 2) for c in range(1, 12)], "mode string, cl double, cd double")
    r = verify.polar_fit(rows, ["mode"]).first()
    assert (r.cd0, r.k) == pytest.approx((0.02, 0.045))


def test_hours(spark):
    grid = remote.hours(spark, "2025-03-01 23:00:00", "2025-03-02 01:00:00", "America/Chicago")
    assert [str(r.hour_utc) for r in grid.orderBy("hour_utc").collect()] == ["2025-03-02 05:00:00", "2025-03-02 06:00:00", "2025-03-02 07:00:00"]
    assert remote.missing_hours(grid, grid.limit(1)).count() == 2
    assert "hour = 3600" in remote.hour_query("t", 3600, (-98.0, -96.0, 32.0, 34.0))


def test_streams(spark, tmp_path):
    from trackloom.streaming import tracks as streams

    times = [(1, 0), (1, 60), (1, 2000), (2, 5)]
    source = spark.createDataFrame(times, "k int, s long").select("k", F.timestamp_seconds(F.col("s") + 1_000_000).alias("ts"))
    source.write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(source.schema).parquet(str(tmp_path / "in"))

    def drain(df, name, mode="complete"):
        df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start().awaitTermination()
        return spark.table(name).collect()

    assert sorted((r.k, r["rows"]) for r in drain(streams.sessions(read(), "k"), "s1")) == [(1, 1), (1, 2), (2, 1)]
    assert sum(r["rows"] for r in drain(streams.latest_per_minute(read()), "s2")) == 4
    assert sorted((r.k, r.segment) for r in drain(streams.number_segments(read(), "k", 1500), "s3", "append")) == [(1, 1), (1, 1), (1, 2), (2, 1)]


def test_routes(spark):
    fixes = spark.createDataFrame([("AAA", 0.0, 0.0), ("BBB", 0.0, 1.0)], "identifier string, lat double, lon double")
    table = lambda *paths: spark.createDataFrame(list(enumerate(paths)), "route_id long, path string")
    points = routes.resolve(table("aaa  BBB 0/2"), fixes)
    assert [(r.place, r.identifier, r.lon) for r in points.orderBy("place").collect()] == [(1, "AAA", 0.0), (2, "BBB", 1.0), (3, "COORD03", 2.0)]
    for bad, message in (("AAA ZZZ", "unknown fix: ZZZ"), ("AAA", "fewer than two")):
        with pytest.raises(Exception, match=message):
            routes.resolve(table(bad), fixes).collect()
    samples = routes.reference_paths(points)
    rows = samples.orderBy("idx").collect()
    degree = 6_371_000.0 * math.pi / 180
    assert len(rows) == 97 and rows[0].s == pytest.approx(2 * degree) and rows[-1].s == 0 and all(abs(r.curvature) < 1e-12 and abs(r.track_rad) < 1e-9 for r in rows)
    assert {r.identifier: round(r.s / degree, 6) for r in routes.waypoint_distances(points, samples).collect()} == {"AAA": 2.0, "BBB": 1.0, "COORD03": 0.0}
    state = spark.createDataFrame([(0, degree / 2, -degree / 2, 10.0, 0.0, 70.0, 0.4)], "route_id long, s double, east_m double, north_m double, psi_rad double, v_tas double, bank_limit double")
    r = routes.lateral_command(routes.along(samples, state)).first()
    assert (r.cross_track_m, r.track_error_rad) == pytest.approx((10.0, 0.0), abs=1e-6) and r.bank_rad == pytest.approx(math.atan(70**2 * (-10 / 1500**2) / 9.80665))


def test_splines():
    import numpy as np

    u = np.array([0.0, 1000, 2500, 3000, 5000, 5600])
    for degree in (1, 2, 3):
        y = np.polyval(np.arange(1, degree + 2)[::-1] * 1e-3, u / 100)
        for n in range(degree + 1, len(u) + 1):
            c = routes.cubic_through(u[:n], y[:n])
            at = np.linspace(0, u[n - 1], 50)
            assert np.allclose(routes.spline_value(u[:n], c, at, 0), np.polyval(np.arange(1, degree + 2)[::-1] * 1e-3, at / 100))


def test_entities_and_encodings(spark):
    lit = F.lit
    text = "&lt;&amp;lt;&#65;&#x20AC;&#X41;&apos;&nbsp;&nosuch;&#x110000;&#99999999999;&#55296;&"
    r = one(spark, scalars.entities(lit(text)), scalars.entities(lit("")), scalars.entities(lit(None).cast("string")), scalars.quoted_printable(lit("=C3=A9=e9=\r\nx=3dy=zz€")), scalars.chart_name(lit(" RNAV, (GPS)  RWY&nbsp;17 _C ")))
    assert r.c0 == "<&lt;A\u20ac&#X41;' &nosuch;&#x110000;&#99999999999;&#55296;&"
    assert (r.c1, r.c2) == ("", None) and r.c3 == "\xe9\ufffdx=y=zz\u20ac" and r.c4 == "RNAV_(GPS)_RWY_17_C"


def test_archived_pages(spark):
    from trackloom.sources import files

    links = "<h2>STAR</h2><a href=3D\"u?a=3D1&amp;b\">One, <b>t</b>wo</a><a href=3D\"u?a=3D1&amp;b\">One two</a><a href=3D\"v\"> </a><h2>IAP</h2><a href=3D\"w\">Th=\r\nree</a><h2>END</h2>"
    page = f'From: x\r\nContent-Type: multipart/related; boundary="a.b+c"\r\n\r\n--a.b+c\r\nContent-Type: text/css\r\n\r\nq\r\n--a.b+c\r\nContent-Type: text/html\r\n\r\n{links}\r\n--a.b+c--'
    pages = spark.createDataFrame([("p", page), ("none", "no parts"), ("null", None)], "path string, value string")
    found = files.chart_links(pages, {"star": ("STAR", "IAP"), "iap": ("IAP", "END"), "lost": ("LOST", "END")})
    assert sorted((r.path, r.section, r.place, r.label, r.url) for r in found.collect()) == [("p", "iap", 0, "Three", "w"), ("p", "star", 0, "One_two", "u?a=1&b")]


def test_margins_with_slack_and_limits(spark):
    """Each family against plain arithmetic, at the row where it is least."""
    rows = [(1, i, 1000.0 * i, h, 10.0 * i, g, q, 100.0, 500.0, 0.5, 90.0 + i, 92.0) for i, (h, g, q) in enumerate([(0.0, -0.05, 120.0), (50.0, -0.04, 400.0), (40.0, -0.06, 90.0)])]
    nodes = spark.createDataFrame(rows, "plan_id int, idx int, s double, h double, t double, gamma double, thrust double, idle double, thrust_upper double, slack double, cas double, cas_end_upper double")
    limits = verify.Limits(idle_share=0.25, descend_only=True, gamma_deg_per_km=1.0, gamma_deg_per_km2=1.0, slack={"thrust": 10.0, "h": 2.0})
    found = {r.family: (r.least_margin, r.at_s, r.holds) for r in verify.margins(nodes, limits).collect()}
    one_degree = math.radians(1.0)
    wanted = {"thrust below upper": (105.0, 1000.0), "cas below upper at end": (0.0, 2000.0), "thrust above idle": (-10.0, 2000.0), "thrust in idle band": (-200.0, 1000.0), "no climb": (-9.0, 1000.0), "time order": (10.0, 0.0)}
    wanted |= {"gamma rise": (one_degree - 0.01, 0.0), "gamma fall": (one_degree - 0.02, 1000.0), "gamma bend up": (one_degree + 0.03, 0.0), "gamma bend down": (one_degree - 0.03, 0.0)}
    assert found.keys() == wanted.keys()
    for family, (margin, s) in wanted.items():
        assert found[family][0] == pytest.approx(margin) and found[family][1:] == (s, margin >= 0)


def test_cost_of_one_row_and_of_none(spark):
    kind = "plan_id int, idx int, s double, gamma double, thrust double, idle double, cross double, heading_error double, bank double, roll double, slack double"
    r = verify.cost(spark.createDataFrame([(1, 0, 2000.0, -0.05, 300.0, 100.0, 200.0, 0.0, math.radians(20.0), 0.0, 0.5)], kind), verify.Weights(), 100.0, 0.0).first()
    assert (r.reach_term, r.thrust_term, r.gamma_term, r.cross_term, r.bank_term, r.slack_term, r.ds, r.roll_unit) == pytest.approx((-2.0, 8.0, 0.0, 1.0, 1.0, 0.25, 2000.0, 1e-3))
    assert r.total == pytest.approx(8.25)
    assert verify.cost(spark.createDataFrame([], kind), verify.Weights(), 100.0, 0.0).count() == 0


def test_nine_curves_keep_what_is_not_given(spark):
    env = spark.createDataFrame([(1, 0.0, 0.0, 10.0, 1.0), (1, 10.0, 10.0, 20.0, 2.0)], "k int, s double, low double, high double, most double")
    con = spark.createDataFrame([(1, 5.0, 7.0, None), (1, 5.0, 4.0, 30.0), (1, 12.0, None, 1.0), (2, 1.0, 1.0, 1.0)], "k int, s double, low double, high double")
    rows = profiles.tighten(env, con, "k", (("low", "high"), (None, "most"))).orderBy("s").collect()
    assert [tuple(r) for r in rows] == [(1, 0.0, 0.0, 10.0, 1.0, False), (1, 5.0, 7.0, 15.0, 1.5, False), (1, 10.0, 10.0, 20.0, 2.0, False), (1, 12.0, 10.0, 1.0, 2.0, True)]
    order = profiles.well_ordered(spark.createDataFrame([(1, 0, 0.0, 0.0), (1, 1, 1.0, 0.0), (2, 0, 0.0, 1.0), (2, 1, 0.0, 0.0), (3, 0, 0.0, 0.0)], "k int, idx int, s double, t double"), "k")
    assert sorted(tuple(r) for r in order.collect()) == [(1, True, True, True), (2, True, False, False), (3, False, True, True)]


def test_runways_show_eight_airports(spark):
    head = lambda section, airport, name: f"SUSAP {airport}K4{section}{name:<5}".ljust(132)
    airports = [f"K{c}{c}{c}" for c in "BCDEFGHIJK"]
    parsed = nav.parse(spark.createDataFrame([(i, head(s, a, n)) for i, (s, a, n) in enumerate((s, a, n) for a in airports for s, n in (("G", "RW01"), ("C", "AAAA")))], "line_no int, line string"))
    lost = spark.createDataFrame([("RW01", 1, None), ("AAAA", 1, None)], "token string, uses int, fix_type string")
    shown = {r.token: r.airports.split(",") for r in nav.failures(lost, parsed, "KAAA").collect()}
    assert shown == {"RW01": airports[:8], "AAAA": airports[:5]}
    short = nav.parse(spark.createDataFrame([(i, f"SUSAP KAAA {i}") for i in range(15)], "line_no int, line string"))
    assert [r.line_no for r in nav.failure_samples(short, "SUSAP KAAA*").collect()] == list(range(10))


def test_strict_pages_and_date_ranges(spark):
    lit = F.lit
    page = lit('boundary="b"\n--b\nContent-Type: text/html\n\n<h1>A</h1>=C3=A9<hr>--b--')
    r = one(spark, scalars.section(scalars.html_part(page, True), "<h1>", "<hr>", True), scalars.html_part(lit("none")), scalars.section(lit("x"), "<h1>", "<hr>"))
    assert list(r) == ["<h1>A</h1>é", None, None]
    for bad in (scalars.html_part(lit("none"), True), scalars.section(lit("<h1>no end"), "<h1>", "<hr>", True), scalars.datetime_range(lit("2025-07-01 02:00:00"), lit("2025-07-01 01:00:00"), "UTC")):
        with pytest.raises(Exception, match="no html part|no section <h1>|ends before"):
            one(spark, bad)
    zone = "America/Chicago"
    found = one(spark, scalars.datetime_range(lit("2025-07-01 00:00:00"), lit("2025-07-01T06:30:00Z"), zone)).c0
    assert [str(x) for x in found] == ["2025-07-01 00:00:00", "2025-07-01 01:30:00", "2025-07-01 05:00:00", "2025-07-01 06:30:00"]


def test_profile_samples_at_nodes_ends_and_between(spark):
    nodes = spark.createDataFrame([("a", 0.0, 0.0), ("a", 10.0, 10.0), ("a", 20.0, 30.0), ("b", 5.0, 7.0)], "k string, s double, y double")
    asked = spark.createDataFrame([("a", -1.0), ("a", 0.0), ("a", 5.0), ("a", 10.0), ("a", 15.0), ("a", 20.0), ("a", 99.0), ("a", None), ("b", 5.0), ("b", 0.0), ("c", 1.0), ("a", 5.0)], "k string, s double").withColumn("y", F.lit("clash"))
    found = sorted(((r.k, r.s is None, r.s or 0.0), r.value, r.slope) for r in profiles.sampled(nodes, asked, ["k"]).collect())
    assert [x[1:] for x in found] == [(0.0, 1.0), (0.0, 1.0), (5.0, 1.0), (5.0, 1.0), (10.0, 1.0), (20.0, 2.0), (30.0, 2.0), (30.0, 2.0), (None, None), (7.0, 0.0), (7.0, 0.0), (None, None)]


def test_nearest_threshold_far_away_and_over_the_date_line(spark):
    """Rings of growing radius find what comparing with every threshold finds."""
    import math
    import random

    rng = random.Random(4)
    places = [(1, "A", 32.9, -97.0), (2, "B", -20.0, 179.9), (3, "C", 60.0, 10.0), (4, "A2", 32.9, -97.0)]
    points = [(f"f{i % 40}", rng.uniform(-80, 80), rng.uniform(-180, 180)) for i in range(60)] + [("near", 32.91, -97.0), ("near", -20.0, 179.0), ("line", -20.0, -179.9), ("none", None, 1.0)]

    def far(a, b, c, d):
        p, q = math.radians(a), math.radians(c)
        x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
        return round(6_371_000.0 * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x)), 3)

    want = {}
    for f, lat, lon in points:
        if lat is not None:
            want[f] = min([want.get(f, (1e9,)), *((far(lat, lon, c, d), o, r) for o, r, c, d in places)])
    found = proximity.nearest_threshold(spark.createDataFrame(points, "flight_id string, lat double, lon double"), spark.createDataFrame(places, "place_ord int, runway string, place_lat double, place_lon double"))
    got = {r.flight_id: (r.distance_m, r.runway) for r in found.collect()}
    assert got.keys() == want.keys()
    assert all(abs(got[f][0] - want[f][0]) <= 0.002 and got[f][1] == want[f][2] for f in got)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 8])
def test_paths_of_many_routes_at_once_are_those_of_one(n):
    import numpy as np

    rng = np.random.default_rng(n)
    u = np.concatenate((np.zeros((7, 1)), np.cumsum(rng.uniform(500.0, 9000.0, (7, n - 1)), axis=1)), axis=1)
    y = rng.uniform(-1e4, 1e4, (7, n))
    together = routes.cubics_through(u, y)
    for i in range(7):
        at = np.linspace(0.0, u[i, -1], 50)
        for order in range(3):
            one = routes.spline_value(u[i], routes.cubic_through(u[i], y[i]) if n > 1 else np.array([[y[i, 0], 0, 0, 0]]), at, order)
            np.testing.assert_allclose(routes.spline_value(u[i], together[i], at, order), one, rtol=1e-6, atol=1e-6 * max(1e-9, np.abs(one).max()))


def test_distances_are_found_where_paths_are_made(spark):
    rows = [(r, k, f"P{(r * k) % 4}", 30.0 + 0.1 * ((r * 7 + k * 3) % 11) + 0.01 * k, -97.0 - 0.1 * ((r * 5 + k * 4) % 13)) for r in range(40) for k in range(1, 3 + r % 4)]
    points = spark.createDataFrame(rows, "route_id long, place int, identifier string, lat double, lon double").repartition(5)
    own, plan = routes.waypoint_distances(points), routes.reference_paths(points)
    want = {(r.route_id, r.identifier): r.s for r in routes.waypoint_distances(points, plan).collect()}
    found = {(r.route_id, r.identifier): r.s for r in own.collect()}
    assert found.keys() == want.keys() and all(found[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert len(plan.collect()) == sum((1 + r % 4) * 48 + 1 for r in range(40))
    text = own._jdf.queryExecution().toString()
    assert "Join" not in text and "FlatMapGroups" not in text


def test_straight_paths_join_no_samples(spark):
    from trackloom.plans.field_queries import line_paths

    assert "Join" not in line_paths(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()


def test_plans_are_aggregated_where_they_stand(spark):
    """One exchange of order lines serves the margins and defects of plans: neither exploded rows nor a second copy of the lines are shuffled."""
    from trackloom.plans import fixture, queries

    d = "/root/testdata/sf0.001"
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "Join" not in plan(fixture.lateral_plan_nodes(spark, d))
    for name in ("margin_families", "constraint_margins", "worst_defects"):
        assert plan(queries.QUERIES[name](spark, d)).count("Exchange hashpartitioning") == 1, name
    assert plan(queries.endpoint_defects(spark, d)).count("Exchange hashpartitioning") <= 2
    assert plan(queries.envelope_nine(spark, d)).count("Exchange hashpartitioning") <= 3


def test_tasks_of_plans_stay_of_one_size(spark, monkeypatch):
    """More order lines are dealt to more tasks, once for both grids of an envelope, and one sort finds both neighbours of a node."""
    from trackloom import shared
    from trackloom.plans import queries

    d = "/root/testdata/sf0.001"
    monkeypatch.setattr(shared, "TASK_ROWS", 500)
    want = -(-spark.read.parquet(f"{d}/lineitem.parquet").count() // 500)
    assert want > 4
    for name in ("envelope_nine", "envelope_tighten"):
        found = queries.QUERIES[name](spark, d)
        plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
        assert f", {want}), REPARTITION_BY_NUM" in plan and plan.count("Exchange hashpartitioning") <= 2, name
        assert plan.count("Sort [l_orderkey") == 3 and " DESC " not in plan, name  # the lines of each grid, then both grids
    assert queries.envelope_nine(spark, d).rdd.getNumPartitions() == want


def test_neighbours_of_nodes_without_a_place_or_a_value(spark):
    """A row without s has no values and is no neighbour; long runs of nulls are filled from both sides."""
    rows = [(1, None, 5.0, None), (1, 0.0, None, None), (1, 1.0, 2.0, 3.0), (1, 2.0, None, None), (1, 5.0, 10.0, None), (1, 9.0, None, None), (2, 1.0, None, 1.0), (2, None, None, None)]
    frame = spark.createDataFrame(rows, "k int, s double, a double, b double")
    found = {(r.k, r.s): (r.a, r.b) for r in profiles.filled(frame, ["k"], ["a", "b"]).collect()}
    assert found == {(1, None): (None, None), (1, 0.0): (2.0, 3.0), (1, 1.0): (2.0, 3.0), (1, 2.0): (4.0, 3.0), (1, 5.0): (10.0, 3.0), (1, 9.0): (10.0, 3.0), (2, 1.0): (None, 1.0), (2, None): (None, None)}
    gaps = spark.range(200_001).selectExpr("1 AS k", "cast(id AS double) AS s", "IF(id % 50000 = 0, cast(id AS double), NULL) AS a")
    assert profiles.filled(gaps, ["k"], ["a"]).where("abs(a - s) < 1e-6").count() == 200_001
