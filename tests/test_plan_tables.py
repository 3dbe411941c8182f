"""Lookups, node grids, envelopes, splices, extensions, path states, payloads and remote hours against plain versions."""

import math
import random
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from trackloom.operators import compress, lookup, plan_tables, routes, segments
from trackloom.sources import remote

DATA = Path("/root/testdata/sf0.001")


def plain_grid(length, nodes, final, approach):
    """Shares by the square root of each gap, then one node less in the largest or more in the heaviest gap until the total fits."""
    stops = sorted({0.0, *(min(x, length) for x in (8000.0, 30000.0, 60000.0, final, approach, length))})
    if len(stops) >= nodes or len(stops) < 2:
        return list(np.linspace(0.0, length, nodes))
    gaps = [math.sqrt(max(b - a, 1.0)) for a, b in zip(stops, stops[1:])]
    counts = [max(2, round(g / sum(gaps) * (nodes + len(gaps)))) for g in gaps]
    total = lambda: sum(counts) - len(counts) + 1
    while total() > nodes and max(counts) > 2:
        counts[counts.index(max(counts))] -= 1
    while total() < nodes:
        counts[gaps.index(max(gaps))] += 1
    out = [0.0]
    for a, b, n in zip(stops, stops[1:], counts):
        out += list(np.linspace(a, b, n))[1:]
    return out


def test_node_grids_of_any_length_and_number(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice([0.5, 4000.0, 8000.0, 12000.0, rng.uniform(1e3, 3e5)]), rng.randint(2, 90), rng.choice([8000.0, 12000.0]), rng.choice([12000.0, 35000.0, 4e5])) for i in range(300)]
    found = {}
    for r in plan_tables.node_grid(spark.createDataFrame(rows, "route_id long, length_m double, nodes int, final_gate_m double, approach_gate_m double")).collect():
        found.setdefault(r.route_id, []).append((r.idx, r.s))
    for i, length, nodes, final, approach in rows:
        want, got = plain_grid(length, nodes, final, approach), sorted(found[i])
        assert [k for k, _ in got] == list(range(len(want))) and np.allclose([s for _, s in got], want, atol=1e-6), i
        assert got[-1][1] == length and all(b[1] > a[1] for a, b in zip(got, got[1:]))
    assert sum(len(found[i]) == n for i, _, n, *_ in rows) > 250


AXES = lookup.Axis("s", 10.0, 5.0, 4), lookup.Axis("h", 0.0, 100.0, 3), lookup.Axis("t", 7.0, 1.0, 1)


def test_lookup_is_exact_at_nodes_linear_between_and_held_outside(spark):
    value = lambda s, h: 0.1 * s * s + 0.3 * h + 0.01 * s * h
    nodes = [(10.0 + 5 * i, 100.0 * j, 7.0, value(10.0 + 5 * i, 100.0 * j), float(i), -float(j)) for i in range(4) for j in range(3)]
    nodes += [(11.0, 0.0, 7.0, 1e9, 1e9, 1e9), (None, 0.0, 7.0, 1e9, 1e9, 1e9), (10.0, 900.0, 7.0, 1e9, 1e9, 1e9)]  # off the grid
    fields = "s double, h double, t double, wind_east double, wind_north double, delta_isa double"
    points = [(k, s, h, t) for k, (s, h, t) in enumerate([(10.0, 0.0, 7.0), (25.0, 200.0, 7.0), (15.0, 100.0, 99.0), (12.5, 50.0, 7.0), (-1e9, -5.0, 7.0), (1e9, 1e9, 7.0), (None, 0.0, 7.0), (float("nan"), 0.0, 7.0), (24.9, 199.0, 0.0), (12.5, 50.0, 7.0)])]
    frame = spark.createDataFrame(points, "k int, s double, h double, t double").withColumn("cell", F.lit("clash"))
    found = {r.k: r for r in lookup.weather(*AXES).sample(frame.drop("cell"), spark.createDataFrame(nodes, fields)).collect()}
    assert len(found) == len(points)
    for k, s, h, _ in points:
        if s is None or math.isnan(s):
            assert found[k].wind_east is None
            continue
        s, h = min(max(s, 10.0), 25.0), min(max(h, 0.0), 200.0)
        i, j = min(int((s - 10) // 5), 2), min(int(h // 100), 1)
        f, g = (s - 10) / 5 - i, h / 100 - j
        at = lambda a, b: value(10.0 + 5 * (i + a), 100.0 * (j + b))
        want = sum(w * v * at(a, b) for a, w in ((0, 1 - f), (1, f)) for b, v in ((0, 1 - g), (1, g)))
        assert found[k].wind_east == pytest.approx(want, rel=1e-12)
        if f in (0.0, 1.0) and g in (0.0, 1.0):
            assert found[k].wind_east == at(int(f), int(g))
    assert lookup.weather(*AXES).sample(frame.limit(0).drop("cell"), spark.createDataFrame(nodes, fields)).count() == 0
    with pytest.raises(ValueError, match="step"):
        lookup.Axis("s", 0.0, 0.0, 3)


def test_performance_by_type_and_mode(spark):
    grid = lookup.performance(lookup.Axis("h", 0.0, 10.0, 2), lookup.Axis("v", 0.0, 10.0, 2))
    nodes = [(k, m, 10.0 * i, 10.0 * j, k + i + j, 10.0 * k, len(m)) for k in (1, 2) for m in ("final", "clean") for i in (0, 1) for j in (0, 1)]
    table = spark.createDataFrame([(*x[:4], *map(float, x[4:])) for x in nodes if x[:4] != (2, "clean", 10.0, 10.0)], "type int, mode string, h double, v double, idle double, thrust_upper double, drag double")
    rows = spark.createDataFrame([(0, 1, "final", 5.0, 5.0), (1, 2, "clean", 0.0, 0.0), (2, 2, "clean", 5.0, 5.0), (3, 9, "final", 1.0, 1.0), (4, 1, None, 1.0, 1.0)], "k int, type int, mode string, h double, v double")
    found = {r.k: (r.idle, r.drag) for r in grid.sample(rows, table).collect()}
    assert found == {0: (2.0, 5.0), 1: (2.0, 5.0), 2: (None, None), 3: (None, None), 4: (None, None)}


def test_splices_with_a_part_missing(spark):
    fields = "plan_id int, idx int, t double, distance double, phase string"
    first = [(1, 0, 0.0, 0.0, "level"), (1, 1, 10.0, 900.0, "level"), (2, 5, 3.0, 30.0, "level"), (4, 0, 1.0, 1.0, "level")]
    second = [(1, 0, 0.0, 0.0, "a"), (1, 1, 5.0, 400.0, "b"), (1, 2, 6.0, 500.0, "hold"), (3, 7, 2.0, 20.0, "a"), (3, 9, 4.0, 40.0, "b"), (4, 0, 7.0, 70.0, "only")]
    a, b = spark.createDataFrame(first, fields), spark.createDataFrame(second, fields)
    found = sorted(map(tuple, plan_tables.splice(a, b).collect()))
    assert found == [(1, 0, 0.0, 0.0, "level"), (1, 1, 10.0, 900.0, "level"), (1, 2, 15.0, 1300.0, "b"), (1, 3, 16.0, 1400.0, "hold"), (2, 0, 3.0, 30.0, "level"), (3, 0, 2.0, 20.0, "a"), (3, 1, 4.0, 40.0, "b"), (4, 0, 1.0, 1.0, "level"), (4, 1, 8.0, 71.0, "only")]
    assert {r.phase for r in plan_tables.splice(a, b, phase="descent").collect()} == {"level", "descent"}
    totals = {r.plan_id: tuple(r)[1:] for r in plan_tables.splice_totals(a, b).collect()}
    assert totals == {1: (10.0, 900.0, 6.0, 500.0), 2: (3.0, 30.0, 0.0, 0.0), 3: (0.0, 0.0, 4.0, 40.0), 4: (1.0, 1.0, 7.0, 70.0)}
    assert plan_tables.splice(a.limit(0), b).count() == len(second) and plan_tables.splice(a, b.limit(0)).count() == len(first)


def test_extensions_reached_rejected_and_made(spark):
    plan = "plan_id int, idx int, s double, h double, v double, cas double, t double, gamma double, thrust double, phase string, note string"
    rows = [(p, i, 1000.0 * i, 50.0 * i, 90.0, 80.0, 12.0 * i, -0.05, 9000.0, "final", "n") for p in (1, 2, 3, 4) for i in (0, 1, 2)]
    kt = 0.514444
    starts = [(1, 2000.0, 10.0, 500.0), (2, 40_000.0, (80.0 + 2.5) / kt, 1000.0), (3, 40_000.0, (80.0 + 2.6) / kt, 1000.0)]
    found = plan_tables.extend(spark.createDataFrame(rows, plan), spark.createDataFrame(starts, "plan_id int, start_s double, start_cas_kt double, upstream_h double"), nodes=4).collect()
    assert {(r.plan_id, r.outcome) for r in found} == {(1, "reached"), (2, "extended"), (3, "rejected"), (4, "reached")}
    made = sorted((r for r in found if r.plan_id == 2), key=lambda r: r.idx)
    assert [r.s for r in made[3:]] == [11_500.0, 21_000.0, 30_500.0, 40_000.0] and [r.phase for r in made[3:]] == ["final", "approach", "approach", "clean"]
    assert all(r.h == 1000.0 and r.gamma == 0.0 and r.note is None and r.thrust is None and r.cas == pytest.approx(82.5) for r in made[3:])
    assert [r.t - 24.0 for r in made[3:]] == pytest.approx([9500.0 * k / made[3].v for k in (1, 2, 3, 4)]) and made[3].v > 82.5
    assert sum(r.plan_id != 2 for r in found) == 9 and {r.jump_kt for r in found if r.plan_id == 1} == {None}


def test_envelopes_clip_gates_and_mark_what_cannot_be_met(spark):
    routes_ = [(1, 7, 80_000.0, 10.0, 3000.0, 65.0, 250.0, 12_000.0, 35_000.0), (2, 7, 5_000.0, 0.0, 1000.0, 65.0, 250.0, 90_000.0, 1.0), (3, 8, 70_000.0, 0.0, 1000.0, 65.0, 250.0, 0.0, 35_000.0)]
    frame = spark.createDataFrame(routes_, "route_id int, type int, length_m double, threshold_h double, upstream_h double, threshold_cas double, upstream_cas_kt double, final_gate_m double, approach_gate_m double")
    schedule = spark.createDataFrame([(7, 0.0, 70.0), (7, 50_000.0, 120.0)], "type int, s double, cas double")
    limits = spark.createDataFrame([(1, "abc", 5000.0, None), (1, "ABC", 4000.0, 6000.0), (1, "nowhere", 9.0, 9.0), (2, "ABC", 20_000.0, None)], "route_id int, fix_identifier string, lower_ft double, upper_ft double")
    places = spark.createDataFrame([(1, "Abc", 20_000.0), (2, "abc", 20_000.0)], "route_id int, identifier string, s double")
    found = {(r.route_id, r.s): r for r in plan_tables.envelope(frame, schedule, limits, places).collect()}
    assert sorted(s for k, s in found if k == 1) == [0.0, 5000.0, 12_000.0, 20_000.0, 35_000.0, 50_000.0, 80_000.0]
    at = found[1, 20_000.0]
    assert (at.h_lower, at.h_upper, at.crossed) == (pytest.approx(1524.0), pytest.approx(1828.8), False)
    assert found[1, 12_000.0].h_lower == pytest.approx(10.0 + (1524.0 - 10.0) * 7 / 15) and math.degrees(found[1, 12_000.0].gamma_lower) == pytest.approx(-4.2)
    assert found[1, 0.0].cas_lower == 65.0 and found[1, 80_000.0].cas_upper == pytest.approx(120.0 + 80 * 0.514444)
    assert found[2, 20_000.0].crossed and math.degrees(found[2, 60_000.0].gamma_upper) == pytest.approx(0.25) and (2, 90_000.0) not in found
    assert all(r.cas_lower is None for (k, _), r in found.items() if k == 3)
    assert math.degrees(found[3, 0.0].gamma_lower) == pytest.approx(-4.2)


def test_path_states_across_the_seam_and_beyond_the_ends(spark):
    pi = math.pi
    samples = [(1, 0.0, 0.0, 0.0, 3.0, 0.0), (1, 10.0, 100.0, 50.0, -3.0, 0.1), (1, 20.0, 200.0, 50.0, -3.0 + 2 * pi, 0.2), (2, 5.0, 7.0, 8.0, 1.0, 0.3)]
    frame = spark.createDataFrame([(r, i, *x) for i, (r, *x) in enumerate(samples)], "route_id int, idx int, s double, east_m double, north_m double, track_rad double, curvature double")
    states = [(k, r, s, c, o) for k, (r, s, c, o) in enumerate([(1, 0.0, 0.0, 0.0), (1, 5.0, 10.0, 0.0), (1, 10.0, 0.0, 1.0), (1, 15.0, 0.0, 0.0), (1, -4.0, 0.0, 0.0), (1, 99.0, 0.0, 0.0), (2, 3.0, 2.0, 0.0), (9, 1.0, 0.0, 0.0), (1, None, 0.0, 0.0), (1, 5.0, 10.0, 0.0)])]
    wanted = spark.createDataFrame(states, "k int, route_id int, s double, cross_track_m double, heading_offset_rad double")
    for slots in (1, 3):
        met = routes.on_path(frame, wanted) if slots == 1 else routes.along(frame, wanted, slots)
        found = {r.k: r for r in met.collect()}
        assert len(found) == len(states)
        assert [found[k].ref_east_m for k in range(7)] == [0.0, 50.0, 100.0, 150.0, 0.0, 200.0, 7.0]
        assert abs(found[1].ref_track_rad) == pytest.approx(pi) and found[3].ref_track_rad == pytest.approx(-3.0)
        assert found[7].ref_east_m is None and found[8].ref_east_m is None
        assert [found[1].normal_east, found[1].normal_north] == pytest.approx([0.0, -1.0], abs=1e-12)
    done = {r.k: r for r in routes.on_path(frame, wanted).collect()}
    assert (done[1].east_m, done[1].north_m) == (pytest.approx(50.0), pytest.approx(15.0)) and done[2].psi_rad == pytest.approx(-2.0)
    assert (done[6].east_m, done[6].north_m) == (pytest.approx(7.0 - 2 * math.sin(1.0)), pytest.approx(8.0 + 2 * math.cos(1.0)))


def test_payload_times_round_half_to_even_and_keep_the_last(spark):
    samples = [("A", i, t, 32.0 + i / 100, -97.0, 100.0 * i) for i, t in enumerate([0.5, 1.5, 2.5, 2.6, 9.0])] + [("A", 9, None, 1.0, 1.0, 1.0), ("B", 0, 1.0, 1.0, 1.0, 1.0), ("A", 10, 11.0, None, 1.0, 1.0)]
    starts = [("A", "C1", "abc", 100)]
    found = compress.resampled(spark.createDataFrame(samples, "flight_id string, idx int, t double, lat double, lon double, h double"), spark.createDataFrame(starts, "flight_id string, callsign string, icao24 string, seed_time long"))
    assert sorted((r.time, r.ordinal) for r in found.collect()) == [(100, 0), (102, 2), (103, 3), (109, 4)]
    kept = compress.compress(found, 10.0, 1.0)
    payload = compress.compressed_flights(found, kept, 10.0, 1.0).first()
    assert (payload.raw_point_count, payload.first_time, payload.last_time, payload.callsign) == (4, 100, 109, "C1")
    assert payload.altitude_breakpoint_times[0] == 100 and payload.altitude_breakpoint_times[-1] == 109


def test_remote_hours_are_fetched_once(spark, tmp_path):
    """A Derby table read by the hour; a second run asks for the missing hours alone and leaves the others as they are."""
    url, driver = f"jdbc:derby:memory:{tmp_path.name};create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    rows = [(3600 * h, 3600.0 * h + t, f"a{h}", 32.0 + h / 10, -97.0, 3600.0 * h + t - late) for h in range(5) for t, late in ((1.0, 0.0), (30.0, 0.0), (30.0, 99.0), (90.0, 1.0))]
    table = spark.createDataFrame(rows, "hour int, time double, icao24 string, lat double, lon double, lastcontact double")
    table.where("hour < 10800").write.jdbc(url, "positions", properties={"driver": driver})
    box, path, grid = (-98.0, -96.0, 31.0, 32.35), str(tmp_path / "out"), [3600 * h for h in range(4)]

    scan = remote.read_hours(spark, url, "positions", grid, driver=driver)
    assert scan.rdd.getNumPartitions() == 4
    spark.conf.set("spark.sql.maxMetadataStringLength", 4000)  # plans name all pushed filters
    plan = segments.within_box(scan, *box).select("time")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    assert all(f"{sign}({c}" in plan.lower() for sign in ("greaterthanorequal", "lessthanorequal") for c in ("lat", "lon")) and "icao24" not in plan.lower()

    assert remote.fetch_missing(spark, url, "positions", grid, path, box, driver=driver) == grid
    first = {r.hour: r.n for r in spark.read.parquet(path).groupBy("hour").agg(F.count("*").alias("n")).collect()}
    assert first == {0: 2, 3600: 2, 7200: 2}
    before = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    table.where("hour >= 10800").write.mode("append").jdbc(url, "positions", properties={"driver": driver})
    assert remote.fetch_missing(spark, url, "positions", grid, path, box, driver=driver) == [10_800]
    after = {f.name: f.stat().st_mtime_ns for f in (tmp_path / "out").rglob("*.parquet")}
    assert before.items() <= after.items()
    assert {r.hour for r in spark.read.parquet(path).select("hour").distinct().collect()} == set(grid[:4])
    assert remote.fetch_missing(spark, url, "positions", grid, path, box, driver=driver) == []
    assert remote.read_hours(spark, url, "positions", [], driver=driver).count() == 0


@pytest.mark.skipif(not DATA.exists(), reason="no driver tables here")
def test_paths_of_all_customers_equal_the_cubic_through_their_waypoints(spark):
    """Through four waypoints runs one cubic; its samples, lengths, angles and curvature, and each waypoint's nearest sample."""
    from trackloom.plans.queries import QUERIES

    points, found = {}, {}
    for r in QUERIES["resolve_routes"](spark, str(DATA)).collect():
        points.setdefault(r.route_id, []).append((r.place, r.identifier, r.lat, r.lon))
    for r in QUERIES["reference_paths"](spark, str(DATA)).collect():
        found.setdefault(r.route_id, []).append((r.idx, r.s, r.east_m, r.north_m, r.lat, r.lon, r.track_rad, r.curvature))
    distances = {(r.route_id, r.identifier): r.s for r in QUERIES["waypoint_distances"](spark, str(DATA)).collect()}
    assert found.keys() == points.keys() and len(found) >= 100
    for route, own in points.items():
        own.sort()
        lat, lon = np.array([p[2] for p in own]), np.array([p[3] for p in own])
        north = 6_371_000.0 * np.radians(lat - lat[-1])
        east = 6_371_000.0 * math.cos(math.radians(lat[-1])) * np.radians(lon - lon[-1])
        u = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(east), np.diff(north)))))
        got = np.array(sorted(found[route]))
        at = np.linspace(0.0, 1.0, len(got))
        assert len(got) == 48 * 3 + 1
        x, y = (np.polynomial.Polynomial.fit(u / u[-1], v, 3, domain=[0, 1], window=[0, 1]) for v in (east, north))
        run = np.concatenate(([0.0], np.cumsum(np.hypot(np.diff(x(at)), np.diff(y(at))))))
        assert np.allclose(got[:, 2], x(at), atol=1e-3) and np.allclose(got[:, 3], y(at), atol=1e-3)
        assert np.allclose(got[:, 1], run[-1] - run, atol=1e-3)
        dx, dy, ddx, ddy = (p.deriv(k)(at) for k in (1, 2) for p in (x, y))
        assert np.allclose(np.cos(got[:, 6] - np.arctan2(dy, dx)), 1.0, atol=1e-9) and np.abs(np.diff(got[:, 6])).max() <= math.pi
        assert np.allclose(got[:, 7], (dx * ddy - dy * ddx) / (dx**2 + dy**2) ** 1.5, rtol=1e-4, atol=1e-9)
        for _, name, a, b in own:
            if [p[1] for p in own].count(name) == 1:
                assert distances[route, name] == got[int(np.hypot(got[:, 4] - a, got[:, 5] - b).argmin()), 1]
