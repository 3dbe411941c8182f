"""Queries of column functions, files and summaries over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import flight, geo, scalars
from trackloom.operators import classify, compress, profiles, routes, schedule, segments, verify
from trackloom.plans import fixture
from trackloom.plans.fixture import read
from trackloom.plans.queries import CLASSIFIED, EVENTS, ORACLES, PLANS, RHO, SPLIT, TRACKS, numbered_tracks, order_events, order_sequences, order_trajectories, query, rows_of
from trackloom.plans.table_queries import RESAMPLED, SAMPLED, line_sql, path_samples, plan_payload_tracks
from trackloom.shared import place
from trackloom.sources import files, sinks

R = "6371000.0::DOUBLE"


def rounded(df: DataFrame, keys: list[str], places: dict[str, int]) -> DataFrame:
    return df.select(*keys, *(F.round(c, n).alias(c) for c, n in places.items()))


def wrapped_sql(x: str) -> str:
    return f"atan2(sin({x}), cos({x}))"


# Geometry.


@query(
    f"""WITH f AS (SELECT s_suppkey AS k, 32.9157::DOUBLE + (s_suppkey * 7 % 97 - 48) * 0.004::DOUBLE AS lat, -97.026::DOUBLE + (s_suppkey * 11 % 89 - 44) * 0.005::DOUBLE AS lon, s_acctbal FROM supplier),
g AS (SELECT *, {R} * radians(lat - 32.9157::DOUBLE) AS n, {R} * cos(radians(32.9157::DOUBLE)) * radians(lon + 97.026::DOUBLE) AS e, abs(s_acctbal) + 1000.0::DOUBLE AS r FROM f)
SELECT k AS s_suppkey, round(n, 6) AS north_m, round(e, 6) AS east_m, round(32.9157::DOUBLE + degrees(n / {R}), 9) AS lat, round(-97.026::DOUBLE + degrees(e / ({R} * cos(radians(32.9157::DOUBLE)))), 9) AS lon,
  round({wrapped_sql("radians(90.0 - k * 37 % 720)")}, 9) AS psi_rad, round({wrapped_sql("k * 0.7::DOUBLE")}, 9) AS wrapped_rad, round(12.0::DOUBLE * cos(k * 0.7::DOUBLE) - 5.0::DOUBLE * sin(k * 0.7::DOUBLE), 9) AS wind_along,
  round(lon - r / (111320.0::DOUBLE * greatest(cos(radians(lat)), 0.2)), 9) AS west, round(lon + r / (111320.0::DOUBLE * greatest(cos(radians(lat)), 0.2)), 9) AS east, round(lat - r / 111320.0::DOUBLE, 9) AS south, round(lat + r / 111320.0::DOUBLE, 9) AS north FROM g"""
)
def fix_geometry(spark: SparkSession, d: str) -> DataFrame:
    """Positions in the plane and back, headings, wrapped angles, wind along a track, and boxes about a place."""
    lat0, lon0, k = F.lit(32.9157), F.lit(-97.026), F.col("place_ord")
    fixes = fixture.fixes(spark, d).join(read(spark, d, "supplier").select(F.col("s_suppkey").alias("place_ord"), "s_acctbal"), "place_ord")
    lat, lon = F.col("place_lat"), F.col("place_lon")
    out = fixes.withColumns({"north_m": geo.local_north_m(lat, lat0), "east_m": geo.local_east_m(lat0, lon, lon0)})
    out = out.withColumns({"lat": geo.latitude_of(F.col("north_m"), lat0), "lon": geo.longitude_of(F.col("east_m"), lat0, lon0), "psi_rad": geo.heading_to_math_rad(k * 37 % 720), "wrapped_rad": geo.wrap_rad(k * 0.7), "wind_along": geo.along_track_wind(F.lit(12.0), F.lit(-5.0), k * 0.7), "box": geo.extent(lat, lon, F.abs("s_acctbal") + 1000.0)})
    out = out.select("*", "box.*").withColumnRenamed("place_ord", "s_suppkey")
    return rounded(out, ["s_suppkey"], {"north_m": 6, "east_m": 6, "lat": 9, "lon": 9, "psi_rad": 9, "wrapped_rad": 9, "wind_along": 9, "west": 9, "east": 9, "south": 9, "north": 9})


# Flight mechanics.

THIN = f"least(greatest({RHO.format(h='h', d='5.0::DOUBLE')} / 1.225::DOUBLE, 0.05), 1.25)"


@query(
    f"""WITH {PLANS}, a AS (SELECT *, 0.5::DOUBLE * {RHO.format(h='h', d='5.0::DOUBLE')} * greatest(v, 1.0) * greatest(v, 1.0) AS q, (plan_id % 9 - 4) / 20.0::DOUBLE AS bank FROM node), b AS (SELECT *, 60000.0::DOUBLE * 9.80665::DOUBLE * cos(gamma) / greatest(q * 122.6::DOUBLE, 1e-6) AS cl FROM a)
SELECT plan_id, idx, round(greatest(240000.0::DOUBLE * pow({THIN}, 0.75) * greatest(1.0 - 0.0008::DOUBLE * greatest(v / 0.514444::DOUBLE - 120.0, 0.0), 0.35) * CASE phase WHEN 'clean' THEN 1.0 WHEN 'approach' THEN 0.92 ELSE 0.85 END, 8001.0), 4) AS ceiling_n, round(cl, 9) AS cl, round(cl / greatest(cos(bank), 0.2), 9) AS banked_cl,
  round(greatest(least((0.1::DOUBLE - bank) / 2.0, 0.05::DOUBLE), -0.05::DOUBLE), 9) AS roll_rate, round(9.80665::DOUBLE * tan(bank) / greatest(v, 1.0), 9) AS heading_rate,
  round(CASE WHEN h <= 1200.0 THEN least(t, 100.0) ELSE t END, 6) AS target_cas, least(64500.0::DOUBLE, 42600.0::DOUBLE + plan_id * 10.0::DOUBLE) AS mass_kg FROM (SELECT *, CASE phase WHEN 'clean' THEN 130.0 WHEN 'approach' THEN 95.0 ELSE 70.0 END::DOUBLE AS t_ FROM b) c(plan_id, idx, s, h, v, t0, gamma, thrust, phase, q, bank, cl, t)"""
)
def flight_limits(spark: SparkSession, d: str) -> DataFrame:
    """Greatest thrust, lift coefficients, roll and heading rates, target speed and mass at every plan node."""
    h, v, isa, lit = F.col("h"), F.col("v"), F.lit(5.0), F.lit
    own = fixture.plan_nodes(spark, d).withColumn("bank", (F.col("plan_id") % 9 - 4) / lit(20.0))
    mass = (lit(60_000.0), lit(122.6), v, h, F.col("gamma"))
    out = own.withColumns(
        {
            "ceiling_n": flight.thrust_ceiling_n(lit(240_000.0), lit(8000.0), F.col("phase"), v, h, isa),
            "cl": flight.lift_coefficient(*mass, isa),
            "banked_cl": flight.banked_lift_coefficient(*mass, F.col("bank"), isa),
            "roll_rate": flight.roll_rate(F.col("bank"), lit(0.1), lit(2.0), lit(0.05)),
            "heading_rate": flight.heading_rate(F.col("bank"), v),
            "target_cas": flight.target_cas(F.col("phase"), lit(130.0), lit(95.0), lit(70.0), h, 1200.0, 100.0),
            "mass_kg": flight.approach_mass_kg(lit(64_500.0), lit(42_600.0), F.col("plan_id") * 10.0),
        }
    )
    return rounded(out, ["plan_id", "idx"], {"ceiling_n": 4, "cl": 9, "banked_cl": 9, "roll_rate": 9, "heading_rate": 9, "target_cas": 6, "mass_kg": 6})


@query(
    """WITH c AS (SELECT o_orderkey AS k, 20000.0::DOUBLE + o_custkey % 50 * 100.0::DOUBLE AS len, o_orderkey % 20 * 6300.0::DOUBLE / 7.3::DOUBLE AS x, o_custkey % 30 * 10.0::DOUBLE AS h0, 2000.0::DOUBLE + o_custkey % 11 * 50.0::DOUBLE AS h1, 0.05::DOUBLE AS a, o_orderkey % 5 / 100.0::DOUBLE AS b FROM orders), u AS (SELECT *, x / len AS u FROM c)
SELECT k AS o_orderkey, round((2*u*u*u - 3*u*u + 1) * h0 + (u*u*u - 2*u*u + u) * len * a + (3*u*u - 2*u*u*u) * h1 + (u*u*u - u*u) * len * b, 6) AS height_m, round((6*u*u - 6*u) * (h0 - h1) / len + (3*u*u - 4*u + 1) * a + (3*u*u - 2*u) * b, 11) AS slope,
  round(greatest(least((h1 - h0) / tan(greatest(abs(b), radians(3.0))), len), 1000.0), 6) AS guess_m, coalesce(nullif(k % 3, 0), nullif(k % 4, 0), nullif(k % 5, 0)) AS clean, coalesce(nullif(k % 4, 0), coalesce(nullif(k % 3, 0), nullif(k % 4, 0), nullif(k % 5, 0))) AS approach, coalesce(nullif(k % 5, 0), coalesce(nullif(k % 3, 0), nullif(k % 4, 0), nullif(k % 5, 0))) AS final FROM u"""
)
def cubic_descents(spark: SparkSession, d: str) -> DataFrame:
    """Cubic height and slope of a descent, a guess of its length, and speed targets with the missing ones filled."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    own = read(spark, d, "orders").select(k, (c % 50 * 100.0 + 20_000.0).alias("len"), (k % 20 * 6300.0 / 7.3).alias("x"), (c % 30 * 10.0).alias("h0"), (c % 11 * 50.0 + 2000.0).alias("h1"), F.lit(0.05).alias("a"), (k % 5 / F.lit(100.0)).alias("b"))
    args = [F.col(x) for x in ("x", "len", "h0", "h1", "a", "b")]
    targets = flight.speed_targets(*(F.nullif(k % n, F.lit(0)) for n in (3, 4, 5)))
    out = own.withColumns({"height_m": flight.cubic_height(*args), "slope": flight.cubic_slope(*args), "guess_m": flight.top_of_descent_guess(F.col("h1") - F.col("h0"), F.col("b"), F.col("len")), "targets": targets})
    return rounded(out.select("*", "targets.*"), ["o_orderkey", "clean", "approach", "final"], {"height_m": 6, "slope": 11, "guess_m": 6})


@query(
    f"""WITH {SAMPLED}, lo AS (SELECT state.*, CASE WHEN sample.s IS NOT NULL THEN sample END AS before FROM state ASOF LEFT JOIN sample ON state.route_id = sample.route_id AND state.s >= sample.s),
hi AS (SELECT lo.*, CASE WHEN sample.s IS NOT NULL THEN sample END AS after FROM lo ASOF LEFT JOIN sample ON lo.route_id = sample.route_id AND lo.s <= sample.s),
met AS (SELECT * EXCLUDE (before, after), coalesce(before, after) AS a, coalesce(after, before) AS b FROM hi),
r AS (SELECT state_id, cross_track_m AS x, heading_offset_rad AS o, {line_sql("track_rad", True)} AS k, {line_sql("curvature")} AS c FROM met),
w AS (SELECT *, 80.0::DOUBLE * cos(k + o) + 3.0::DOUBLE AS ve, 80.0::DOUBLE * sin(k + o) - 4.0::DOUBLE AS vn FROM r),
y AS (SELECT *, sqrt(ve * ve + vn * vn) AS g, {wrapped_sql("atan2(vn, ve) - k")} AS te FROM w), z AS (SELECT *, c - x / (1500.0::DOUBLE * 1500.0) - 2.0::DOUBLE * te / 1500.0 AS kk FROM y)
SELECT state_id, round(g, 6) AS ground_speed, round(x, 4) AS cross_track_m, round(te, 8) AS track_error_rad, round(greatest(least(atan(pow(greatest(g, 1.0), 2) * kk / 9.80665::DOUBLE), 0.4), -0.4), 8) AS bank_rad FROM z"""
)
def lateral_commands(spark: SparkSession, d: str) -> DataFrame:
    """The bank that corrects a state beside its path, for every state of every customer's path."""
    k = F.col("o_orderkey")
    states = read(spark, d, "orders").select(F.col("o_custkey").alias("route_id"), k.alias("state_id"), (k + k % 4 / F.lit(7.0)).alias("s"), (k % 41 - 20).cast("double").alias("cross_track_m"), (k % 5 / F.lit(10.0)).alias("heading_offset_rad"), F.lit(80.0).alias("v_tas"), F.lit(0.4).alias("bank_limit"))
    placed = routes.on_path(path_samples(spark, d), states).drop("cross_track_m")
    return rounded(routes.lateral_command(placed, 3.0, -4.0), ["state_id"], {"ground_speed": 6, "cross_track_m": 4, "track_error_rad": 8, "bank_rad": 8})


# Paths of two waypoints: their smooth path is the line between them.

LINE = f"""route AS (SELECT c_custkey AS route_id, 33.0::DOUBLE + c_custkey % 40 * 0.01::DOUBLE AS lat0, -96.0::DOUBLE - c_custkey % 30 * 0.01::DOUBLE AS lon0, 32.5::DOUBLE AS lat1, -97.5::DOUBLE AS lon1 FROM customer),
plane AS (SELECT *, {R} * cos(radians(lat1)) * radians(lon0 - lon1) AS e0, {R} * radians(lat0 - lat1) AS n0 FROM route), span AS (SELECT *, sqrt(e0 * e0 + n0 * n0) AS len FROM plane),
sample AS (SELECT route_id, k::INT AS idx, len * (1.0 - k / 48.0::DOUBLE) AS s, e0 * (1.0 - k / 48.0::DOUBLE) AS e, n0 * (1.0 - k / 48.0::DOUBLE) AS n, lat1, lon1, atan2(-n0, -e0) AS track FROM span, range(49) r(k))"""


def line_waypoints(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    ends = F.array(F.struct(F.lit(1).alias("place"), F.lit("START").alias("identifier"), (k % 40 * 0.01 + 33.0).alias("lat"), (F.lit(-96.0) - k % 30 * 0.01).alias("lon")), F.struct(F.lit(2).alias("place"), F.lit("END").alias("identifier"), F.lit(32.5).alias("lat"), F.lit(-97.5).alias("lon")))
    return read(spark, d, "customer").select(k.alias("route_id"), F.inline(ends))


@query(f"WITH {LINE} SELECT route_id, idx, round(s, 4) AS s, round(e, 4) AS east_m, round(n, 4) AS north_m, round(lat1 + degrees(n / {R}), 8) AS lat, round(lon1 + degrees(e / ({R} * cos(radians(lat1)))), 8) AS lon, round(track, 8) AS track_rad, 0.0::DOUBLE AS curvature FROM sample")
def line_paths(spark: SparkSession, d: str) -> DataFrame:
    found = routes.reference_paths(line_waypoints(spark, d))
    level = rounded(found, ["route_id", "idx"], {"s": 4, "east_m": 4, "north_m": 4, "lat": 8, "lon": 8, "track_rad": 8, "curvature": 9})
    return level.withColumn("curvature", F.col("curvature") + 0.0)


@query(f"WITH {LINE} SELECT route_id, 'START' AS identifier, round(max(s), 4) AS s FROM sample GROUP BY 1 UNION ALL SELECT c_custkey, 'END', 0.0::DOUBLE FROM customer")
def line_distances(spark: SparkSession, d: str) -> DataFrame:
    return rounded(routes.waypoint_distances(line_waypoints(spark, d)), ["route_id", "identifier"], {"s": 4})


# Times and labels.


@query(
    """WITH o AS (SELECT o_orderkey AS k, o_orderdate::TIMESTAMP + to_seconds(43200 + o_custkey * 97 % 43200) AS ts FROM orders)
SELECT k AS o_orderkey, epoch(date_trunc('day', ts))::BIGINT AS day_start, CASE WHEN k % 2 = 0 THEN strftime(ts, '%Y-%m-%d') ELSE strftime(ts, '%Y-%m-%d') || '_to_' || strftime(ts + INTERVAL 1 DAY, '%Y-%m-%d') END || '_kabc' AS label,
  strftime(timezone('America/Chicago', ts::TIMESTAMPTZ), '%H:%M:%S') AS clock, epoch(timezone('America/Chicago', ts))::BIGINT AS utc_from, epoch(ts + INTERVAL 2 DAY)::BIGINT AS utc_to FROM o"""
)
def time_labels(spark: SparkSession, d: str) -> DataFrame:
    """Day starts, labels of date ranges, local clock times, and ranges given as local time and with an offset; afternoons, as engines part in the hour that occurs twice."""
    k = F.col("o_orderkey")
    own = read(spark, d, "orders").select(k, F.timestamp_seconds(F.unix_timestamp(F.col("o_orderdate").cast("timestamp")) + F.col("o_custkey") * 97 % 43_200 + 43_200).alias("ts"))
    text = F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    after = F.concat(F.date_format(F.col("ts") + F.expr("interval 2 day"), "yyyy-MM-dd HH:mm:ss"), F.lit("Z"))
    spans = own.withColumn("r", scalars.datetime_range(text, after, "America/Chicago"))
    return spans.select(k, scalars.day_start(F.col("ts")).alias("day_start"), scalars.range_label(F.col("ts"), F.col("ts") + F.when(k % 2 == 1, F.expr("interval 1 day")).otherwise(F.expr("interval 0 day")), F.lit("KABC")).alias("label"), scalars.local_clock(F.unix_timestamp("ts")).alias("clock"), F.unix_timestamp("r.utc_from").alias("utc_from"), F.unix_timestamp("r.utc_to").alias("utc_to"))


# Events, tracks and manifests.


@query(
    CLASSIFIED
    + """, a AS (SELECT b.*, e.lat AS event_lat, e.lon AS event_lon, e.geoaltitude AS event_alt, c.time AS ct, c.geoaltitude AS ca FROM best b JOIN ends USING (source_flight, segment) JOIN seg e ON e.source_flight = b.source_flight AND e.segment = b.segment AND e.rn = b.e JOIN seg c ON c.source_flight = b.source_flight AND c.segment = b.segment AND c.rn = CASE WHEN operation = 'arrival' THEN ends.a ELSE ends.z END)
SELECT '2024-01' AS date, s.flight_id, s.callsign, s.icao24, operation, runway, floor(te)::BIGINT AS event_time, strftime(make_timestamp(floor(te)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS event_time_utc, event_lat, event_lon, event_alt AS event_geoaltitude, place_lat AS threshold_lat, place_lon AS threshold_lon, de AS distance_to_threshold_m,
  floor(ct)::BIGINT AS comparison_time, strftime(make_timestamp(floor(ct)::BIGINT * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS comparison_time_utc, ca AS comparison_geoaltitude, round(delta, 3) AS distance_delta_m, round(CASE WHEN operation = 'arrival' THEN event_alt - ca ELSE ca - event_alt END, 6) AS altitude_delta_m FROM a JOIN seg s ON s.source_flight = a.source_flight AND s.segment = a.segment AND s.rn = 0"""
)
def threshold_events(spark: SparkSession, d: str) -> DataFrame:
    """The full record of every arrival and departure."""
    split = segments.split_by_gap(fixture.tracks(spark, d), fixture.GAP_S)
    every = split.select("source_flight", "segment", "flight_id", "callsign", "icao24").distinct()
    found = classify.events(classify.classify(segments.segment_rows(split), every, fixture.thresholds(spark)), "2024-01")
    return found.withColumns({"distance_delta_m": F.round("distance_delta_m", 3), "altitude_delta_m": F.round("altitude_delta_m", 6)})


@query(f"WITH {TRACKS} SELECT flight_id, ordinal FROM track WHERE lat BETWEEN 32.85 AND 33.0 AND lon BETWEEN -97.2 AND -96.9 AND ordinal % 31 <= 15")
def box_positions(spark: SparkSession, d: str) -> DataFrame:
    """Positions inside a box with a fresh contact."""
    seen = fixture.tracks(spark, d).withColumn("lastcontact", F.col("time") - F.col("ordinal") % 31)
    return segments.within_box(seen, -97.2, -96.9, 32.85, 33.0).select("flight_id", "ordinal")


@query(f"WITH {SPLIT} SELECT flight_id, segment, ordinal FROM seg WHERE source_flight = 'FL7a7' AND segment = 2")
def track_lookup(spark: SparkSession, d: str) -> DataFrame:
    """One segment of one flight, its address in any case."""
    return segments.flight_track(fixture.tracks(spark, d), "FL7", "A7", 2, fixture.GAP_S).select("flight_id", "segment", "ordinal")


@query(f"WITH {TRACKS} SELECT flight_id, ordinal FROM track ORDER BY ordinal LIMIT 500")
def first_positions(spark: SparkSession, d: str) -> DataFrame:
    return segments.first_rows(fixture.tracks(spark, d), 500).select("flight_id", "ordinal")


CLOCK = "strftime(timezone('America/Chicago', make_timestamp(floor({t})::BIGINT * 1000000)::TIMESTAMPTZ), '%H:%M:%S')"


@query(
    f"""WITH {TRACKS}, e AS (SELECT flight_id, arg_min(track, (time, ordinal)) AS a, arg_max(track, (time, ordinal)) AS z FROM track GROUP BY 1)
SELECT flight_id, {CLOCK.format(t="a.time")} || ' ' || coalesce(printf('%.0f m', a.geoaltitude), 'n/a') AS first_label, {CLOCK.format(t="z.time")} || ' ' || coalesce(printf('%.0f m', z.geoaltitude), 'n/a') AS last_label FROM e"""
)
def end_labels(spark: SparkSession, d: str) -> DataFrame:
    """First and last local time and height of each flight, as text."""
    return segments.labels(fixture.tracks(spark, d))


@query(f"WITH {PLANS}, c AS (SELECT o_orderkey AS plan_id, o_custkey % 5 + 1 AS m FROM orders) SELECT plan_id, idx, s FROM node JOIN c USING (plan_id) WHERE abs(idx - m) <= 1")
def plan_neighbourhood(spark: SparkSession, d: str) -> DataFrame:
    """Plan rows at most one place from a given one."""
    centre = read(spark, d, "orders").select(F.col("o_orderkey").alias("plan_id"), (F.col("o_custkey") % 5 + 1).alias("centre_idx"))
    return verify.around(fixture.plan_nodes(spark, d), centre, 1).select("plan_id", "idx", "s")


@query("SELECT o_orderkey AS plan_id, coalesce(o_orderstatus <> 'P' AND o_orderkey % 7 / 200.0::DOUBLE <= 0.02 AND o_custkey % 9 / 300.0::DOUBLE <= 0.02 AND o_orderkey % 11 * 60.0::DOUBLE <= 500.0, false) AS usable FROM orders")
def usable_plans(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    metrics = read(spark, d, "orders").select(k.alias("plan_id"), (F.col("o_orderstatus") != "P").alias("success"), (k % 7 / F.lit(200.0)).alias("max_slack"), (F.col("o_custkey") % 9 / F.lit(300.0)).alias("max_defect"), (k % 11 * 60.0).alias("replay_error"))
    return verify.usable(metrics).select("plan_id", "usable")


MADE = f"WITH {EVENTS}, made AS (SELECT flight_id, callsign, icao24, 'generated' AS status, event_time AS first_time, raw_point_count, raw_point_count // 2 AS compressed_point_count, NULL AS reason FROM ev JOIN tr USING (flight_id) WHERE operation = 'arrival'), left_ AS (SELECT flight_id, callsign, icao24, 'skipped' AS status, NULL AS first_time, 0 AS raw_point_count, 0 AS compressed_point_count, 'no trajectory' AS reason FROM ev WHERE operation = 'arrival' AND flight_id NOT IN (SELECT flight_id FROM tr)), every_ AS (SELECT * FROM made UNION ALL SELECT * FROM left_)"


def artifact_results(spark: SparkSession, d: str) -> DataFrame:
    arrivals = order_events(spark, d).where("operation = 'arrival'")
    paths = schedule.last_per_flight(order_trajectories(spark, d), "ordinal").select("flight_id", "raw_point_count")
    made = arrivals.join(paths, "flight_id").select("flight_id", "callsign", "icao24", F.lit("generated").alias("status"), F.col("event_time").alias("first_time"), "raw_point_count", F.expr("raw_point_count div 2").alias("compressed_point_count"))
    return made.unionByName(schedule.skipped(arrivals.join(paths, "flight_id", "left_anti"), "no trajectory"), allowMissingColumns=True)


@query(MADE + " SELECT count(*) FILTER (WHERE status = 'generated') AS generated_count, count(*) FILTER (WHERE status = 'skipped') AS skipped_count, coalesce(sum(raw_point_count) FILTER (WHERE status = 'generated'), 0)::BIGINT AS raw_points, coalesce(sum(compressed_point_count) FILTER (WHERE status = 'generated'), 0)::BIGINT AS compressed_points FROM every_")
def artifact_manifest(spark: SparkSession, d: str) -> DataFrame:
    return schedule.manifest(artifact_results(spark, d))


@query(MADE + " SELECT status, flight_id, first_time::BIGINT AS first_time, raw_point_count::BIGINT AS raw_point_count, compressed_point_count::BIGINT AS compressed_point_count, reason FROM every_")
def artifact_flights(spark: SparkSession, d: str) -> DataFrame:
    return schedule.manifest_flights(artifact_results(spark, d))


@query(f"WITH {EVENTS}, p AS (SELECT flight_id, max(operation) AS after FROM ev GROUP BY 1) SELECT sq.flight_id, sq.ordinal, coalesce(CASE WHEN after <> 'overflight' THEN after END, sq.fix_sequence) AS fix_sequence FROM sq LEFT JOIN p USING (flight_id)")
def patched_sequences(spark: SparkSession, d: str) -> DataFrame:
    """Sequences with the field that a log of interventions names."""
    log = order_events(spark, d).where("operation <> 'overflight'").select("flight_id", F.lit("fix_sequence").alias("field"), F.lit(None).cast("string").alias("before"), F.col("operation").alias("after"))
    rows = order_sequences(spark, d).select("flight_id", "ordinal", "fix_sequence")
    return schedule.apply_diff(rows, log.unionByName(schedule.intervention_diff(spark)))


# Compression: both kinds of breakpoints, split level by level in SQL.

SPANS = """{k}(flight_id, a, z) AS (
  SELECT flight_id, 1::BIGINT, max(i) FROM p GROUP BY 1
  UNION ALL
  SELECT w.flight_id, unnest([w.a, w.m]), unnest([w.m, w.z]) FROM (
    SELECT s.flight_id, s.a, s.z, arg_max(p.i, ({e}, -p.i)) AS m, max({e}) AS e
    FROM {k} s JOIN p ON p.flight_id = s.flight_id AND p.i > s.a AND p.i < s.z JOIN p q ON q.flight_id = s.flight_id AND q.i = s.a JOIN p r ON r.flight_id = s.flight_id AND r.i = s.z GROUP BY 1, 2, 3) w WHERE w.e > {tolerance})"""
ABOVE = "abs(p.y - (q.y + CASE WHEN r.t = q.t THEN 0.0 ELSE (r.y - q.y) / (r.t - q.t) END * (p.t - q.t)))"
ACROSS = "CASE WHEN sqrt((r.u - q.u) * (r.u - q.u) + (r.v - q.v) * (r.v - q.v)) = 0 THEN sqrt((p.u - q.u) * (p.u - q.u) + (p.v - q.v) * (p.v - q.v)) ELSE abs((r.u - q.u) * (p.v - q.v) - (r.v - q.v) * (p.u - q.u)) / sqrt((r.u - q.u) * (r.u - q.u) + (r.v - q.v) * (r.v - q.v)) END"


def masks_sql(points: str, high: str, side: str) -> str:
    """Kept points with their masks, from SQL of points: k (flight_id, callsign, icao24, ordinal, t, lat, lon, y)."""
    return f"""WITH RECURSIVE {points},
mean AS (SELECT flight_id, sum(round(lat * 1e7)::BIGINT) / count(*) / 1e7 AS lat0, sum(round(lon * 1e7)::BIGINT) / count(*) / 1e7 AS lon0 FROM k GROUP BY 1),
p AS (SELECT k.*, {R} * cos(radians(lat0)) * radians(lon - lon0) AS u, {R} * radians(lat - lat0) AS v, row_number() OVER (PARTITION BY k.flight_id ORDER BY t) AS i FROM k JOIN mean USING (flight_id)),
{SPANS.format(k="high", e=ABOVE, tolerance=high)}, {SPANS.format(k="side", e=ACROSS, tolerance=side)},
mark AS (SELECT flight_id, i, max(l) + max(h) AS mask FROM (SELECT flight_id, unnest([a, z]) AS i, 1 AS l, 0 AS h FROM side UNION ALL SELECT flight_id, unnest([a, z]), 0, 2 FROM high) GROUP BY 1, 2),
kept AS (SELECT p.*, mask::INT AS mask FROM mark JOIN p USING (flight_id, i))"""


MASKS = masks_sql(f"{TRACKS}, k AS (SELECT flight_id, callsign, icao24, ordinal, floor(time)::BIGINT AS t, lat, lon, geoaltitude AS y FROM track WHERE geoaltitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY flight_id, floor(time)::BIGINT ORDER BY ordinal DESC) = 1)", "600", "2000")
PAYLOADS = masks_sql(f"{RESAMPLED}, k AS (SELECT flight_id, callsign, 'abc' AS icao24, ordinal, time AS t, lat, lon, geoaltitude AS y FROM track)", "200", "2000")


@query(PAYLOADS + " SELECT flight_id, t AS time, lat, lon, y AS geoaltitude, mask FROM kept")
def payload_masks(spark: SparkSession, d: str) -> DataFrame:
    """Kept samples of every plan's payload with what they are breakpoints of."""
    return compress.compress(plan_payload_tracks(spark, d), 2000.0, 200.0)


@query(MASKS + " SELECT flight_id, t AS time, lat, lon, y AS geoaltitude, mask FROM kept")
def breakpoint_masks(spark: SparkSession, d: str) -> DataFrame:
    """Kept points of every flight with what they are breakpoints of."""
    return compress.compress(numbered_tracks(spark, d), 2000.0, 600.0)


@query(
    MASKS
    + """, a AS (SELECT flight_id, arg_min(callsign, (t, ordinal)) AS callsign, arg_min(icao24, (t, ordinal)) AS icao24, min(t) AS first_time, max(t) AS last_time, count(*) AS raw_point_count FROM k GROUP BY 1), b AS (SELECT flight_id, count(*) AS compressed_point_count, count(*) FILTER (WHERE mask & 1 > 0)::INT AS lateral_breakpoint_count, count(*) FILTER (WHERE mask & 2 > 0)::INT AS altitude_breakpoint_count FROM kept GROUP BY 1)
SELECT a.*, compressed_point_count, lateral_breakpoint_count, altitude_breakpoint_count, printf('%.6f', compressed_point_count / raw_point_count) AS compression_ratio FROM a JOIN b USING (flight_id)"""
)
def manifest_rows(spark: SparkSession, d: str) -> DataFrame:
    """The manifest of a compression run, read back from the flights' JSON lines."""
    whole = numbered_tracks(spark, d)
    flights = compress.compressed_flights(whole, compress.compress(whole, 2000.0, 600.0), 2000.0, 600.0)
    path = place(spark, "flights")
    sinks.json_lines(flights, path)
    return sinks.flight_manifest(spark.read.schema(flights.schema).json(path))


@query(MASKS + ", n AS (SELECT (SELECT count(DISTINCT flight_id) FROM k) AS flight_count, (SELECT count(*) FROM k) AS raw_point_count, (SELECT count(*) FROM kept) AS compressed_point_count) SELECT flight_count, raw_point_count, compressed_point_count, CASE WHEN raw_point_count = 0 THEN 0.0 ELSE compressed_point_count / raw_point_count END AS compression_ratio, 2000.0::DOUBLE AS lateral_tolerance_m, 600.0::DOUBLE AS altitude_tolerance_m FROM n")
def run_totals(spark: SparkSession, d: str) -> DataFrame:
    whole = numbered_tracks(spark, d)
    flights = compress.compressed_flights(whole, compress.compress(whole, 2000.0, 600.0), 2000.0, 600.0)
    return sinks.run_metadata(flights, 2000.0, 600.0).drop("json")


# Files: tables written as the formats that the readers take, by all tasks, and read back.


def csv_copy(df: DataFrame, name: str, header: bool = True) -> str:
    path = place(df.sparkSession, name)
    df.write.option("header", header).csv(path)
    return path


def numbered_files(spark: SparkSession, path: str) -> str:
    """Part files of a folder renamed to numbers, as hourly position files are named."""
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(f.getPath().getName() for f in store.listStatus(folder) if f.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):
        store.rename(jvm.org.apache.hadoop.fs.Path(f"{path}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{path}/{1700000000 + 3600 * k}.csv"))
    return path


@query(f"WITH {TRACKS} SELECT flight_id, callsign, icao24, floor(time) AS time, geoaltitude, heading FROM track")
def hourly_files(spark: SparkSession, d: str) -> DataFrame:
    """Positions written as headerless hourly files with untidy text, and read back by name, type and trimmed text."""
    rows = fixture.tracks(spark, d)
    raw = rows.select(F.floor("time").alias("time"), F.concat(F.lit(" "), "icao24"), "lat", "lon", "heading", F.concat("callsign", F.lit(" ")), "geoaltitude")
    found = files.require_tracks(files.tracks(spark, numbered_files(spark, csv_copy(raw, "hours", False))))
    return found.select("flight_id", "callsign", "icao24", "time", "geoaltitude", "heading")


@query(f"WITH {EVENTS} SELECT '2024' AS date, flight_id, callsign, icao24, operation, runway, event_time, event_time_utc FROM ev")
def event_files(spark: SparkSession, d: str) -> DataFrame:
    rows = order_events(spark, d).select(F.lit("2024").alias("date"), "flight_id", "callsign", "icao24", F.upper("operation").alias("operation"), F.concat(F.lit(" "), "runway").alias("runway"), "event_time", "event_time_utc")
    return files.events(spark, csv_copy(rows, "events"))


@query(f"WITH {EVENTS} SELECT flight_id, first_time::BIGINT AS first_time, last_time::BIGINT AS last_time, fix_sequence, fix_count::BIGINT AS fix_count FROM sq")
def sequence_files(spark: SparkSession, d: str) -> DataFrame:
    rows = order_sequences(spark, d).select(F.lit("2024").alias("date"), "flight_id", F.lit("c").alias("callsign"), F.lit("i").alias("icao24"), "first_time", "last_time", "fix_sequence", "fix_count")
    return files.fix_sequences(spark, csv_copy(rows, "sequences")).select("flight_id", "first_time", "last_time", "fix_sequence", "fix_count")


@query("SELECT concat('FX', s_suppkey) AS identifier, CASE WHEN s_suppkey % 3 = 0 THEN 'vor' ELSE 'waypoint' END AS fix_type, round(32.9157::DOUBLE + (s_suppkey * 7 % 97 - 48) * 0.004::DOUBLE, 9) AS place_lat, round(-97.026::DOUBLE + (s_suppkey * 11 % 89 - 44) * 0.005::DOUBLE, 9) AS place_lon FROM supplier WHERE s_suppkey % 5 > 1")
def fix_files(spark: SparkSession, d: str) -> DataFrame:
    """Waypoints and VORs of a written table; other types, and rows whose position is no number, are left out."""
    k = F.col("place_ord")
    rows = fixture.fixes(spark, d).select("identifier", F.when(k % 5 == 1, "ndb").when(k % 3 == 0, " VOR").otherwise("Waypoint").alias("fix_type"), F.when(k % 5 == 0, "x").otherwise(F.col("place_lat").cast("string")).alias("latitude_deg"), F.col("place_lon").alias("longitude_deg"))
    found = files.fixes(files.table(spark, csv_copy(rows, "fixes"), ["identifier", "fix_type", "latitude_deg", "longitude_deg"]))
    return found.withColumns({"place_lat": F.round("place_lat", 9), "place_lon": F.round("place_lon", 9)})


@query("SELECT concat('P', p_partkey % 500) AS identifier, arg_max(p_size::DOUBLE, p_partkey) AS latitude_deg, arg_max(p_retailprice::DOUBLE, p_partkey) AS longitude_deg, arg_max(CASE WHEN p_partkey % 2 = 0 THEN p_size::DOUBLE END, CASE WHEN p_partkey % 2 = 0 THEN p_partkey END) FILTER (WHERE last_) AS elevation_ft FROM (SELECT *, row_number() OVER (PARTITION BY p_partkey % 500 ORDER BY p_partkey DESC) = 1 AS last_ FROM part) GROUP BY 1")
def fix_catalog_files(spark: SparkSession, d: str) -> DataFrame:
    """Identifiers to positions, of several rows of a file the last."""
    k = F.col("p_partkey")
    rows = read(spark, d, "part").orderBy(k).coalesce(1).select(F.concat(F.lit("p"), k % 500, F.lit(" ")).alias("identifier"), F.col("p_size").alias("latitude_deg"), F.col("p_retailprice").alias("longitude_deg"), F.when(k % 2 == 0, F.col("p_size")).alias("elevation_ft"))
    return files.fix_catalog(files.table(spark, csv_copy(rows, "catalog"), ["identifier"]))


@query(f"WITH {EVENTS} SELECT operation AS flight_type, callsign, icao24, event_time::VARCHAR AS event_time FROM ev")
def authoritative_files(spark: SparkSession, d: str) -> DataFrame:
    """A catalog with its header among the rows."""
    rows = order_events(spark, d).select(F.col("operation").alias("flight_type"), "callsign", "icao24", "event_time")
    return files.authoritative_catalog(spark, csv_copy(rows, "authoritative"))


@query("SELECT concat('F', o_orderkey) AS flight_id, concat('C', o_custkey) AS callsign, o_custkey::INT AS raw_point_count, o_totalprice::DOUBLE AS lateral_tolerance_m, o_orderkey AS first_time FROM orders")
def flight_files(spark: SparkSession, d: str) -> DataFrame:
    """Compressed flights as JSON lines, read back with their schema."""
    k = F.col("o_orderkey")
    rows = read(spark, d, "orders").select(F.concat(F.lit("F"), k).alias("flight_id"), F.concat(F.lit("C"), "o_custkey").alias("callsign"), F.col("o_custkey").cast("int").alias("raw_point_count"), F.col("o_totalprice").cast("double").alias("lateral_tolerance_m"), k.alias("first_time"))
    path = place(spark, "flights")
    sinks.json_lines(rows, path)
    return files.compressed_flights(spark, path).select(*rows.columns)


@query("SELECT upper(concat('X', p_partkey)) AS fix_identifier, CASE WHEN p_size % 3 = 0 THEN p_size * 100.0 ELSE least(p_size * 100.0, 2500.0) END::DOUBLE AS lower_ft, CASE WHEN p_size % 3 = 0 THEN p_size * 100.0 ELSE greatest(p_size * 100.0, 2500.0) END::DOUBLE AS upper_ft FROM part WHERE p_brand = 'Brand#11'")
def altitude_constraints(spark: SparkSession, d: str) -> DataFrame:
    """Altitude bounds of one procedure's legs: one altitude fixes, two bound."""
    size = F.col("p_size") * 100
    rows = read(spark, d, "part").select(F.lower("p_brand").alias("sid_star_approach_identifier"), F.lit(" ALL").alias("padded"), F.lit("ALL").alias("transition_identifier"), F.concat(F.lit("x"), F.col("p_partkey").cast("string")).alias("fix_identifier"), F.lpad(size.cast("string"), 5, "0").alias("altitude"), F.when(F.col("p_size") % 3 != 0, "02500").alias("altitude_2"))
    found = profiles.constraints_by_fix(rows, "BRAND#11", "all")
    return found.select("fix_identifier", F.col("lower_ft").cast("double").alias("lower_ft"), F.col("upper_ft").cast("double").alias("upper_ft"))


#: The manifest of the compression run is the same table, whether it is read back or not.
ORACLES["compression_manifest"] = ORACLES["manifest_rows"]
