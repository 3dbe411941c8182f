"""Every operator as a query over the driver's tables, with the DuckDB SQL that gives the same rows.

Distances are rounded to the millimetre before they are compared, in both engines.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import flight, geo, scalars
from trackloom.operators import catalog, classify, compress, nav, profiles, proximity, routes, schedule, segments, verify
from trackloom.plans import fixture
from trackloom.plans.fixture import read
from trackloom.shared import place, written
from trackloom.sources import sinks
from trackloom.streaming import tracks as streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# SQL pieces that several oracles share.
LINES = "(SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag)::INT AS l_linenumber, l_partkey, l_suppkey, l_quantity, l_discount, l_tax, l_returnflag FROM lineitem)"
TRACKS = """track AS (
  SELECT concat('FL', user_id, 'a', user_id) AS flight_id, concat('FL', user_id) AS callsign, concat('a', user_id) AS icao24,
    epoch_us(ts) / 1e6::DOUBLE AS time, 32.9157::DOUBLE + (event_id % 97 - 48) * 0.004::DOUBLE AS lat, -97.026::DOUBLE + (event_id % 89 - 44) * 0.005::DOUBLE AS lon,
    CASE WHEN event_id % 53 <> 0 THEN value * 20 END AS geoaltitude, ((event_id * 7) % 360)::DOUBLE AS heading, event_id AS ordinal
  FROM events)"""
SPLIT = (
    TRACKS
    + """, gaps AS (
  SELECT *, CASE WHEN time - lag(time) OVER w > 28800 THEN 1 ELSE 0 END AS opened FROM track WINDOW w AS (PARTITION BY flight_id ORDER BY time, ordinal)),
split AS (
  SELECT * EXCLUDE (opened, flight_id, callsign), flight_id AS source_flight, (1 + sum(opened) OVER (PARTITION BY flight_id ORDER BY time, ordinal ROWS UNBOUNDED PRECEDING))::INT AS segment, callsign AS base FROM gaps),
seg AS (
  SELECT *, concat(base, 'M', segment) AS callsign, concat(base, 'M', segment, icao24) AS flight_id, row_number() OVER (PARTITION BY source_flight, segment ORDER BY time, ordinal) - 1 AS rn FROM split)"""
)
RUNWAYS = "runway(place_ord, runway, place_lat, place_lon) AS (VALUES " + ", ".join(f"({o}, '{n}', {a}::DOUBLE, {b}::DOUBLE)" for o, n, a, b in fixture.RUNWAYS) + ")"
FIXES = """fix AS (
  SELECT concat('FX', s_suppkey) AS identifier, s_suppkey AS place_ord, 32.9157::DOUBLE + (s_suppkey * 7 % 97 - 48) * 0.004::DOUBLE AS place_lat,
    -97.026::DOUBLE + (s_suppkey * 11 % 89 - 44) * 0.005::DOUBLE AS place_lon FROM supplier)"""
LEGS = f"""leg AS (
  SELECT l_orderkey * 1000 + l_linenumber AS line_no, ['PD', 'PE', 'PF'][(l_orderkey // 10 % 3 + 1)::INT] AS section_code, concat('P', l_orderkey) AS proc, concat('T', l_orderkey % 7) AS trans,
    l_linenumber * 10 AS seq, CASE WHEN l_partkey % 11 <> 0 THEN concat('X', l_partkey % 40) END AS fix
  FROM {LINES})"""
PLANS = f"""node AS (
  SELECT l_orderkey AS plan_id, l_linenumber AS idx, l_linenumber * 4000.0::DOUBLE AS s, l_linenumber * 250.0::DOUBLE + l_quantity AS h, 70.0::DOUBLE + l_linenumber * 8.0::DOUBLE + l_discount * 10 AS v,
    l_linenumber * 45.0::DOUBLE + l_tax AS t, -0.02::DOUBLE - l_tax / 10 AS gamma, 9000.0::DOUBLE + l_quantity * 100 AS thrust,
    CASE WHEN l_linenumber <= 3 THEN 'final' WHEN l_quantity > 25 THEN 'approach' ELSE 'clean' END AS phase
  FROM {LINES})"""


def hav(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin((radians({c}) - radians({a})) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin((radians({d}) - radians({b})) / 2), 2))"
    return f"round(6371000.0::DOUBLE * 2 * atan2(sqrt({x}), sqrt(1 - {x})), 3)"


NEAR = hav("p.lat", "p.lon", "r.place_lat", "r.place_lon")
RHO = "(101325.0::DOUBLE * pow(greatest(288.15::DOUBLE - 0.0065::DOUBLE * greatest({h}, 0.0), 1.0) / 288.15::DOUBLE, 9.80665::DOUBLE / (287.05287::DOUBLE * 0.0065::DOUBLE)) / (287.05287::DOUBLE * greatest(288.15::DOUBLE - 0.0065::DOUBLE * greatest({h}, 0.0) + {d}, 1.0)))"


def query(oracle: str | None = None):
    """Registers a query under its function's name, and its SQL if there is one."""

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = oracle
        return f

    return put


def rows_of(spark: SparkSession, d: str) -> DataFrame:
    return segments.segment_rows(segments.split_by_gap(fixture.tracks(spark, d), fixture.GAP_S))


def classified(spark: SparkSession, d: str) -> DataFrame:
    rows = rows_of(spark, d)
    every = rows.where("rn = 0").select("source_flight", "segment", "flight_id", "callsign", "icao24")
    return classify.classify(rows, every, fixture.thresholds(spark))


CLASSIFIED = f"""WITH {SPLIT}, {RUNWAYS},
pair AS (SELECT p.source_flight, p.segment, p.rn, p.time, p.geoaltitude, r.place_ord, r.runway, r.place_lat, r.place_lon, {NEAR} AS d FROM seg p, runway r),
hit AS (SELECT * FROM pair WHERE d <= 5000 AND geoaltitude <= 3048),
ev AS (SELECT source_flight, segment, place_ord, runway, place_lat, place_lon, min(rn) AS e, arg_min(d, rn) AS de, arg_min(time, rn) AS te FROM hit GROUP BY ALL),
ends AS (SELECT source_flight, segment, min(rn) AS a, max(rn) AS z FROM seg GROUP BY ALL),
cand AS (
  SELECT ev.*, x.d - ev.de AS approach, y.d - ev.de AS leave FROM ev JOIN ends USING (source_flight, segment)
  JOIN pair x ON x.source_flight = ev.source_flight AND x.segment = ev.segment AND x.place_ord = ev.place_ord AND x.rn = a
  JOIN pair y ON y.source_flight = ev.source_flight AND y.segment = ev.segment AND y.place_ord = ev.place_ord AND y.rn = z),
best AS (
  SELECT *, CASE WHEN approach >= leave THEN 'arrival' ELSE 'departure' END AS operation, CASE WHEN approach >= leave THEN -approach ELSE leave END AS delta
  FROM cand WHERE greatest(approach, leave) >= 500
  QUALIFY row_number() OVER (PARTITION BY source_flight, segment ORDER BY abs(CASE WHEN approach >= leave THEN -approach ELSE leave END) DESC, de, place_ord) = 1),
close AS (SELECT DISTINCT source_flight, segment FROM hit),
labelled AS (
  SELECT s.flight_id, coalesce(b.operation, CASE WHEN c.segment IS NOT NULL THEN 'unclassified' ELSE 'overflight' END) AS classification, b.runway, b.te AS event_time, b.de AS distance_m, round(b.delta, 3) AS distance_delta_m
  FROM seg s LEFT JOIN best b USING (source_flight, segment) LEFT JOIN close c USING (source_flight, segment) WHERE s.rn = 0)
"""


@query(CLASSIFIED + "SELECT * FROM labelled")
def classify_segments(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).select("flight_id", "classification", "runway", F.col("event.time").alias("event_time"), F.col("event.distance_m").alias("distance_m"), F.round("distance_delta_m", 3).alias("distance_delta_m"))


@query(CLASSIFIED + "SELECT classification, count(*) AS segments FROM labelled GROUP BY 1")
def classification_counts(spark: SparkSession, d: str) -> DataFrame:
    return classified(spark, d).groupBy("classification").agg(F.count("*").alias("segments"))


@query(f"WITH {TRACKS} SELECT flight_id, time, ordinal FROM track QUALIFY time = max(time) OVER (PARTITION BY floor(time / 60))")
def latest_per_minute(spark: SparkSession, d: str) -> DataFrame:
    return segments.latest_per_minute(fixture.tracks(spark, d)).select("flight_id", "time", "ordinal")


@query(f"WITH {TRACKS} SELECT flight_id, floor(time)::BIGINT AS time, ordinal, geoaltitude FROM track WHERE geoaltitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY flight_id, floor(time)::BIGINT ORDER BY ordinal DESC) = 1")
def dedup_keep_last(spark: SparkSession, d: str) -> DataFrame:
    return segments.keep_last(fixture.tracks(spark, d)).select("flight_id", "time", "ordinal", "geoaltitude")


@query(f"WITH {SPLIT} SELECT flight_id, callsign, segment, ordinal FROM seg")
def gap_split(spark: SparkSession, d: str) -> DataFrame:
    return segments.split_by_gap(fixture.tracks(spark, d), fixture.GAP_S).select("flight_id", "callsign", "segment", "ordinal")


@query(
    f"""WITH {SPLIT}, {FIXES},
hit AS (SELECT p.source_flight, p.segment, p.rn, r.identifier FROM seg p, fix r WHERE {NEAR} <= 2000 QUALIFY row_number() OVER (PARTITION BY p.source_flight, p.segment, p.rn ORDER BY {NEAR}, r.place_ord) = 1),
joined AS (SELECT s.*, h.identifier, lag(h.identifier) OVER (PARTITION BY s.source_flight, s.segment ORDER BY s.rn) AS last FROM seg s LEFT JOIN hit h USING (source_flight, segment, rn))
SELECT flight_id, callsign, icao24, min(time) AS first_time, max(time) AS last_time,
  coalesce(string_agg(identifier, '>' ORDER BY rn) FILTER (identifier IS NOT NULL AND identifier IS DISTINCT FROM last), '') AS fix_sequence, (count(*) FILTER (identifier IS NOT NULL AND identifier IS DISTINCT FROM last))::INT AS fix_count
FROM joined GROUP BY flight_id, callsign, icao24"""
)
def nearest_fix_sequence(spark: SparkSession, d: str) -> DataFrame:
    return proximity.fix_sequences(rows_of(spark, d), fixture.fixes(spark, d))


@query(f"WITH {TRACKS}, {RUNWAYS} SELECT flight_id, arg_min(runway, (d, place_ord)) AS runway, min(d) AS distance_m FROM (SELECT p.flight_id, r.runway, r.place_ord, {NEAR} AS d FROM track p, runway r) GROUP BY 1")
def nearest_threshold(spark: SparkSession, d: str) -> DataFrame:
    return proximity.nearest_threshold(fixture.tracks(spark, d), fixture.thresholds(spark))


@query(f"WITH {TRACKS} SELECT min(time) AS first_time, max(time) AS last_time, count(DISTINCT flight_id) AS flights FROM track")
def track_bounds(spark: SparkSession, d: str) -> DataFrame:
    return segments.bounds(fixture.tracks(spark, d))


@query(f"WITH {TRACKS} SELECT flight_id, arg_min(callsign, (time, ordinal)) AS callsign, arg_min(icao24, (time, ordinal)) AS icao24, count(*)::INT AS point_count, string_agg(ordinal::VARCHAR, ',' ORDER BY time, ordinal) AS points FROM track GROUP BY 1")
def flight_tasks(spark: SparkSession, d: str) -> DataFrame:
    tasks = segments.flight_tasks(fixture.tracks(spark, d))
    return tasks.withColumn("points", F.array_join(F.transform("points", lambda p: p["ordinal"].cast("string")), ","))


@query(
    f"""WITH {TRACKS}, m AS (SELECT *, avg(lat) OVER (PARTITION BY flight_id) AS a, avg(lon) OVER (PARTITION BY flight_id) AS b FROM track)
SELECT ordinal, round(6371000.0::DOUBLE * cos(radians(a)) * radians(lon - b), 2) AS x_m, round(6371000.0::DOUBLE * radians(lat - a), 2) AS y_m FROM m"""
)
def local_projection(spark: SparkSession, d: str) -> DataFrame:
    return segments.local_plane(fixture.tracks(spark, d)).select("ordinal", F.round("x_m", 2).alias("x_m"), F.round("y_m", 2).alias("y_m"))


@query(
    f"""WITH {TRACKS}, w AS (SELECT flight_id, min(time) AS time FROM track GROUP BY 1),
r AS (SELECT *, lead({{'time': time, 'lat': lat, 'lon': lon}}) OVER o AS n, lag({{'time': time, 'lat': lat, 'lon': lon}}) OVER o AS b, row_number() OVER (PARTITION BY flight_id, time ORDER BY ordinal) AS k FROM track WINDOW o AS (PARTITION BY flight_id ORDER BY time, ordinal)),
o AS (SELECT r.*, coalesce(n, b) AS q FROM r JOIN w USING (flight_id, time) WHERE k = 1),
g AS (SELECT flight_id, time, ordinal, heading, 6371000.0::DOUBLE * sqrt(pow(radians(q.lon - lon) * cos(radians((lat + q.lat) / 2)), 2) + pow(radians(q.lat - lat), 2)) / nullif(abs(q.time - time), 0) AS v FROM o)
SELECT flight_id, time, heading, round(v, 6) AS ground_speed_mps FROM g WHERE v > 1"""
)
def seed_state(spark: SparkSession, d: str) -> DataFrame:
    t = fixture.tracks(spark, d)
    wanted = t.groupBy("flight_id").agg(F.min("time").alias("first_time"))
    return segments.seeds(t, wanted).select("flight_id", "time", "heading", F.round("ground_speed_mps", 6).alias("ground_speed_mps"))


@query(f"WITH {SPLIT} SELECT DISTINCT source_flight FROM seg WHERE segment = 2 AND source_flight IN (SELECT concat('FL', o_custkey, 'a', o_custkey) FROM orders WHERE lower(trim(concat(' ', CASE WHEN o_orderstatus = 'F' THEN 'Arrival' WHEN o_orderstatus = 'O' THEN 'DEPARTURE' ELSE 'overflight' END, ' '))) IN ('arrival', 'departure'))")
def filter_to_catalog(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    kind = F.when(F.col("o_orderstatus") == "F", " Arrival ").when(F.col("o_orderstatus") == "O", " DEPARTURE ").otherwise(" overflight ")
    wanted = segments.arrival_departure_flights(o.select(F.concat(F.lit("FL"), F.col("o_custkey").cast("string"), F.lit("a"), F.col("o_custkey").cast("string")).alias("flight_id"), kind.alias("operation")))
    kept = segments.only_flights(fixture.tracks(spark, d), wanted)
    return segments.split_by_gap(kept, fixture.GAP_S).where("segment = 2").select("source_flight").distinct()


# Catalogs: flights from orders.


def order_flights(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    day = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    sign = F.when(F.col("o_orderkey") % 17 != 0, F.concat(F.lit(" OR"), (F.col("o_custkey") % 500).cast("string"), F.lit(" "))).otherwise(" ")
    place = lambda k: F.when(F.col("o_orderkey") % k == 0, "HOME").otherwise("AWAY")
    return o.select(sign.alias("callsign"), F.concat(F.lit("c"), (F.col("o_custkey") % 300).cast("string")).alias("icao24"), day.alias("firstseen"), F.when(F.col("o_orderkey") % 13 != 0, day + 3600).alias("lastseen"), place(2).alias("origin"), place(3).alias("destination"))


FLIGHTS = """flight AS (
  SELECT CASE WHEN o_orderkey % 17 <> 0 THEN concat(' OR', o_custkey % 500, ' ') ELSE ' ' END AS callsign, concat('c', o_custkey % 300) AS icao24, epoch(o_orderdate)::BIGINT AS firstseen,
    CASE WHEN o_orderkey % 13 <> 0 THEN epoch(o_orderdate)::BIGINT + 3600 END AS lastseen, CASE WHEN o_orderkey % 2 = 0 THEN 'HOME' ELSE 'AWAY' END AS origin, CASE WHEN o_orderkey % 3 = 0 THEN 'HOME' ELSE 'AWAY' END AS destination
  FROM orders),
cat AS (
  SELECT DISTINCT 'arrival' AS flight_type, trim(callsign) AS callsign, trim(icao24) AS icao24, lastseen AS event_time FROM flight WHERE destination = 'HOME' AND lastseen IS NOT NULL AND trim(callsign) <> '' AND trim(icao24) <> ''
  UNION ALL
  SELECT DISTINCT 'departure', trim(callsign), trim(icao24), firstseen FROM flight WHERE origin = 'HOME' AND firstseen IS NOT NULL AND trim(callsign) <> '' AND trim(icao24) <> '')"""


@query(f"WITH {FLIGHTS} SELECT * FROM cat")
def authoritative_union(spark: SparkSession, d: str) -> DataFrame:
    return catalog.authoritative(order_flights(spark, d), "HOME")


@query(
    f"""WITH {FLIGHTS}, one AS (SELECT *, concat(callsign, icao24) AS flight_id FROM cat QUALIFY row_number() OVER (PARTITION BY flight_type, concat(callsign, icao24) ORDER BY callsign, icao24, event_time) = 1)
SELECT flight_type, callsign, icao24, event_time, flight_id, strftime(make_timestamp(event_time * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS event_time_utc FROM one WHERE event_time BETWEEN 800000000 AND 850000000"""
)
def catalog_pruned(spark: SparkSession, d: str) -> DataFrame:
    one = catalog.pruned(catalog.cleaned(catalog.authoritative(order_flights(spark, d), "HOME")), 800_000_000, 850_000_000)
    return one.withColumn("event_time_utc", scalars.iso_utc(F.col("event_time")))


@query(
    f"""WITH {FLIGHTS}, one AS (SELECT DISTINCT concat_ws('|', flight_type, regexp_replace(callsign, 'M[0-9]+$', ''), lower(icao24)) AS k FROM cat),
other AS (SELECT DISTINCT concat_ws('|', CASE WHEN c_custkey % 2 = 0 THEN 'arrival' ELSE 'departure' END, regexp_replace(concat('OR', c_custkey % 500, 'M', c_custkey % 3), 'M[0-9]+$', ''), lower(concat('C', c_custkey % 300))) AS k FROM customer),
both_ AS (SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'authoritative only' WHEN a.k IS NULL THEN 'derived only' ELSE 'shared' END AS side FROM one a FULL JOIN other b ON a.k = b.k),
n AS (SELECT side, count(*) AS keys FROM both_ GROUP BY 1), ex AS (SELECT side, string_agg(k, ',' ORDER BY k) AS examples FROM (SELECT * FROM both_ WHERE side <> 'shared' QUALIFY row_number() OVER (PARTITION BY side ORDER BY k) <= 5) GROUP BY 1)
SELECT n.side, keys, coalesce(examples, '') AS examples FROM n LEFT JOIN ex USING (side)"""
)
def catalog_diff(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    derived = read(spark, d, "customer").select(F.when(k % 2 == 0, "arrival").otherwise("departure").alias("operation"), F.concat(F.lit("OR"), (k % 500).cast("string"), F.lit("M"), (k % 3).cast("string")).alias("callsign"), F.concat(F.lit("C"), (k % 300).cast("string")).alias("icao24"))
    return catalog.difference(derived, catalog.authoritative(order_flights(spark, d), "HOME"))


# Schedules: events from orders, sequences and trajectories from customers.


def order_events(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    time = F.unix_timestamp(F.col("o_orderdate").cast("timestamp"))
    return o.select(
        F.concat(F.lit("F"), F.col("o_orderkey").cast("string")).alias("flight_id"), F.concat(F.lit("C"), F.col("o_custkey").cast("string")).alias("callsign"), F.lit("abc").alias("icao24"),
        F.when(F.col("o_orderkey") % 3 == 0, "arrival").when(F.col("o_orderkey") % 3 == 1, "departure").otherwise("overflight").alias("operation"), F.col("o_orderpriority").alias("runway"), time.alias("event_time"), scalars.iso_utc(time).alias("event_time_utc"),
    )


def order_sequences(spark: SparkSession, d: str) -> DataFrame:
    line = fixture.lines(spark, d).where("l_returnflag <> 'N'")
    return line.select(F.concat(F.lit("F"), F.col("l_orderkey").cast("string")).alias("flight_id"), F.col("l_partkey").alias("first_time"), (F.col("l_partkey") + 60).alias("last_time"), F.concat(F.lit("A>"), F.col("l_returnflag")).alias("fix_sequence"), F.lit(2).alias("fix_count"), F.col("l_linenumber").alias("ordinal"))


def order_trajectories(spark: SparkSession, d: str) -> DataFrame:
    line = fixture.lines(spark, d).where("l_tax > 0.02")
    return line.select(F.concat(F.lit("F"), F.col("l_orderkey").cast("string")).alias("flight_id"), F.col("l_suppkey").alias("raw_point_count"), F.col("l_linenumber").alias("ordinal"))


EVENTS = f"""ev AS (
  SELECT concat('F', o_orderkey) AS flight_id, concat('C', o_custkey) AS callsign, 'abc' AS icao24, CASE o_orderkey % 3 WHEN 0 THEN 'arrival' WHEN 1 THEN 'departure' ELSE 'overflight' END AS operation, o_orderpriority AS runway,
    epoch(o_orderdate)::BIGINT AS event_time, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS event_time_utc FROM orders),
sq AS (SELECT concat('F', l_orderkey) AS flight_id, l_partkey AS first_time, l_partkey + 60 AS last_time, concat('A>', l_returnflag) AS fix_sequence, 2 AS fix_count, l_linenumber AS ordinal FROM {LINES} WHERE l_returnflag <> 'N'),
tr AS (SELECT concat('F', l_orderkey) AS flight_id, l_suppkey AS raw_point_count FROM {LINES} WHERE l_tax > 0.02 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC) = 1)"""


@query(f"WITH {EVENTS} SELECT flight_id, callsign, icao24, event_time AS departure_time, event_time_utc AS departure_time_utc, runway FROM ev WHERE operation = 'departure'")
def departure_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedule.departures(order_events(spark, d))


@query(f"WITH {EVENTS} SELECT flight_id, event_time, first_time, last_time, fix_sequence, fix_count FROM ev LEFT JOIN sq USING (flight_id) WHERE operation = 'arrival'")
def arrivals_left_join(spark: SparkSession, d: str) -> DataFrame:
    return schedule.arrivals_with_sequences(order_events(spark, d), order_sequences(spark, d)).select("flight_id", "event_time", "first_time", "last_time", "fix_sequence", "fix_count")


@query(
    f"""WITH {EVENTS}, one AS (SELECT * FROM sq QUALIFY row_number() OVER (PARTITION BY flight_id ORDER BY ordinal DESC) = 1)
SELECT flight_id, callsign, icao24, first_time AS arrival_time, strftime(make_timestamp(first_time * 1000000), '%Y-%m-%dT%H:%M:%SZ') AS arrival_time_utc, runway, fix_sequence AS original_fix_sequence, fix_count AS original_fix_count, raw_point_count
FROM ev JOIN one USING (flight_id) JOIN tr USING (flight_id) WHERE operation = 'arrival'"""
)
def arrival_schedule(spark: SparkSession, d: str) -> DataFrame:
    return schedule.arrivals(order_events(spark, d), order_sequences(spark, d), order_trajectories(spark, d))


@query(
    f"""WITH {EVENTS}, a AS (SELECT DISTINCT flight_id FROM ev WHERE operation = 'arrival'), p AS (SELECT DISTINCT flight_id FROM ev WHERE operation = 'departure')
SELECT (SELECT count(*) FROM ev) AS events_count, (SELECT count(*) FROM ev WHERE operation = 'arrival') AS arrivals_count, (SELECT count(*) FROM ev WHERE operation = 'departure') AS departures_count, (SELECT count(DISTINCT flight_id) FROM sq) AS fix_sequences_count,
  (SELECT count(DISTINCT flight_id) FROM tr) AS compressed_flights_count, (SELECT count(*) FROM a WHERE flight_id NOT IN (SELECT flight_id FROM sq)) AS arrivals_missing_fix_sequences_count,
  (SELECT count(*) FROM a WHERE flight_id NOT IN (SELECT flight_id FROM tr)) AS arrivals_missing_trajectories_count, (SELECT count(*) FROM p WHERE flight_id NOT IN (SELECT flight_id FROM tr)) AS departures_missing_trajectories_count, (SELECT count(*) FROM p) AS skipped_departures_count"""
)
def health_metrics(spark: SparkSession, d: str) -> DataFrame:
    return schedule.health(order_events(spark, d), order_sequences(spark, d), order_trajectories(spark, d))


# Procedures.


@query(f"WITH {LEGS}, o AS (SELECT *, lag(fix) OVER (PARTITION BY section_code, proc, trans ORDER BY seq, line_no) AS b FROM leg) SELECT DISTINCT b AS from_fix, fix AS to_fix FROM o WHERE b IS NOT NULL AND fix IS NOT NULL")
def adjacent_links(spark: SparkSession, d: str) -> DataFrame:
    return nav.links(fixture.legs(spark, d))


def scope(spark: SparkSession) -> DataFrame:
    return spark.range(0, 40).where("id % 4 <> 0").select(F.concat(F.lit("X"), F.col("id").cast("string")).alias("identifier"))


RUNS = f"""WITH {LEGS}, f AS (SELECT *, coalesce(substr(fix, 2)::INT % 4 <> 0, false) AS inside, min(line_no) OVER (PARTITION BY section_code, proc, trans) AS g FROM leg),
i AS (SELECT *, sum(CASE WHEN inside THEN 0 ELSE 1 END) OVER (PARTITION BY section_code, proc, trans ORDER BY seq, line_no ROWS UNBOUNDED PRECEDING) AS island FROM f),
r AS (SELECT *, row_number() OVER (PARTITION BY g, island ORDER BY seq, line_no) AS place, count(*) OVER (PARTITION BY g, island) AS n FROM i WHERE inside),
run AS (SELECT * FROM r WHERE n >= 2)
"""


@query(RUNS + "SELECT line_no, proc AS procedure_id, fix AS fix_identifier, printf('%03d', place * 10) AS sequence_number FROM run")
def scoped_runs(spark: SparkSession, d: str) -> DataFrame:
    return nav.scoped_runs(fixture.legs(spark, d), scope(spark), nav.GROUP).select("line_no", F.col("sid_star_approach_identifier").alias("procedure_id"), "fix_identifier", "sequence_number")


@query(
    RUNS
    + """, o AS (SELECT *, lag(fix) OVER (PARTITION BY g, island ORDER BY place) AS b FROM run), p AS (SELECT DISTINCT g, island, b, fix FROM o WHERE b IS NOT NULL), base AS (SELECT b, fix FROM p WHERE g % 97 = 0),
w AS (SELECT b, fix, min((g, island)) AS k FROM p GROUP BY 1, 2) SELECT k[1] AS group_line, count(*) AS new_links FROM w WHERE (b, fix) NOT IN (SELECT (b, fix) FROM base) GROUP BY k, k[1]"""
)
def supplement_links(spark: SparkSession, d: str) -> DataFrame:
    runs = nav.scoped_runs(fixture.legs(spark, d), scope(spark), nav.GROUP)
    base = nav.links(runs.where("run.group_line % 97 = 0").withColumn("g", F.col("run").cast("string")), ["g"])
    return nav.supplement(runs, base).select(F.col("run.group_line").alias("group_line"), "new_links")


@query(f"WITH {LEGS}, u AS (SELECT line_no, trans AS token FROM leg UNION SELECT line_no, fix FROM leg WHERE fix IS NOT NULL) SELECT token, count(*) AS uses FROM u GROUP BY 1")
def reference_tokens(spark: SparkSession, d: str) -> DataFrame:
    return nav.reference_tokens(fixture.legs(spark, d))


def record_lines(spark: SparkSession, d: str) -> DataFrame:
    """Navigation records of all kinds, one per supplier and part."""
    pad = lambda c, n: F.rpad(c, n, " ")
    coordinates = lambda k: F.concat(F.lit("N32"), F.format_string("%02d%02d%02d", k % 60, k * 7 % 60, k * 3 % 100), F.lit("W097"), F.format_string("%02d%02d%02d", k * 5 % 60, k * 11 % 60, k % 100))
    key = F.col("s_suppkey")
    kind = key % 4
    name = F.concat(F.lit("N"), (key % 60).cast("string"))
    runway = F.concat(F.lit("RW"), F.format_string("%02d", key % 36))
    home = F.when(key % 3 == 0, "KAAA").otherwise("KBBB")
    head = F.when(kind == 0, F.concat(F.lit("SUSAP "), home, F.lit("K4C"), pad(name, 19))).when(kind == 1, F.concat(F.lit("SUSAEAENRT   "), pad(name, 19))).when(kind == 2, F.concat(F.lit("SUSAD        "), pad(name, 19))).otherwise(F.concat(F.lit("SUSAP "), home, F.lit("K4G"), pad(runway, 19)))
    points = read(spark, d, "supplier").select((key * 2).alias("line_no"), F.concat(head, coordinates(key), F.lit("         +01441"), F.format_string("%05d", key % 2000), pad(F.lit(""), 40)).alias("line"))
    p = F.col("p_partkey")
    fix = F.when(p % 5 == 0, F.concat(F.lit("RW"), F.format_string("%02d", p % 40))).otherwise(F.concat(F.lit("N"), (p % 70).cast("string")))
    leg = F.concat(F.lit("SUSAP KAAAK4"), F.element_at(F.array(F.lit("D"), F.lit("E"), F.lit("F")), (p % 3 + 1).cast("int")), pad(F.concat(F.lit("Q"), (p % 50).cast("string")), 6), F.lit("4"), pad(F.concat(F.lit("N"), (p % 45).cast("string")), 5), F.lit(" "), F.format_string("%03d", p % 20 * 10), pad(fix, 5), F.lit("K4PC0"), pad(F.lit(""), 60))
    legs = read(spark, d, "part").select((p * 2 + 1_000_001).alias("line_no"), leg.alias("line"))
    return points.unionByName(legs)


def resolved(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    parsed = nav.parse(record_lines(spark, d))
    return nav.resolve(nav.reference_tokens(nav.legs(parsed, "KAAA")), parsed, "KAAA"), parsed


RESOLVED = """WITH pt AS (
  SELECT s_suppkey AS n, s_suppkey % 4 AS kind, CASE WHEN s_suppkey % 4 = 3 THEN printf('RW%02d', s_suppkey % 36) ELSE concat('N', s_suppkey % 60) END AS ident, CASE WHEN s_suppkey % 4 IN (0, 3) THEN CASE WHEN s_suppkey % 3 = 0 THEN 'KAAA' ELSE 'KBBB' END END AS ap,
    printf('N32%02d%02d%02d', s_suppkey % 60, s_suppkey * 7 % 60, s_suppkey * 3 % 100) AS la, printf('W097%02d%02d%02d', s_suppkey * 5 % 60, s_suppkey * 11 % 60, s_suppkey % 100) AS lo, printf('%05d', s_suppkey % 2000) AS el
  FROM supplier),
lg AS (SELECT p_partkey AS n, concat('N', p_partkey % 45) AS tr, CASE WHEN p_partkey % 5 = 0 THEN printf('RW%02d', p_partkey % 40) ELSE concat('N', p_partkey % 70) END AS fx FROM part),
tok AS (SELECT token, count(*) AS uses FROM (SELECT n, tr AS token FROM lg UNION SELECT n, fx FROM lg) GROUP BY 1),
op AS (
  SELECT ident, 0 AS pr, 'runway' AS ty, 'PG' AS sc, ap, la, lo, el FROM pt WHERE kind = 3 AND ap = 'KAAA' QUALIFY row_number() OVER (PARTITION BY ident ORDER BY n DESC) = 1
  UNION ALL SELECT ident, 1, 'waypoint', 'PC', ap, la, lo, NULL FROM pt WHERE kind = 0 AND ap = 'KAAA' QUALIFY row_number() OVER (PARTITION BY ident ORDER BY n DESC) = 1
  UNION ALL SELECT ident, 2, 'waypoint', 'EA', NULL, la, lo, NULL FROM pt WHERE kind = 1 QUALIFY row_number() OVER (PARTITION BY ident ORDER BY n) = 1
  UNION ALL SELECT ident, 3, 'vor', 'D', NULL, la, lo, NULL FROM pt WHERE kind = 2 QUALIFY row_number() OVER (PARTITION BY ident ORDER BY n) = 1
  UNION ALL SELECT ident, 4, 'waypoint', 'PC', ap, la, lo, NULL FROM pt WHERE kind = 0 QUALIFY row_number() OVER (PARTITION BY ident ORDER BY n) = 1),
res AS (SELECT token, uses, ty, sc, ap, la, lo, el FROM tok LEFT JOIN op ON op.ident = tok.token AND (pr = 0) = (token LIKE 'RW%') QUALIFY row_number() OVER (PARTITION BY token ORDER BY pr) = 1)
"""


@query(
    RESOLVED
    + """SELECT token, uses, ty AS fix_type, sc AS section_code, ap AS airport_icao, round(substr(la, 2, 2)::INT + substr(la, 4, 2)::INT / 60.0::DOUBLE + (substr(la, 6, 2)::INT + substr(la, 8, 2)::INT / 100.0::DOUBLE) / 3600.0::DOUBLE, 9) AS latitude_deg,
  round(-(substr(lo, 2, 3)::INT + substr(lo, 5, 2)::INT / 60.0::DOUBLE + (substr(lo, 7, 2)::INT + substr(lo, 9, 2)::INT / 100.0::DOUBLE) / 3600.0::DOUBLE), 9) AS longitude_deg, el::INT AS elevation_ft FROM res"""
)
def priority_resolve(spark: SparkSession, d: str) -> DataFrame:
    found, _ = resolved(spark, d)
    return found.select("token", "uses", "fix_type", "section_code", "airport_icao", F.round("latitude_deg", 9).alias("latitude_deg"), F.round("longitude_deg", 9).alias("longitude_deg"), "elevation_ft")


@query(
    RESOLVED
    + """, oth AS (SELECT ident, array_to_string(list_sort(list(DISTINCT ap))[1:CASE WHEN ident LIKE 'RW%' THEN 8 ELSE 5 END], ',') AS airports FROM pt WHERE kind IN (0, 3) GROUP BY 1)
SELECT token, uses, CASE WHEN token LIKE 'RW%' THEN 'runway' ELSE 'named' END AS kind, coalesce(airports, '') AS airports, CASE WHEN airports IS NOT NULL THEN 'known at other airports only' ELSE 'no record' END AS reason FROM res LEFT JOIN oth ON ident = token WHERE ty IS NULL"""
)
def lookup_failures(spark: SparkSession, d: str) -> DataFrame:
    found, parsed = resolved(spark, d)
    return nav.failures(found, parsed, "KAAA")


@query(
    RESOLVED
    + """SELECT (SELECT count(*) FROM lg) + (SELECT count(*) FROM pt WHERE ap = 'KAAA') AS filter_hits, (SELECT count(*) FROM lg) AS legs, (SELECT count(ty) FROM res) AS fixes_added, (SELECT coalesce(sum(uses), 0) FROM res WHERE ty IS NULL)::BIGINT AS unresolved_references,
  (SELECT count(*) FROM res WHERE ty IS NULL) AS unresolved_identifiers, 0::BIGINT AS parse_failures, 0::BIGINT AS duplicates"""
)
def extraction_summary(spark: SparkSession, d: str) -> DataFrame:
    found, parsed = resolved(spark, d)
    return nav.summary(parsed, nav.legs(parsed, "KAAA"), found, "SUSAP KAAA*")


@query("SELECT s_suppkey AS line_no, concat('SUSAP KAAA', repeat('X', s_suppkey % 40)) AS line FROM supplier WHERE s_suppkey % 40 < 30 ORDER BY 1 LIMIT 10")
def parse_failure_samples(spark: SparkSession, d: str) -> DataFrame:
    """The report's first ten lines; those of 40 characters or more here are runway records."""
    k = F.col("s_suppkey")
    line = F.concat(F.lit("SUSAP KAAA"), F.repeat(F.lit("X"), k % 40))
    record = F.rpad(F.concat(F.lit("SUSAP KAAAK4GRW"), k.cast("string")), 132, " ")
    return nav.failure_samples(nav.parse(read(spark, d, "supplier").select(k.alias("line_no"), F.when(k % 40 < 30, line).otherwise(record).alias("line"))), "SUSAP KAAA*")


@query("SELECT r AS runway, concat(printf('%02d', n_nationkey % 18 + 1), 'L/', printf('%02d', n_nationkey % 18 + 19), 'R') AS runway_pair, 30.0::DOUBLE + n_nationkey + e AS place_lat FROM nation, (VALUES (0), (1)) v(e), LATERAL (SELECT CASE WHEN e = 0 THEN concat(printf('%02d', n_nationkey % 18 + 1), 'L') ELSE concat(printf('%02d', n_nationkey % 18 + 19), 'R') END AS r)")
def unpivot_runways(spark: SparkSession, d: str) -> DataFrame:
    from trackloom.sources import files

    k = F.col("n_nationkey")
    wide = read(spark, d, "nation").select(F.concat(F.format_string("%02dL", k % 18 + 1), F.lit("/"), F.format_string("%02dR", k % 18 + 19)).alias("runway_pair"), (k + 30.0).cast("string").alias("latitude_a"), F.lit("-97").alias("longitude_a"), (k + 31.0).cast("string").alias("latitude_b"), F.lit("-97").alias("longitude_b"))
    return files.runway_thresholds(wide).select("runway", "runway_pair", "place_lat")


# Scalars.


@query(
    """SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN (100 + o_orderkey % 300) * 100.0::DOUBLE WHEN 1 THEN (o_orderkey % 9000)::DOUBLE WHEN 2 THEN NULL ELSE (100 + o_orderkey % 300) * 100.0::DOUBLE END AS altitude_ft FROM orders"""
)
def altitude_parse(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    level = F.format_string("%03d", 100 + k % 300)
    text = F.when(k % 4 == 0, F.concat(F.lit("FL"), level)).when(k % 4 == 1, F.format_string(" %05d", k % 9000)).when(k % 4 == 2, "  ").otherwise(F.concat(F.lit(" fl"), level))
    return read(spark, d, "orders").select("o_orderkey", scalars.altitude_ft(text).alias("altitude_ft"))


@query(
    """WITH r AS (SELECT o_orderkey, list_filter(list_transform(string_split(concat(' a', o_custkey % 9, ' > nan>>RW', printf('%02d', o_orderkey % 36)), '>'), lambda x: upper(trim(x))), lambda x: x <> '' AND x <> 'NAN') AS f, concat('RW', printf('%02d', o_custkey % 36)) AS e FROM orders)
SELECT o_orderkey, array_to_string(CASE WHEN list_contains(f, e) THEN f ELSE list_append(f, e) END, '>') AS route FROM r"""
)
def route_tokens(spark: SparkSession, d: str) -> DataFrame:
    o = read(spark, d, "orders")
    sequence = F.concat(F.lit(" a"), (F.col("o_custkey") % 9).cast("string"), F.lit(" > nan>>RW"), F.format_string("%02d", F.col("o_orderkey") % 36))
    return o.select("o_orderkey", F.array_join(scalars.route_tokens(sequence, F.format_string(" %02d", F.col("o_custkey") % 36)), ">").alias("route"))


@query(
    r"""SELECT c_custkey, trim(coalesce(nullif(regexp_replace(trim(concat(c_mktsegment, 'M', c_custkey % 20)), 'M[0-9]+$', ''), ''), 'x')) AS base, CASE WHEN c_custkey % 5 = 0 THEN concat('UNKNOWN_', c_custkey) ELSE concat(c_mktsegment, c_custkey) END AS flight_id,
  CASE WHEN c_custkey % 20 IN (1, 2) THEN concat('M', c_custkey % 20) ELSE 'M2' END AS segment FROM customer"""
)
def callsigns(spark: SparkSession, d: str) -> DataFrame:
    c = read(spark, d, "customer")
    sign = F.concat(F.lit(" "), F.col("c_mktsegment"), F.lit("M"), (F.col("c_custkey") % 20).cast("string"), F.lit(" "))
    blank = scalars.callsign(F.when(F.col("c_custkey") % 5 != 0, F.concat(F.lit(" "), F.col("c_mktsegment"))))
    return c.select("c_custkey", scalars.base_callsign(sign).alias("base"), scalars.flight_id(blank, F.col("c_custkey").cast("string")).alias("flight_id"), scalars.segment_mark(F.trim(sign))["segment"].alias("segment"))


@query(r"""SELECT page_id, len(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1))::INT AS links, coalesce(regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', 1)[1], '') AS first_url FROM pages""")
def page_links(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "pages").select("page_id", scalars.anchors(F.col("html")).alias("a"))
    return p.select("page_id", F.size("a").alias("links"), F.coalesce(F.get("a", F.lit(0))["url"], F.lit("")).alias("first_url"))


DECODED = "replace(replace({x}, '&quot;', '\"'), '&amp;', '&')"
LINK = r"""regexp_extract_all(html, '(?is)<a\s[^>]*href=["'']([^"'']*)["''][^>]*>(.*?)</a>', {k})"""


@query(
    f"""WITH l AS (SELECT page_id, unnest({LINK.format(k=1)}) AS u, unnest({LINK.format(k=2)}) AS t, generate_subscripts({LINK.format(k=1)}, 1) - 1 AS place FROM pages),
n AS (SELECT page_id, place, {DECODED.format(x="trim(u)")} AS url, regexp_replace(regexp_replace(replace({DECODED.format(x="trim(regexp_replace(t, '<[^>]*>', '', 'g'))")}, ',', ''), '\\s+', '_', 'g'), '_+', '_', 'g') AS label FROM l)
SELECT page_id, label, url, min(place)::INT AS place FROM n WHERE label <> '' AND url <> '' GROUP BY 1, 2, 3"""
)
def page_charts(spark: SparkSession, d: str) -> DataFrame:
    from trackloom.sources import files

    return files.first_links(read(spark, d, "pages"), ["page_id"], "html")


@query("SELECT p_partkey, round(p_retailprice / 0.3048::DOUBLE, 6) AS ft, round(p_retailprice * 0.3048::DOUBLE, 6) AS m, round(p_size / 0.514444::DOUBLE, 6) AS kts, round(p_size * 0.514444::DOUBLE, 6) AS mps, round(p_size / 0.00508::DOUBLE, 6) AS fpm, round(p_retailprice * 0.00508::DOUBLE, 6) AS climb_mps FROM part")
def unit_conversions(spark: SparkSession, d: str) -> DataFrame:
    price, size = F.col("p_retailprice"), F.col("p_size")
    values = {"ft": scalars.m_to_ft(price), "m": scalars.ft_to_m(price), "kts": scalars.mps_to_kts(size), "mps": scalars.kts_to_mps(size), "fpm": scalars.mps_to_fpm(size), "climb_mps": scalars.fpm_to_mps(price)}
    return read(spark, d, "part").select("p_partkey", *(F.round(v, 6).alias(n) for n, v in values.items()))


# Flight mechanics over parts: height from size, speed from price.


def states(spark: SparkSession, d: str) -> DataFrame:
    p = read(spark, d, "part")
    return p.select("p_partkey", (F.col("p_size") * 200.0).alias("h"), (F.lit(60.0) + F.col("p_retailprice") / 20).alias("cas"), (F.col("p_partkey") % 60000).cast("double").alias("s"), (F.col("p_partkey") % 20 - 10.0).alias("disa"), ((F.col("p_partkey") % 7) * -0.01).alias("gamma"), ((F.col("p_partkey") % 5) * 0.1).alias("bank"))


STATES = "st AS (SELECT p_partkey, p_size * 200.0::DOUBLE AS h, 60.0::DOUBLE + p_retailprice / 20 AS cas, (p_partkey % 60000)::DOUBLE AS s, p_partkey % 20 - 10.0::DOUBLE AS disa, (p_partkey % 7) * -0.01::DOUBLE AS gamma, (p_partkey % 5) * 0.1::DOUBLE AS bank FROM part)"


@query(f"WITH {STATES} SELECT p_partkey, round({RHO.format(h='h', d='disa')}, 9) AS rho, round(cas * sqrt(1.225::DOUBLE / {RHO.format(h='h', d='disa')}), 6) AS tas FROM st")
def isa_speeds(spark: SparkSession, d: str) -> DataFrame:
    return states(spark, d).select("p_partkey", F.round(flight.density(F.col("h"), F.col("disa")), 9).alias("rho"), F.round(flight.tas_of(F.col("cas"), F.col("h"), F.col("disa")), 6).alias("tas"))


@query(
    f"""WITH {STATES}, q AS (SELECT *, 0.5 * {RHO.format(h='h', d='disa')} * cas * cas * 122.6::DOUBLE AS qs FROM st), l AS (SELECT *, 60000.0::DOUBLE * 9.80665::DOUBLE * cos(gamma) / greatest(least(cos(bank), 1.0), 0.1) / qs AS cl FROM q)
SELECT p_partkey, round(qs * (0.02::DOUBLE + 0.045::DOUBLE * cl * cl), 4) AS drag_n FROM l"""
)
def drag_polar(spark: SparkSession, d: str) -> DataFrame:
    lit, c = F.lit, F.col
    return states(spark, d).select("p_partkey", F.round(flight.drag_n(lit(0.02), lit(0.045), lit(60000.0), lit(122.6), c("cas"), c("h"), c("gamma"), c("bank"), c("disa")), 4).alias("drag_n"))


@query(
    f"""WITH {STATES}, m AS (SELECT *, CASE WHEN s <= 12000 THEN 'final' WHEN s <= 35000 THEN 'approach' ELSE 'clean' END AS mode FROM st), v AS (SELECT *, CASE mode WHEN 'final' THEN 55.0::DOUBLE WHEN 'approach' THEN 62.0::DOUBLE ELSE 75.0::DOUBLE END * sqrt(60000.0::DOUBLE / 64500.0::DOUBLE) AS stall FROM m)
SELECT p_partkey, mode, round(greatest(58.0, stall), 6) AS cas_floor, round(least(0.52::DOUBLE, 0.44::DOUBLE, acos(greatest(least(pow(1.3::DOUBLE * stall / cas, 2.0), 1.0), 0.0))), 9) AS bank_limit FROM v"""
)
def mode_limits(spark: SparkSession, d: str) -> DataFrame:
    mode = flight.mode_at(F.col("s"))
    reference = F.when(mode == "final", 55.0).when(mode == "approach", 62.0).otherwise(75.0)
    stall = flight.stall_cas(reference, F.lit(60000.0), F.lit(64500.0))
    return states(spark, d).select("p_partkey", mode.alias("mode"), F.round(flight.cas_floor(F.lit(58.0), stall), 6).alias("cas_floor"), F.round(flight.bank_limit(F.lit(0.52), F.lit(0.44), stall, F.col("cas")), 9).alias("bank_limit"))


@query("SELECT p_brand, round(regr_intercept(0.02 + 0.04 * pow(p_size / 50.0, 2) + p_retailprice / 1e6, pow(p_size / 50.0, 2)), 8) AS cd0, round(regr_slope(0.02 + 0.04 * pow(p_size / 50.0, 2) + p_retailprice / 1e6, pow(p_size / 50.0, 2)), 8) AS k, count(*) AS samples FROM part GROUP BY 1")
def polar_fit(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("p_size") / F.lit(50.0)
    samples = read(spark, d, "part").select("p_brand", x.alias("cl"), (F.lit(0.02) + F.lit(0.04) * F.pow(x, F.lit(2)) + F.col("p_retailprice") / F.lit(1e6)).alias("cd"))
    return verify.polar_fit(samples, ["p_brand"]).select("p_brand", F.round("cd0", 8).alias("cd0"), F.round("k", 8).alias("k"), "samples")


# Profiles: nodes from order lines.


def profile_nodes(spark: SparkSession, d: str) -> DataFrame:
    line = fixture.lines(spark, d)
    return line.select("l_orderkey", F.when(F.col("l_linenumber") % 2 == 0, "h").otherwise("v").alias("curve"), (F.col("l_linenumber") * 10.0).alias("s"), F.col("l_quantity").alias("y"))


NODES = f"n AS (SELECT l_orderkey, CASE WHEN l_linenumber % 2 = 0 THEN 'h' ELSE 'v' END AS curve, l_linenumber * 10.0::DOUBLE AS s, l_quantity AS y FROM {LINES})"


@query(
    f"""WITH {NODES}, g AS (SELECT DISTINCT l_orderkey, s FROM n), c AS (SELECT DISTINCT l_orderkey, curve FROM n), gc AS (SELECT * FROM c JOIN g USING (l_orderkey)),
b AS (SELECT gc.*, (SELECT max({{'s': n.s, 'y': n.y}}) FROM n WHERE n.l_orderkey = gc.l_orderkey AND n.curve = gc.curve AND n.s <= gc.s) AS lo, (SELECT min({{'s': n.s, 'y': n.y}}) FROM n WHERE n.l_orderkey = gc.l_orderkey AND n.curve = gc.curve AND n.s >= gc.s) AS hi FROM gc)
SELECT l_orderkey, curve, s, round(CASE WHEN lo IS NULL THEN hi.y WHEN hi IS NULL OR lo.s = hi.s THEN lo.y ELSE lo.y + (hi.y - lo.y) * (s - lo.s) / (hi.s - lo.s) END, 9) AS value FROM b"""
)
def envelope_merge(spark: SparkSession, d: str) -> DataFrame:
    return profiles.on_merged_grid(profile_nodes(spark, d), "l_orderkey", "curve").withColumn("value", F.round("value", 9))


@query(
    f"""WITH {NODES}, a AS (SELECT l_orderkey, list(s ORDER BY s) AS x, list(y ORDER BY s) AS y FROM n GROUP BY 1), q AS (SELECT *, 25.0::DOUBLE AS p FROM a), i AS (SELECT *, greatest(least(len(list_filter(x, lambda v: v < p)), len(x) - 1), 1) AS i FROM q)
SELECT l_orderkey, round(CASE WHEN p <= x[1] THEN y[1] WHEN p >= x[len(x)] THEN y[len(x)] ELSE y[i] + (y[i + 1] - y[i]) * (p - x[i]) / (x[i + 1] - x[i]) END, 9) AS value, round(CASE WHEN len(x) < 2 THEN 0.0 ELSE (y[i + 1] - y[i]) / (x[i + 1] - x[i]) END, 9) AS slope FROM i"""
)
def interp_profile(spark: SparkSession, d: str) -> DataFrame:
    nodes = profile_nodes(spark, d)
    found = profiles.sampled(nodes, nodes.select("l_orderkey").distinct().withColumn("s", F.lit(25.0)), ["l_orderkey"])
    return found.select("l_orderkey", F.round("value", 9).alias("value"), F.round("slope", 9).alias("slope"))


@query(
    f"""WITH env AS (SELECT l_orderkey AS k, l_linenumber * 10.0::DOUBLE AS s, l_quantity AS lower, l_quantity + 20.0::DOUBLE AS upper FROM {LINES} WHERE l_linenumber % 2 = 1),
con AS (SELECT k, s, max(lower) AS least, min(upper) AS most FROM (SELECT l_orderkey AS k, floor(l_linenumber / 2) * 10.0::DOUBLE + 10.0::DOUBLE AS s, l_quantity - 5.0::DOUBLE AS lower, l_quantity + 10.0::DOUBLE AS upper FROM {LINES} WHERE l_linenumber % 3 <> 1) GROUP BY 1, 2),
g AS (SELECT k, s FROM env UNION SELECT con.k, con.s FROM con WHERE k IN (SELECT k FROM env)),
b AS (SELECT g.*, (SELECT max({{'s': e.s, 'l': e.lower, 'u': e.upper}}) FROM env e WHERE e.k = g.k AND e.s <= g.s) AS lo, (SELECT min({{'s': e.s, 'l': e.lower, 'u': e.upper}}) FROM env e WHERE e.k = g.k AND e.s >= g.s) AS hi FROM g),
v AS (SELECT k, s, CASE WHEN lo IS NULL THEN hi.l WHEN hi IS NULL OR lo.s = hi.s THEN lo.l ELSE lo.l + (hi.l - lo.l) * (s - lo.s) / (hi.s - lo.s) END AS l, CASE WHEN lo IS NULL THEN hi.u WHEN hi IS NULL OR lo.s = hi.s THEN lo.u ELSE lo.u + (hi.u - lo.u) * (s - lo.s) / (hi.s - lo.s) END AS u FROM b)
SELECT v.k AS l_orderkey, v.s, round(greatest(l, coalesce(least, l)), 9) AS lower, round(least(u, coalesce(most, u)), 9) AS upper, greatest(l, coalesce(least, l)) > least(u, coalesce(most, u)) AS crossed FROM v LEFT JOIN con ON con.k = v.k AND con.s = v.s"""
)
def envelope_tighten(spark: SparkSession, d: str) -> DataFrame:
    line = fixture.lines(spark, d)
    env = line.where("l_linenumber % 2 = 1").select("l_orderkey", (F.col("l_linenumber") * 10.0).alias("s"), F.col("l_quantity").alias("lower"), (F.col("l_quantity") + 20.0).alias("upper"))
    con = line.where("l_linenumber % 3 <> 1").select("l_orderkey", (F.floor(F.col("l_linenumber") / 2) * 10.0 + 10.0).alias("s"), (F.col("l_quantity") - 5.0).alias("lower"), (F.col("l_quantity") + 10.0).alias("upper"))
    return profiles.tighten(env, con, "l_orderkey", rows=fixture.line_count(spark, d)).select("l_orderkey", "s", F.round("lower", 9).alias("lower"), F.round("upper", 9).alias("upper"), "crossed")


NINE = (("h_lower", "h_upper"), ("cas_lower", "cas_upper"), ("gamma_lower", "gamma_upper"), ("thrust_lower", "thrust_upper"), (None, "cl_max"))


def nine_curves(q: str) -> list[tuple[str, str]]:
    """Name and SQL of each curve from a quantity."""
    made = []
    for k, (low, high) in enumerate(NINE):
        made += [(low, f"{q} * {k + 1}.0")] if low else []
        made += [(high, f"{q} * {k + 1}.0 + 20.0")]
    return made


def between_sql(c: str) -> str:
    return f"CASE WHEN lo IS NULL THEN hi.{c} WHEN hi IS NULL OR lo.s = hi.s THEN lo.{c} ELSE lo.{c} + (hi.{c} - lo.{c}) * (s - lo.s) / (hi.s - lo.s) END"


@query(
    f"""WITH env AS (SELECT l_orderkey AS k, l_linenumber * 10.0::DOUBLE AS s, {", ".join(f"{x} AS {n}" for n, x in nine_curves("l_quantity::DOUBLE"))} FROM {LINES} WHERE l_linenumber % 2 = 1),
con AS (SELECT l_orderkey AS k, l_linenumber * 10.0::DOUBLE + 5.0::DOUBLE AS s, l_quantity::DOUBLE AS h_lower, l_quantity::DOUBLE + 9.0 AS h_upper, l_quantity::DOUBLE * 2.0 AS cas_upper FROM {LINES} WHERE l_linenumber % 2 = 0),
g AS (SELECT k, s FROM env UNION SELECT k, s FROM con WHERE k IN (SELECT k FROM env)),
b AS (SELECT g.*, (SELECT arg_max(e, e.s) FROM env e WHERE e.k = g.k AND e.s <= g.s) AS lo, (SELECT arg_min(e, e.s) FROM env e WHERE e.k = g.k AND e.s >= g.s) AS hi FROM g),
v AS (SELECT k, s, {", ".join(f"{between_sql(n)} AS {n}" for n, _ in nine_curves(""))} FROM b),
x AS (SELECT v.* EXCLUDE (h_lower, h_upper, cas_upper), greatest(v.h_lower, coalesce(con.h_lower, v.h_lower)) AS h_lower, least(v.h_upper, coalesce(con.h_upper, v.h_upper)) AS h_upper, least(v.cas_upper, coalesce(con.cas_upper, v.cas_upper)) AS cas_upper FROM v LEFT JOIN con USING (k, s))
SELECT k AS l_orderkey, s, {", ".join(f"round({n}, 6) AS {n}" for n, _ in nine_curves(""))}, {" OR ".join(f"{low} > {high}" for low, high in NINE if low)} AS crossed FROM x"""
)
def envelope_nine(spark: SparkSession, d: str) -> DataFrame:
    line, q = fixture.lines(spark, d), F.col("l_quantity").cast("double")
    curves = [c for pair in NINE for c in pair if c]
    values = {c: q * (k + 1.0) + (0.0 if c == low else 20.0) for k, (low, high) in enumerate(NINE) for c in (low, high) if c}
    env = line.where("l_linenumber % 2 = 1").select("l_orderkey", (F.col("l_linenumber") * 10.0).alias("s"), *(values[c].alias(c) for c in curves))
    con = line.where("l_linenumber % 2 = 0").select("l_orderkey", (F.col("l_linenumber") * 10.0 + 5.0).alias("s"), q.alias("h_lower"), (q + 9.0).alias("h_upper"), (q * 2.0).alias("cas_upper"))
    return profiles.tighten(env, con, "l_orderkey", NINE, rows=fixture.line_count(spark, d)).select("l_orderkey", "s", *(F.round(c, 6).alias(c) for c in curves), "crossed")


# Plans.

RATED = f"""WITH {PLANS}, a AS (SELECT *, 0.5 * {RHO.format(h='h', d='0.0')} * v * v * 122.6::DOUBLE AS qs FROM node), b AS (SELECT *, 60000.0::DOUBLE * 9.80665::DOUBLE * cos(gamma) / qs AS cl FROM a),
c AS (SELECT *, -tan(gamma) AS dh, -((thrust - qs * (0.02::DOUBLE + 0.045::DOUBLE * cl * cl)) / 60000.0::DOUBLE - 9.80665::DOUBLE * sin(gamma)) / (v * cos(gamma)) AS dv, 1.0 / greatest(v, 1.0) AS dt FROM b),
e AS (SELECT plan_id, idx, s, lead(h) OVER w - h - 0.5 * (lead(s) OVER w - s) * (dh + lead(dh) OVER w) AS eh, lead(v) OVER w - v - 0.5 * (lead(s) OVER w - s) * (dv + lead(dv) OVER w) AS ev, lead(t) OVER w - t - 0.5 * (lead(s) OVER w - s) * (dt + lead(dt) OVER w) AS et FROM c WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
"""


def plan_defects(spark: SparkSession, d: str) -> DataFrame:
    return verify.defects(verify.rates(fixture.plan_nodes(spark, d), 60000.0, 122.6, 0.02, 0.045))


@query(RATED + "SELECT plan_id, idx, s, round(eh, 6) AS defect_h, round(ev, 6) AS defect_v, round(et, 6) AS defect_t FROM e WHERE eh IS NOT NULL")
def collocation_defects(spark: SparkSession, d: str) -> DataFrame:
    return plan_defects(spark, d).select("plan_id", "idx", "s", *(F.round(f"defect_{x}", 6).alias(f"defect_{x}") for x in "hvt"))


@query(RATED + ", l AS (SELECT plan_id, idx, s, unnest([{'x': 'h', 'e': round(abs(eh), 6)}, {'x': 'v', 'e': round(abs(ev), 6)}, {'x': 't', 'e': round(abs(et), 6)}]) AS q FROM e WHERE eh IS NOT NULL) SELECT plan_id, q.x AS state, max(q.e) AS worst, arg_max(s, (q.e, -idx)) AS at_s FROM l GROUP BY 1, 2")
def worst_defects(spark: SparkSession, d: str) -> DataFrame:
    rounded = plan_defects(spark, d).withColumns({f"defect_{x}": F.round(f"defect_{x}", 6) for x in "hvt"})
    return verify.worst_defects(rounded)


@query(
    f"""WITH {PLANS}, m AS (SELECT plan_id, idx, s, unnest([{{'f': 'h above lower', 'm': h - 260.0}}, {{'f': 'h below upper', 'm': 2000.0 - h}}, {{'f': 'v above lower', 'm': v - 80.0}}, {{'f': 'v below upper', 'm': 120.0 - v}}, {{'f': 'time order', 'm': lead(t) OVER (PARTITION BY plan_id ORDER BY idx) - t}}]) AS q FROM node)
SELECT plan_id, q.f AS family, round(min(q.m), 6) AS least_margin, arg_min(s, (q.m, idx)) AS at_s, min(q.m) >= 0 AS holds FROM m WHERE q.m IS NOT NULL GROUP BY 1, 2"""
)
def constraint_margins(spark: SparkSession, d: str) -> DataFrame:
    nodes = fixture.plan_nodes(spark, d).withColumns({"h_lower": F.lit(260.0), "h_upper": F.lit(2000.0), "v_lower": F.lit(80.0), "v_upper": F.lit(120.0)})
    return verify.margins(nodes).withColumn("least_margin", F.round("least_margin", 6))


@query(
    f"""WITH {PLANS}, o AS (SELECT *, gamma - lag(gamma) OVER w AS dg, thrust - lag(thrust) OVER w AS dq FROM node WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
SELECT plan_id, round(avg(thrust), 6) AS mean_thrust, round(sqrt(avg(gamma * gamma)), 9) AS rms_gamma, round(max(abs(gamma)), 9) AS peak_gamma, round(avg(dg * dg), 9) AS gamma_roughness, round(avg(dq * dq), 3) AS thrust_roughness, round(max(t) - min(t), 6) AS duration, count(*) AS nodes FROM o GROUP BY 1"""
)
def plan_objective(spark: SparkSession, d: str) -> DataFrame:
    o = verify.objective(fixture.plan_nodes(spark, d))
    places = {"mean_thrust": 6, "rms_gamma": 9, "peak_gamma": 9, "gamma_roughness": 9, "thrust_roughness": 3, "duration": 6}
    return o.withColumns({c: F.round(c, n) for c, n in places.items()})


LATERAL = PLANS.replace(
    "FROM (SELECT",
    """, 60.0::DOUBLE + l_linenumber * 8.0::DOUBLE AS cas, 8000.0::DOUBLE + l_suppkey % 10 * 50.0::DOUBLE AS idle, (l_suppkey % 50)::DOUBLE - 25 AS "cross", ((l_partkey % 17)::DOUBLE - 8) / 200.0::DOUBLE AS heading_error,
    ((l_suppkey % 21)::DOUBLE - 10) / 100.0::DOUBLE AS bank, ((l_partkey % 11)::DOUBLE - 5) / 1000.0::DOUBLE AS roll, l_linenumber * 0.1::DOUBLE AS track, l_linenumber * 0.0001::DOUBLE AS curvature, 0.4::DOUBLE + l_discount AS cl
  FROM (SELECT""",
    1,
)
PLAN_BOUNDS = {"h_lower": 260.0, "h_upper": 2000.0, "cas_lower": 70.0, "cas_upper": 110.0, "thrust_lower": 9500.0, "thrust_upper": 13500.0, "bank_lower": -0.08, "bank_upper": 0.08, "roll_lower": -0.004, "roll_upper": 0.004, "along_lower": 75.0, "gamma_lower": -0.027, "gamma_upper": -0.021, "cl_upper": 0.48, "cas_end_lower": 90.0, "cas_end_upper": 105.0}
PLAN_LIMITS = verify.Limits(idle_share=0.6, descend_only=True, gamma_deg_per_km=0.05, gamma_deg_per_km2=0.02, slack={"h": 100.0, "cas": 10.0, "thrust": 1000.0, "bank": 0.1, "roll": 0.01, "along": 10.0, "gamma": 0.01, "cl": 1.0})


def margin_sql() -> str:
    """The families of PLAN_BOUNDS and PLAN_LIMITS as a list of structs."""
    some = []
    for name, bound in PLAN_BOUNDS.items():
        x, side = name.split("_")[0], name.split("_")[-1]
        over = f"{x} - {bound!r}::DOUBLE" if side == "lower" else f"{bound!r}::DOUBLE - {x}"
        margin = f"{over} + 0.05::DOUBLE * {PLAN_LIMITS.slack[x]!r}::DOUBLE"
        ends = "_end_" in name
        some.append((f"{x} {'above' if side == 'lower' else 'below'} {side}" + (" at end" if ends else ""), f"CASE WHEN after IS NULL THEN {margin} END" if ends else margin))
    km, bend = (f"{math.radians(x)!r}::DOUBLE" for x in (PLAN_LIMITS.gamma_deg_per_km, PLAN_LIMITS.gamma_deg_per_km2))
    step, change, curve, give = "(greatest(abs(s1 - s), 1.0::DOUBLE) / 1000.0::DOUBLE)", "(g1 - gamma)", "(g2 - 2.0::DOUBLE * g1 + gamma)", "0.05::DOUBLE * 0.01::DOUBLE"
    some += [("thrust above idle", "thrust - idle"), ("thrust in idle band", "(idle + 0.6::DOUBLE * greatest(13500.0::DOUBLE - idle, 0.0::DOUBLE)) - thrust"), ("no climb", "h1 - h + 0.05::DOUBLE * 100.0::DOUBLE"), ("time order", "t1 - t")]
    some += [("gamma rise", f"{km} * {step} - {change} + {give}"), ("gamma fall", f"{km} * {step} + {change} + {give}"), ("gamma bend up", f"{bend} * {step} * {step} - {curve} + {give}"), ("gamma bend down", f"{bend} * {step} * {step} + {curve} + {give}")]
    return "[" + ", ".join(f"{{'f': '{n}', 'm': {m}}}" for n, m in some) + "]"


@query(
    f"""WITH {LATERAL}, o AS (SELECT *, v - 3.0::DOUBLE AS along, lead(idx) OVER w AS after, lead(s) OVER w AS s1, lead(h) OVER w AS h1, lead(t) OVER w AS t1, lead(gamma) OVER w AS g1, lead(gamma, 2) OVER w AS g2 FROM node WINDOW w AS (PARTITION BY plan_id ORDER BY idx)),
m AS (SELECT plan_id, idx, s, unnest({margin_sql()}) AS q FROM o)
SELECT plan_id, q.f AS family, round(min(q.m), 6) AS least_margin, arg_min(s, (q.m, idx)) AS at_s, min(q.m) >= 0 AS holds FROM m WHERE q.m IS NOT NULL GROUP BY 1, 2"""
)
def margin_families(spark: SparkSession, d: str) -> DataFrame:
    nodes = fixture.lateral_plan_nodes(spark, d).withColumns({"along": F.col("v") - 3.0} | {c: F.lit(b) for c, b in PLAN_BOUNDS.items()})
    return verify.margins(nodes, PLAN_LIMITS).withColumn("least_margin", F.round("least_margin", 6))


@query(
    f"""WITH {LATERAL}, o AS (SELECT *, gamma - lag(gamma) OVER (PARTITION BY plan_id ORDER BY idx) AS dg, thrust - idle AS ov FROM node),
a AS (SELECT plan_id, max(s) AS reach, greatest(max(s) / greatest(count(*) - 1, 1), 1.0) AS ds, greatest(max(abs("cross")), 100.0::DOUBLE) AS cu, avg(ov * ov) AS o2, avg(dg * dg) AS g2, avg("cross" * "cross") AS c2, avg(heading_error * heading_error) AS e2, avg(bank * bank) AS b2, avg(roll * roll) AS r2,
  max(abs(ov)) AS po, coalesce(max(abs(dg)), 0.0) AS pg, max(abs("cross")) AS pc, max(abs(heading_error)) AS pe, max(abs(bank)) AS pb, max(abs(roll)) AS pr FROM o GROUP BY 1),
x AS (SELECT *, -2.0::DOUBLE * reach / 1000.0 AS f1, 3.0::DOUBLE * reach / 1000.0 * o2 / 1e8::DOUBLE AS f2, coalesce(0.5::DOUBLE * g2 / pow(radians(1.0) * ds / 1000.0, 2), 0.0) AS f3, c2 / (cu * cu) AS f4, e2 / pow(radians(5.0), 2) AS f5, b2 / pow(radians(20.0), 2) AS f6, r2 / 0.0025::DOUBLE AS f7, 10.0::DOUBLE * 0.0025 AS f8 FROM a)
SELECT plan_id, round(f1 + f2 + f3 + f4 + f5 + f6 + f7 + f8, 6) AS total, round(f1, 6) AS reach_term, round(f2, 6) AS thrust_term, round(f3, 6) AS gamma_term, round(f4, 8) AS cross_term, round(f5, 6) AS heading_error_term, round(f6, 6) AS bank_term, round(f7, 6) AS roll_term, round(f8, 6) AS slack_term,
  round(sqrt(o2), 6) AS rms_over_idle, round(po, 6) AS peak_over_idle, round(degrees(pg), 6) AS peak_gamma_step_deg, round(pc, 6) AS peak_cross_m, round(degrees(pe), 6) AS peak_heading_error_deg, round(degrees(pb), 6) AS peak_bank_deg, round(pr, 6) AS peak_roll_rate,
  round(ds, 6) AS ds, 10000.0::DOUBLE AS thrust_unit, round(cu, 6) AS cross_unit, 5.0::DOUBLE AS heading_unit_deg, 20.0::DOUBLE AS bank_unit_deg, 0.05::DOUBLE AS roll_unit FROM x"""
)
def plan_cost(spark: SparkSession, d: str) -> DataFrame:
    weights = verify.Weights(reach=2.0, thrust=3.0, gamma=0.5, slack=10.0)
    c = verify.cost(fixture.lateral_plan_nodes(spark, d), weights, 10_000.0, 0.05)
    return c.select("plan_id", *(F.round(n, 8 if n == "cross_term" else 6).alias(n) for n in c.columns[1:]))  # eighths of cross_term would be ties at 6


@query(ORACLES["plan_cost"].replace("-2.0::DOUBLE * reach / 1000.0 AS f1", "2.0::DOUBLE * reach / 1000.0 AS f1").replace("3.0::DOUBLE * reach / 1000.0 * o2 / 1e8::DOUBLE AS f2", "0.0::DOUBLE AS f2"))
def plan_cost_idle_band(spark: SparkSession, d: str) -> DataFrame:
    """The cost of plans whose thrust an idle band bounds."""
    weights = verify.Weights(reach=2.0, thrust=3.0, gamma=0.5, slack=10.0)
    c = verify.cost(fixture.lateral_plan_nodes(spark, d), weights, 10_000.0, 0.05, idle_band=True)
    return c.select("plan_id", *(F.round(n, 8 if n == "cross_term" else 6).alias(n) for n in c.columns[1:]))


@query(
    f"""WITH {LATERAL}, a AS (SELECT *, v * cos(track + heading_error) + 2.0 AS e, v * sin(track + heading_error) - 1.0 AS n FROM node), b AS (SELECT *, greatest(e * cos(track) + n * sin(track), 1.0) AS al, n * cos(track) - e * sin(track) AS ac FROM a),
c AS (SELECT *, 1.0 / al AS xt, -ac / al AS xc, curvature - 9.80665::DOUBLE * tan(bank) / v / al AS xe, -roll / al AS xb FROM b),
f AS (SELECT plan_id, idx, s, lead(t) OVER w - t - 0.5 * (lead(s) OVER w - s) * (xt + lead(xt) OVER w) AS et, lead("cross") OVER w - "cross" - 0.5 * (lead(s) OVER w - s) * (xc + lead(xc) OVER w) AS ec, lead(heading_error) OVER w - heading_error - 0.5 * (lead(s) OVER w - s) * (xe + lead(xe) OVER w) AS ee, lead(bank) OVER w - bank - 0.5 * (lead(s) OVER w - s) * (xb + lead(xb) OVER w) AS eb FROM c WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
SELECT plan_id, idx, s, round(et, 6) AS defect_t, round(ec, 6) AS defect_cross, round(ee, 6) AS defect_heading_error, round(eb, 6) AS defect_bank FROM f WHERE et IS NOT NULL"""
)
def lateral_defects(spark: SparkSession, d: str) -> DataFrame:
    states = ("t", "cross", "heading_error", "bank")
    found = verify.defects(verify.lateral_rates(fixture.lateral_plan_nodes(spark, d)), states)
    return found.select("plan_id", "idx", "s", *(F.round(f"defect_{x}", 6).alias(f"defect_{x}") for x in states))


@query(
    f"""WITH {LATERAL}, e AS (SELECT plan_id, arg_min({{'h': h, 'v': v, 'b': bank}}, idx) AS a, arg_max({{'h': h, 'v': v, 'b': bank}}, idx) AS z FROM node GROUP BY 1)
SELECT plan_id, u.e AS "end", u.x AS state, round(u.d, 6) AS defect FROM (SELECT plan_id, unnest([{{'e': 'first', 'x': 'h', 'd': a.h - 250.0}}, {{'e': 'first', 'x': 'bank', 'd': a.b - 0.0}}, {{'e': 'last', 'x': 'h', 'd': z.h - 1750.0}}, {{'e': 'last', 'x': 'v', 'd': z.v - (100.0 + plan_id % 5)}}]) AS u FROM e)"""
)
def endpoint_defects(spark: SparkSession, d: str) -> DataFrame:
    plans = read(spark, d, "lineitem").select(F.col("l_orderkey").alias("plan_id")).distinct()
    aims = (("first", "h", F.lit(250.0)), ("first", "bank", F.lit(0.0)), ("last", "h", F.lit(1750.0)), ("last", "v", F.lit(100.0) + F.col("plan_id") % 5))
    wanted = plans.select("plan_id", F.inline(F.array(*(F.struct(F.lit(e).alias("end"), F.lit(x).alias("state"), value.alias("value")) for e, x, value in aims))))
    return verify.endpoint_defects(fixture.lateral_plan_nodes(spark, d), wanted).withColumn("defect", F.round("defect", 6))


@query(f"WITH {PLANS}, o AS (SELECT *, CASE WHEN phase <> lag(phase) OVER w THEN 1 ELSE 0 END AS c FROM node WINDOW w AS (PARTITION BY plan_id ORDER BY idx)), p AS (SELECT *, (sum(c) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING))::BIGINT AS span FROM o) SELECT plan_id, span, phase, min(idx) AS first_idx, max(idx) AS last_idx FROM p GROUP BY 1, 2, 3")
def phase_spans(spark: SparkSession, d: str) -> DataFrame:
    return verify.phase_spans(fixture.plan_nodes(spark, d))


@query(f"WITH {PLANS}, o AS (SELECT *, lead(t) OVER w - t AS dt, abs(lead(s) OVER w - s) AS ds FROM node WINDOW w AS (PARTITION BY plan_id ORDER BY idx)) SELECT plan_id, phase, round(sum(dt), 6) AS time_s, round(sum(ds), 6) AS distance_m FROM o WHERE dt IS NOT NULL GROUP BY 1, 2")
def phase_totals(spark: SparkSession, d: str) -> DataFrame:
    t = verify.phase_totals(fixture.plan_nodes(spark, d))
    return t.withColumns({c: F.round(c, 6) for c in ("time_s", "distance_m")})


@query(
    f"""WITH {PLANS}, o AS (SELECT *, coalesce(abs(s - lag(s) OVER w) / (0.5 * (greatest(v + 5.0, 1.0) + greatest(lag(v) OVER w + 5.0, 1.0))), 0.0) AS step FROM node WINDOW w AS (PARTITION BY plan_id ORDER BY idx))
SELECT plan_id, idx, round(sum(step) OVER (PARTITION BY plan_id ORDER BY idx ROWS UNBOUNDED PRECEDING), 6) AS elapsed FROM o"""
)
def time_profile(spark: SparkSession, d: str) -> DataFrame:
    return verify.time_profile(fixture.plan_nodes(spark, d), 5.0).select("plan_id", "idx", F.round("elapsed", 6).alias("elapsed"))


@query(f"WITH {PLANS}, o AS (SELECT *, s - lag(s) OVER w AS ds, t - lag(t) OVER w AS dt FROM node WINDOW w AS (PARTITION BY plan_id ORDER BY idx)) SELECT plan_id, count(*) >= 2 AS enough, coalesce(bool_and(ds > 0), true) AS rises, coalesce(bool_and(dt >= 0), true) AS in_time FROM o GROUP BY 1")
def plan_order(spark: SparkSession, d: str) -> DataFrame:
    return profiles.well_ordered(fixture.plan_nodes(spark, d), "plan_id")


# Routes: four fixes of suppliers per customer.


def customer_routes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n = read(spark, d, "supplier").count()
    k = F.col("c_custkey")
    path = F.concat_ws(" ", *(F.concat(F.lit("fx"), (((k * 7 + i * 13) % n + 1) % n).cast("string")) for i in range(3)), F.lit("32.5/-97.5"))
    fixes = fixture.fixes(spark, d).select("identifier", F.col("place_lat").alias("lat"), F.col("place_lon").alias("lon"))
    return read(spark, d, "customer").select(k.alias("route_id"), path.alias("path")), fixes


@query(
    f"""WITH {FIXES}, n AS (SELECT count(*) AS n FROM supplier), t AS (SELECT c_custkey AS route_id, i + 1 AS place, concat('FX', ((c_custkey * 7 + i * 13) % n + 1) % n) AS identifier FROM customer, n, (VALUES (0), (1), (2)) v(i))
SELECT route_id, place::INT AS place, identifier, place_lat AS lat, place_lon AS lon FROM t JOIN fix USING (identifier) UNION ALL SELECT c_custkey, 4, 'COORD04', 32.5::DOUBLE, -97.5::DOUBLE FROM customer"""
)
def resolve_routes(spark: SparkSession, d: str) -> DataFrame:
    return routes.resolve(*customer_routes(spark, d))


@query()
def reference_paths(spark: SparkSession, d: str) -> DataFrame:
    return routes.reference_paths(resolve_routes(spark, d))


@query()
def waypoint_distances(spark: SparkSession, d: str) -> DataFrame:
    return routes.waypoint_distances(resolve_routes(spark, d))


# Compression: the oracle splits spans level by level.


def numbered_tracks(spark: SparkSession, d: str) -> DataFrame:
    whole = segments.keep_last(fixture.tracks(spark, d))
    return whole


SERIES = f"""WITH RECURSIVE {TRACKS}, k AS (SELECT flight_id, floor(time)::BIGINT AS t, geoaltitude AS y FROM track WHERE geoaltitude IS NOT NULL QUALIFY row_number() OVER (PARTITION BY flight_id, floor(time)::BIGINT ORDER BY ordinal DESC) = 1),
p AS (SELECT *, row_number() OVER (PARTITION BY flight_id ORDER BY t) AS i FROM k),
b AS (SELECT flight_id, 1::BIGINT AS a, max(i) AS z FROM p GROUP BY 1),
span(flight_id, a, z) AS (
  SELECT flight_id, a, z FROM b
  UNION ALL
  SELECT w.flight_id, unnest([w.a, w.m]), unnest([w.m, w.z]) FROM (
    SELECT s.flight_id, s.a, s.z, arg_max(p.i, (abs(p.y - (q.y + (r.y - q.y) * (p.t - q.t) / (r.t - q.t))), -p.i)) AS m, max(abs(p.y - (q.y + (r.y - q.y) * (p.t - q.t) / (r.t - q.t)))) AS e
    FROM span s JOIN p ON p.flight_id = s.flight_id AND p.i > s.a AND p.i < s.z JOIN p q ON q.flight_id = s.flight_id AND q.i = s.a JOIN p r ON r.flight_id = s.flight_id AND r.i = s.z GROUP BY 1, 2, 3) w WHERE w.e > 600)
SELECT DISTINCT p.flight_id, p.t AS time FROM span s JOIN p ON p.flight_id = s.flight_id AND p.i IN (s.a, s.z)"""


@query(SERIES)
def altitude_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    kept = compress.compress(numbered_tracks(spark, d), 1e12, 600.0)
    return kept.select("flight_id", "time")


@query()
def compressed_flights(spark: SparkSession, d: str) -> DataFrame:
    whole = numbered_tracks(spark, d)
    return compress.compressed_flights(whole, compress.compress(whole, 2000.0, 600.0), 2000.0, 600.0)


@query()
def compression_manifest(spark: SparkSession, d: str) -> DataFrame:
    return sinks.flight_manifest(compressed_flights(spark, d))


@query("WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w > INTERVAL 8 HOUR THEN 1 ELSE 0 END AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, ts, sum(n) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o) SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 8 HOUR AS \"end\", count(*) AS rows FROM s GROUP BY user_id, k")
def stream_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of a stream of the event table, read to its end and written to the shared folder as they close."""

    def build(stream: DataFrame) -> DataFrame:
        closed = streams.sessions(stream.withColumn("ts", F.col("ts").cast("timestamp")), "user_id", "8 hours", ANY_ORDER)
        return closed.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), F.col("end").cast("timestamp_ntz").alias("end"), "rows")

    return drained(spark, d, build)


@query("SELECT date_trunc('minute', ts) AS minute, max(ts) AS latest, count(*) AS rows FROM events WHERE ts IS NOT NULL GROUP BY 1")
def stream_latest(spark: SparkSession, d: str) -> DataFrame:
    """The latest event of each minute, with their number, of the event table read as a stream."""

    def build(stream: DataFrame) -> DataFrame:
        closed = streams.latest_per_minute(stream.withColumn("ts", F.col("ts").cast("timestamp")), ANY_ORDER)
        return closed.select(F.col("minute").cast("timestamp_ntz").alias("minute"), F.col("latest").cast("timestamp_ntz").alias("latest"), "rows")

    return drained(spark, d, build)


@query(ORACLES["dedup_keep_last"])
def stream_keep_last(spark: SparkSession, d: str) -> DataFrame:
    """Keep-last de-duplication of the event table, read as a stream."""
    return drained(spark, d, lambda stream: streams.keep_last(fixture.as_tracks(stream), ANY_ORDER)).select("flight_id", "time", "ordinal", "geoaltitude")


#: The files of a table come in no order of time: nothing is late before the end.
ANY_ORDER = "36500 days"


def drained(spark: SparkSession, d: str, build: Callable[[DataFrame], DataFrame], files: int = 64, years: int = 200) -> DataFrame:
    """What build makes of the event table as a stream, with all state emitted, as a table in the shared folder.

    The table is read to its end first, so many files a micro-batch. Then the same query restarts from its checkpoint with
    one row `years` after the last event, which moves the watermark past all of them; its own state stays open.
    """
    events = read(spark, d, "events")
    tail = place(spark, "tail")
    events.limit(0).write.parquet(tail)
    out = build(streams.table(spark, f"{d}/events.parquet", events.schema, maxFilesPerTrigger=files).unionByName(streams.table(spark, tail, events.schema)))
    path, checkpoint = place(spark, "stream"), place(spark, "checkpoint")
    store = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(store, None)
    spark.conf.set(store, streams.STATE_STORE)
    try:
        for last in (False, True):
            if last:
                latest = events.agg(F.max("ts").cast("timestamp_ntz").alias("ts")).where("ts is not null").withColumn("ts", F.col("ts") + F.expr(f"make_interval({years})"))
                others = {f.name: F.lit({"bigint": 1, "double": 1.0}.get(f.dataType.simpleString(), "x")).cast(f.dataType).alias(f.name) for f in events.schema if f.name != "ts"}
                latest.select(*(F.col("ts") if c == "ts" else others[c] for c in events.columns)).write.mode("append").parquet(tail)
            running = out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
            running.awaitTermination()
    finally:
        spark.conf.set(store, before) if before else spark.conf.unset(store)
    return spark.read.schema(out.schema).parquet(path)
