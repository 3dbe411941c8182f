"""Queries over plans and routes as tables: lookups, node grids, envelopes, splices, extensions and payloads, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import flight
from trackloom.operators import compress, lookup, plan_tables, routes, verify
from trackloom.plans import fixture
from trackloom.plans.fixture import read
from trackloom.plans.queries import LATERAL, LINES, PLANS, RHO, query

# Weather: nations are the nodes of a level of distance and height, at four times.

WEATHER = lookup.weather(lookup.Axis("s", 2000.0, 6000.0, 5), lookup.Axis("h", 0.0, 500.0, 5), lookup.Axis("t", 50.0, 100.0, 4))


def weather_nodes(spark: SparkSession, d: str) -> DataFrame:
    key = F.col("n_nationkey")
    nodes = read(spark, d, "nation").withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(3))))
    s, h, t = F.floor(key / 5) * 6000.0 + 2000.0, key % 5 * 500.0, F.col("k") * 100.0 + 50.0
    return nodes.select(s.alias("s"), h.alias("h"), t.alias("t"), (key * 1.5 - F.col("k") * 3.0).alias("wind_east"), (F.lit(20.0) - key * F.col("k") * 0.25).alias("wind_north"), (F.col("n_regionkey") * 2.0 - F.col("k")).alias("delta_isa"))


CORNERS = [(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)]


def trilinear(value: str) -> str:
    weights = (f"(CASE WHEN {b} = 1 THEN f{a} ELSE 1.0 - f{a} END)" for a, b in zip("sht", ("cs", "ch", "ct")))
    return f"round(sum({' * '.join(weights)} * {value}), 9) AS {value}"


@query(
    f"""WITH {PLANS}, w AS (SELECT n_nationkey // 5 AS i, n_nationkey % 5 AS j, k, n_nationkey * 1.5::DOUBLE - k * 3.0::DOUBLE AS wind_east, 20.0::DOUBLE - n_nationkey * k * 0.25::DOUBLE AS wind_north, n_regionkey * 2.0::DOUBLE - k AS delta_isa FROM nation, range(4) r(k)),
p AS (SELECT plan_id, idx, least(greatest((s - 2000.0) / 6000.0, 0.0), 4.0)::DOUBLE AS ps, least(greatest(h / 500.0, 0.0), 4.0)::DOUBLE AS ph, least(greatest((t - 50.0) / 100.0, 0.0), 3.0)::DOUBLE AS pt FROM node),
c AS (SELECT *, least(floor(ps), 3)::BIGINT AS i0, least(floor(ph), 3)::BIGINT AS j0, least(floor(pt), 2)::BIGINT AS k0 FROM p), f AS (SELECT *, ps - i0 AS fs, ph - j0 AS fh, pt - k0 AS ft FROM c)
SELECT plan_id, idx, {trilinear("wind_east")}, {trilinear("wind_north")}, {trilinear("delta_isa")}
FROM f, (VALUES {", ".join(map(str, CORNERS))}) x(cs, ch, ct) JOIN w ON w.i = i0 + cs AND w.j = j0 + ch AND w.k = k0 + ct GROUP BY plan_id, idx"""
)
def plan_weather(spark: SparkSession, d: str) -> DataFrame:
    found = WEATHER.sample(fixture.plan_nodes(spark, d).select("plan_id", "idx", "s", "h", "t"), weather_nodes(spark, d))
    return found.select("plan_id", "idx", *(F.round(c, 9).alias(c) for c in WEATHER.values))


# Performance: a table of type and mode by height and speed; types are regions.

PERFORMANCE = lookup.performance(lookup.Axis("h", 0.0, 800.0, 3), lookup.Axis("v", 60.0, 20.0, 5))


def performance_nodes(spark: SparkSession, d: str) -> DataFrame:
    modes = F.explode(F.array(*(F.struct(F.lit(m).alias("mode"), F.lit(k).alias("m")) for k, m in enumerate(("final", "approach", "clean")))))
    nodes = read(spark, d, "region").select(F.col("r_regionkey").alias("type"), modes.alias("x")).select("type", "x.*")
    nodes = nodes.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(2)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(4))))
    k, m, i, j = (F.col(c) for c in ("type", "m", "i", "j"))
    return nodes.select("type", "mode", (i * 800.0).alias("h"), (j * 20.0 + 60.0).alias("v"), (k * 100.0 + m * 50.0 - i * 200.0 + 8000.0).alias("idle"), (k * 300.0 - i * 500.0 - j * 100.0 + 13500.0).alias("thrust_upper"), (m * 80.0 + j * j * 150.0 + 9000.0).alias("drag"))


def performed_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Lateral plan nodes with idle and greatest thrust and drag from the table, by their plan's type."""
    nodes = fixture.lateral_plan_nodes(spark, d).drop("idle").withColumns({"type": F.col("plan_id") % 5, "mode": F.col("phase")})
    return PERFORMANCE.sample(nodes, performance_nodes(spark, d))


def bilinear(value: str) -> str:
    weights = (f"(CASE WHEN {b} = 1 THEN f{a} ELSE 1.0 - f{a} END)" for a, b in zip("hv", ("ch", "cv")))
    return f"sum({' * '.join(weights)} * {value}) AS {value}"


PERFORMED = f"""{LATERAL}, perf AS (SELECT r_regionkey AS type, mode, i, j, r_regionkey * 100.0::DOUBLE + m * 50.0::DOUBLE - i * 200.0::DOUBLE + 8000.0 AS idle, r_regionkey * 300.0::DOUBLE - i * 500.0::DOUBLE - j * 100.0::DOUBLE + 13500.0 AS thrust_upper, m * 80.0::DOUBLE + j * j * 150.0::DOUBLE + 9000.0 AS drag
  FROM region, (VALUES ('final', 0), ('approach', 1), ('clean', 2)) x(mode, m), range(3) a(i), range(5) b(j)),
placed AS (SELECT plan_id, idx, plan_id % 5 AS type, phase, least(greatest(h / 800.0, 0.0), 2.0)::DOUBLE AS ph, least(greatest((v - 60.0) / 20.0, 0.0), 4.0)::DOUBLE AS pv FROM node),
celled AS (SELECT *, least(floor(ph), 1)::BIGINT AS i0, least(floor(pv), 3)::BIGINT AS j0 FROM placed), parts AS (SELECT *, ph - i0 AS fh, pv - j0 AS fv FROM celled),
looked AS (SELECT plan_id, idx, {bilinear("idle")}, {bilinear("thrust_upper")}, {bilinear("drag")}
  FROM parts p, (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) x(ch, cv) JOIN perf ON perf.type = p.type AND perf.mode = p.phase AND perf.i = i0 + ch AND perf.j = j0 + cv GROUP BY plan_id, idx),
flown AS (SELECT node.* EXCLUDE (idle), looked.idle, looked.thrust_upper, looked.drag FROM node JOIN looked USING (plan_id, idx))"""


@query(f"WITH {PERFORMED} SELECT plan_id, idx, round(idle, 6) AS idle, round(thrust_upper, 6) AS thrust_upper, round(drag, 6) AS drag FROM flown")
def plan_performance(spark: SparkSession, d: str) -> DataFrame:
    return performed_nodes(spark, d).select("plan_id", "idx", *(F.round(c, 6).alias(c) for c in PERFORMANCE.values))


@query(
    f"""WITH {PERFORMED}, m AS (SELECT plan_id, idx, s, unnest([{{'f': 'thrust below upper', 'm': thrust_upper - thrust}}, {{'f': 'thrust above idle', 'm': thrust - idle}}, {{'f': 'thrust in idle band', 'm': idle + 0.6::DOUBLE * greatest(thrust_upper - idle, 0.0) - thrust}}, {{'f': 'time order', 'm': lead(t) OVER (PARTITION BY plan_id ORDER BY idx) - t}}]) AS q FROM flown)
SELECT plan_id, q.f AS family, round(min(q.m), 6) AS least_margin, min(round(q.m, 6)) >= 0 AS holds FROM m WHERE q.m IS NOT NULL GROUP BY 1, 2"""
)
def performance_margins(spark: SparkSession, d: str) -> DataFrame:
    """Margins with thrust bounds by lookup in place of constants."""
    found = verify.margins(performed_nodes(spark, d).drop("slack"), verify.Limits(idle_share=0.6))
    return found.select("plan_id", "family", F.round("least_margin", 6).alias("least_margin"), (F.round("least_margin", 6) >= 0).alias("holds"))


@query(
    f"""WITH {PERFORMED}, a AS (SELECT plan_id, max(s) AS reach, avg((thrust - idle) * (thrust - idle)) AS o2, max(abs(thrust - idle)) AS po FROM flown GROUP BY 1)
SELECT plan_id, round(3.0::DOUBLE * reach / 1000.0 * o2 / 1e8::DOUBLE, 10) AS thrust_term, round(sqrt(o2), 6) AS rms_over_idle, round(po, 6) AS peak_over_idle FROM a"""
)
def performance_cost(spark: SparkSession, d: str) -> DataFrame:
    """A plan's thrust term with idle thrust by lookup in place of constants."""
    found = verify.cost(performed_nodes(spark, d), verify.Weights(thrust=3.0), 10_000.0, 0.05)
    return found.select("plan_id", *(F.round(c, 10 if c == "thrust_term" else 6).alias(c) for c in ("thrust_term", "rms_over_idle", "peak_over_idle")))


# Paths: a customer's orders are samples of its path; every order also asks for a state on it or between two of them.

SAMPLED = """sample AS (SELECT o_custkey AS route_id, o_orderkey::DOUBLE AS s, o_totalprice AS east_m, (o_orderkey % 97)::DOUBLE AS north_m, (o_orderkey % 63 - 31) / 10.0::DOUBLE AS track_rad, (o_orderkey % 7) / 1000.0::DOUBLE AS curvature FROM orders),
state AS (SELECT o_custkey AS route_id, o_orderkey AS state_id, o_orderkey + (o_orderkey % 4) / 7.0::DOUBLE AS s, (o_orderkey % 41 - 20)::DOUBLE AS cross_track_m, (o_orderkey % 5) / 10.0::DOUBLE AS heading_offset_rad FROM orders)"""


def path_samples(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    return read(spark, d, "orders").select(F.col("o_custkey").alias("route_id"), k.cast("double").alias("s"), F.col("o_totalprice").alias("east_m"), (k % 97).cast("double").alias("north_m"), ((k % 63 - 31) / F.lit(10.0)).alias("track_rad"), (k % 7 / F.lit(1000.0)).alias("curvature"))


def line_sql(c: str, wrapped: bool = False) -> str:
    high = f"a.{c} + atan2(sin(b.{c} - a.{c}), cos(b.{c} - a.{c}))" if wrapped else f"b.{c}"
    value = f"CASE WHEN a.s = b.s THEN a.{c} ELSE a.{c} + ({high} - a.{c}) * (s - a.s) / (b.s - a.s) END"
    return f"atan2(sin({value}), cos({value}))" if wrapped else value


@query(
    f"""WITH {SAMPLED}, lo AS (SELECT state.*, CASE WHEN sample.s IS NOT NULL THEN sample END AS before FROM state ASOF LEFT JOIN sample ON state.route_id = sample.route_id AND state.s >= sample.s),
hi AS (SELECT lo.*, CASE WHEN sample.s IS NOT NULL THEN sample END AS after FROM lo ASOF LEFT JOIN sample ON lo.route_id = sample.route_id AND lo.s <= sample.s),
met AS (SELECT * EXCLUDE (before, after), coalesce(before, after) AS a, coalesce(after, before) AS b FROM hi),
r AS (SELECT state_id, route_id, cross_track_m AS x, heading_offset_rad AS o, {line_sql("east_m")} AS e, {line_sql("north_m")} AS n, {line_sql("track_rad", True)} AS k, {line_sql("curvature")} AS c FROM met)
SELECT state_id, route_id, round(e, 6) AS ref_east_m, round(k, 9) AS ref_track_rad, round(c, 9) AS ref_curvature, round(0.0 - sin(k), 9) AS normal_east, round(cos(k), 9) AS normal_north, round(e - x * sin(k), 6) AS east_m, round(n + x * cos(k), 6) AS north_m, round(atan2(sin(k + o), cos(k + o)), 9) AS psi_rad FROM r"""
)
def path_states(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    states = read(spark, d, "orders").select(F.col("o_custkey").alias("route_id"), k.alias("state_id"), (k + k % 4 / F.lit(7.0)).alias("s"), (k % 41 - 20).cast("double").alias("cross_track_m"), (k % 5 / F.lit(10.0)).alias("heading_offset_rad"))
    found = routes.on_path(path_samples(spark, d), states)
    places = {"ref_east_m": 6, "ref_track_rad": 9, "ref_curvature": 9, "normal_east": 9, "normal_north": 9, "east_m": 6, "north_m": 6, "psi_rad": 9}
    return found.select("state_id", "route_id", *(F.round(c, n).alias(c) for c, n in places.items()))


# Routes of customers with a length of 5 to 300 km.

ROUTES = "route AS (SELECT c_custkey AS route_id, 5000.0::DOUBLE + abs(c_acctbal) * 30.0::DOUBLE AS length_m, (5 + c_custkey % 60)::INT AS nodes, 12000.0::DOUBLE AS final_gate_m, 35000.0::DOUBLE + c_custkey % 3 * 1000.0::DOUBLE AS approach_gate_m, c_nationkey AS nation FROM customer)"


def customer_lengths(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, d, "customer").select(k.alias("route_id"), (F.abs("c_acctbal") * 30.0 + 5000.0).alias("length_m"), (k % 60 + 5).cast("int").alias("nodes"), F.lit(12_000.0).alias("final_gate_m"), (k % 3 * 1000.0 + 35_000.0).alias("approach_gate_m"), F.col("c_nationkey").alias("nation"))


@query(
    f"""WITH {ROUTES}, s AS (SELECT *, list_sort(list_distinct([0.0::DOUBLE, least(8000.0, length_m), least(30000.0, length_m), least(60000.0, length_m), least(final_gate_m, length_m), least(approach_gate_m, length_m), length_m])) AS stops FROM route),
g AS (SELECT *, [sqrt(greatest(stops[i + 1] - stops[i], 1.0)) for i in range(1, len(stops))] AS gaps FROM s),
w AS (SELECT *, [greatest(round_even(x / list_sum(gaps) * (nodes + len(gaps)), 0)::INT, 2) for x in gaps] AS first FROM g),
o AS (SELECT *, list_reduce(list_prepend(first, [[k::INT] for k in range(greatest(list_sum(first) - len(first) + 1 - nodes, 0)::BIGINT)]), lambda c, k: [CASE WHEN i = list_position(c, list_max(c)) AND c[i] > 2 THEN c[i] - 1 ELSE c[i] END for i in range(1, len(c) + 1)]) AS cut FROM w),
c AS (SELECT *, [CASE WHEN i = list_position(gaps, list_max(gaps)) THEN cut[i] + greatest(nodes - (list_sum(cut) - len(cut) + 1), 0) ELSE cut[i] END for i in range(1, len(cut) + 1)] AS counts FROM o),
p AS (SELECT route_id, g, stops[g] AS a, stops[g + 1] AS b, counts[g] AS n FROM (SELECT *, unnest(range(1, len(counts) + 1)) AS g FROM c WHERE len(stops) < nodes)
  UNION ALL SELECT route_id, 1, 0.0, length_m, nodes FROM c WHERE len(stops) >= nodes),
k AS (SELECT route_id, g, a, b, n, unnest(range(CASE WHEN g = 1 THEN 0 ELSE 1 END, n::BIGINT)) AS k FROM p)
SELECT route_id, (row_number() OVER (PARTITION BY route_id ORDER BY g, k) - 1)::INT AS idx, round(CASE WHEN k = n - 1 THEN b ELSE a + (b - a) / (n - 1) * k END, 6) AS s FROM k"""
)
def node_grid(spark: SparkSession, d: str) -> DataFrame:
    return plan_tables.node_grid(customer_lengths(spark, d)).withColumn("s", F.round("s", 6))


# Envelopes: schedules by nation, constraints from orders at suppliers' places.


def envelope_inputs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    lengths = customer_lengths(spark, d)
    own = lengths.select("route_id", F.col("nation").alias("type"), "length_m", (F.col("route_id") % 10 * 20.0).alias("threshold_h"), (F.col("route_id") % 7 * 100.0 + 3000.0).alias("upstream_h"), F.lit(65.0).alias("threshold_cas"), (F.col("route_id") % 5 * 4.0 + 240.0).alias("upstream_cas_kt"), "final_gate_m", "approach_gate_m")
    n = F.col("n_nationkey")
    steps = F.inline(F.array(*(F.struct((F.lit(s) + n * 10.0).alias("s"), (F.lit(c) + n).alias("cas")) for s, c in ((0.0, 70.0), (15_000.0, 90.0), (45_000.0, 115.0)))))
    schedule = read(spark, d, "nation").select(n.alias("type"), steps)
    k = F.col("o_orderkey")
    orders = read(spark, d, "orders")
    constraints = orders.select(F.col("o_custkey").alias("route_id"), F.concat(F.lit("fx"), k % 6).alias("fix_identifier"), F.when(F.col("o_orderstatus") != "O", k % 50 * 20.0).alias("lower_ft"), F.when(F.col("o_orderstatus") != "F", k % 50 * 20.0 + 4000.0).alias("upper_ft"))
    places = read(spark, d, "customer").select(F.col("c_custkey").alias("route_id"), F.inline(F.array(*(F.struct(F.lit(f"FX{i}").alias("identifier"), (F.col("c_custkey") % 4 * 500.0 + i * 2500.0).alias("s")) for i in range(5)))))
    return own, schedule, constraints, places


def filled_sql(nodes: str, curves: list[str]) -> str:
    """SQL of profiles.filled over a table (route_id, s, curves): lo and hi nodes of each curve by windows."""
    up, down = "(PARTITION BY route_id ORDER BY s ROWS UNBOUNDED PRECEDING)", "(PARTITION BY route_id ORDER BY s DESC ROWS UNBOUNDED PRECEDING)"
    node = lambda c: f"CASE WHEN {c} IS NOT NULL THEN {{'s': s, 'y': {c}}} END"
    sides = ", ".join(f"last_value({node(c)} IGNORE NULLS) OVER {up} AS lo_{c}, last_value({node(c)} IGNORE NULLS) OVER {down} AS hi_{c}" for c in curves)
    value = lambda c: f"CASE WHEN lo_{c} IS NULL THEN hi_{c}.y WHEN hi_{c} IS NULL OR lo_{c}.s = hi_{c}.s THEN lo_{c}.y ELSE lo_{c}.y + (hi_{c}.y - lo_{c}.y) * (s - lo_{c}.s) / (hi_{c}.s - lo_{c}.s) END AS {c}"
    return f"(SELECT * EXCLUDE ({', '.join(curves)}, {', '.join(f'lo_{c}, hi_{c}' for c in curves)}), {', '.join(map(value, curves))} FROM (SELECT *, {sides} FROM {nodes}))"


SIX = ["h_lower", "h_upper", "cas_lower", "cas_upper", "gamma_lower", "gamma_upper"]
KNOT = "(1852.0::DOUBLE / 3600.0::DOUBLE)"


@query(
    f"""WITH {ROUTES}, r AS (SELECT *, greatest(length_m, 60000.0) AS far, route_id % 10 * 20.0::DOUBLE AS th, route_id % 7 * 100.0::DOUBLE + 3000.0 + 2000.0::DOUBLE * 0.3048::DOUBLE AS top, (route_id % 5 * 4.0::DOUBLE + 240.0) * 0.514444::DOUBLE AS up FROM route),
alt AS (SELECT route_id, 0.0::DOUBLE AS s, th AS h_lower, th + 500.0::DOUBLE * 0.3048::DOUBLE AS h_upper FROM r UNION ALL SELECT route_id, 5000.0, th, top FROM r UNION ALL SELECT route_id, far, th, top FROM r),
con AS (SELECT o_custkey AS route_id, o_custkey % 4 * 500.0::DOUBLE + o_orderkey % 6 * 2500.0::DOUBLE AS s, max(CASE WHEN o_orderstatus <> 'O' THEN o_orderkey % 50 * 20.0::DOUBLE END) * 0.3048::DOUBLE AS low, min(CASE WHEN o_orderstatus <> 'F' THEN o_orderkey % 50 * 20.0::DOUBLE + 4000.0 END) * 0.3048::DOUBLE AS high FROM orders WHERE o_orderkey % 6 < 5 AND o_custkey IN (SELECT c_custkey FROM customer) GROUP BY 1, 2),
grid AS (SELECT coalesce(alt.route_id, con.route_id) AS route_id, coalesce(alt.s, con.s) AS s, h_lower, h_upper FROM alt FULL JOIN con ON alt.route_id = con.route_id AND alt.s = con.s),
height AS (SELECT f.route_id, f.s, greatest(f.h_lower, coalesce(low, f.h_lower)) AS h_lower, least(f.h_upper, coalesce(high, f.h_upper)) AS h_upper FROM {filled_sql("grid", SIX[:2])} f LEFT JOIN con USING (route_id, s)),
bend AS (SELECT route_id, s, arg_max(radians(low), k) AS gamma_lower, arg_max(radians(high), k) AS gamma_upper FROM (SELECT route_id, unnest([0.0, least(final_gate_m, far), least(greatest(approach_gate_m, final_gate_m), far), far]) AS s, unnest([0, 1, 2, 3]) AS k, unnest([-3.8, -4.2, -6.0, -6.0])::DOUBLE AS low, unnest([-2.2, -2.0, -0.2, 0.25])::DOUBLE AS high FROM r) GROUP BY 1, 2),
sched AS (SELECT route_id, s, max(cas) AS cas FROM (SELECT route_id, unnest([0.0, 15000.0, 45000.0, NULL])::DOUBLE + nation * 10.0::DOUBLE AS s, unnest([70.0, 90.0, 115.0, NULL])::DOUBLE + nation AS cas FROM r UNION ALL SELECT route_id, far, NULL FROM r) WHERE s IS NOT NULL GROUP BY 1, 2),
speed AS (SELECT f.route_id, f.s, greatest(cas - 80.0::DOUBLE * 0.514444::DOUBLE, 65.0) AS cas_lower, greatest(cas + 80.0::DOUBLE * 0.514444::DOUBLE, up) AS cas_upper FROM {filled_sql("sched", ["cas"])} f JOIN r USING (route_id)),
merged AS (SELECT route_id, s, {", ".join(f"max({c}) AS {c}" for c in SIX)} FROM (SELECT * FROM height UNION ALL BY NAME SELECT * FROM speed UNION ALL BY NAME SELECT * FROM bend) GROUP BY 1, 2)
SELECT route_id, s, {", ".join(f"round({c}, 8) AS {c}" for c in SIX)}, h_lower > h_upper AS crossed FROM {filled_sql("merged", SIX)}"""
)
def route_envelopes(spark: SparkSession, d: str) -> DataFrame:
    found = plan_tables.envelope(*envelope_inputs(spark, d))
    return found.select("route_id", "s", *(F.round(c, 8).alias(c) for c in SIX), "crossed")


# Splices: level flight from the lines of large quantity, descents from the others; either may be missing.

SPLICED = f"""line AS (SELECT * FROM {LINES}), one AS (SELECT l_orderkey AS plan_id, l_linenumber AS idx, l_linenumber * 30.0::DOUBLE AS t, l_linenumber * 2500.0::DOUBLE AS distance, l_quantity AS h, 'level' AS phase FROM line WHERE l_quantity > 25),
two AS (SELECT l_orderkey AS plan_id, l_linenumber AS idx, l_linenumber * 20.0::DOUBLE AS t, l_linenumber * 1500.0::DOUBLE AS distance, l_quantity AS h, CASE WHEN l_linenumber % 2 = 0 THEN 'hold' ELSE 'descent' END AS phase FROM line WHERE l_quantity <= 25),
ends AS (SELECT plan_id, arg_max(t, idx) AS t1, arg_max(distance, idx) AS d1 FROM one GROUP BY 1)"""


def histories(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    line, i = fixture.lines(spark, d), F.col("l_linenumber")

    def part(rows: DataFrame, seconds: float, metres: float, phase: object) -> DataFrame:
        return rows.select(F.col("l_orderkey").alias("plan_id"), i.alias("idx"), (i * seconds).alias("t"), (i * metres).alias("distance"), F.col("l_quantity").alias("h"), phase.alias("phase"))

    return part(line.where("l_quantity > 25"), 30.0, 2500.0, F.lit("level")), part(line.where("l_quantity <= 25"), 20.0, 1500.0, F.when(i % 2 == 0, "hold").otherwise("descent"))


def splice_sql(phase: str) -> str:
    return f"""WITH {SPLICED}, x AS (SELECT two.*, row_number() OVER (PARTITION BY plan_id ORDER BY idx) AS r, count(*) OVER (PARTITION BY plan_id) AS n FROM two),
u AS (SELECT plan_id, 0 AS part, idx, t, distance, h, phase FROM one UNION ALL SELECT plan_id, 1, idx, t + coalesce(t1, 0.0), distance + coalesce(d1, 0.0), h, {phase} FROM x LEFT JOIN ends USING (plan_id) WHERE t1 IS NULL OR r > 1 OR n = 1)
SELECT plan_id, (row_number() OVER (PARTITION BY plan_id ORDER BY part, idx) - 1)::INT AS idx, t, distance, h, phase FROM u"""


@query(splice_sql("'descent'"))
def spliced_plans(spark: SparkSession, d: str) -> DataFrame:
    return plan_tables.splice(*histories(spark, d), phase="descent")


@query(splice_sql("phase"))
def spliced_holds(spark: SparkSession, d: str) -> DataFrame:
    """The same with the second part's own phases kept."""
    return plan_tables.splice(*histories(spark, d))


@query(
    f"""WITH {SPLICED}, e2 AS (SELECT plan_id, arg_max(t, idx) AS t2, arg_max(distance, idx) AS d2 FROM two GROUP BY 1)
SELECT plan_id, coalesce(t1, 0.0) AS first_t, coalesce(d1, 0.0) AS first_distance, coalesce(t2, 0.0) AS second_t, coalesce(d2, 0.0) AS second_distance FROM ends FULL JOIN e2 USING (plan_id)"""
)
def splice_totals(spark: SparkSession, d: str) -> DataFrame:
    return plan_tables.splice_totals(*histories(spark, d))


# Extensions: starts from orders; a third of them lie on the plan, others ask for another speed.

STARTS = "start AS (SELECT o_orderkey AS plan_id, 20000.0::DOUBLE + o_custkey % 5 * 6000.0::DOUBLE AS start_s, 130.0::DOUBLE + o_orderkey % 16 * 16.0::DOUBLE AS start_cas_kt, 2000.0::DOUBLE + o_custkey % 10 * 100.0::DOUBLE AS upstream_h FROM orders)"
CAS_NODES = PLANS.replace("SELECT l_orderkey AS plan_id,", "SELECT l_orderkey AS plan_id, 60.0::DOUBLE + l_linenumber * 8.0::DOUBLE AS cas,", 1)


@query(
    f"""WITH {CAS_NODES}, {STARTS}, e AS (SELECT plan_id, max(idx) AS li, arg_max(s, idx) AS ls, arg_max(cas, idx) AS lc, arg_max(t, idx) AS lt FROM node GROUP BY 1),
j AS (SELECT *, abs(lc / 0.514444::DOUBLE - start_cas_kt) AS jump FROM e LEFT JOIN start USING (plan_id)),
o AS (SELECT *, CASE WHEN start_s IS NULL OR start_s <= ls + 1e-6 THEN 'reached' WHEN jump > 5.0 THEN 'rejected' ELSE 'extended' END AS outcome, start_cas_kt * 0.514444::DOUBLE AS c FROM j),
m AS (SELECT *, c * sqrt(1.225::DOUBLE / greatest({RHO.format(h='upstream_h', d='0.0')}, 1e-9)) AS v, unnest(range(1, 13)) AS k FROM o WHERE outcome = 'extended'),
n AS (SELECT *, (start_s - ls) / 12 * k AS ahead FROM m)
SELECT plan_id, idx, s, h, round(v, 6) AS v, round(cas, 6) AS cas, round(t, 6) AS t, gamma, phase, outcome, round(CASE WHEN outcome <> 'reached' THEN jump END, 6) AS jump_kt FROM node JOIN o USING (plan_id)
UNION ALL SELECT plan_id, (li + k)::INT, CASE WHEN k = 12 THEN start_s ELSE ls + ahead END, upstream_h, round(v, 6), round(c, 6), round(lt + ahead / greatest(v, 1.0), 6), 0.0, CASE WHEN ls + ahead <= 12000 THEN 'final' WHEN ls + ahead <= 35000 THEN 'approach' ELSE 'clean' END, outcome, round(jump, 6) FROM n"""
)
def extended_plans(spark: SparkSession, d: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    starts = read(spark, d, "orders").select(k.alias("plan_id"), (c % 5 * 6000.0 + 20_000.0).alias("start_s"), (k % 16 * 16.0 + 130.0).alias("start_cas_kt"), (c % 10 * 100.0 + 2000.0).alias("upstream_h"))
    plans = fixture.plan_nodes(spark, d).withColumn("cas", F.col("idx") * 8.0 + 60.0)
    found = plan_tables.extend(plans, starts, drag=flight.drag_n(*(F.lit(x) for x in (0.02, 0.045, 60_000.0, 122.6)), F.col("v"), F.col("h"), F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    return found.select("plan_id", "idx", "s", "h", *(F.round(x, 6).alias(x) for x in ("v", "cas", "t")), "gamma", "phase", "outcome", F.round("jump_kt", 6).alias("jump_kt"))


# Payloads: samples of plans at whole and half seconds.


def plan_payload_tracks(spark: SparkSession, d: str) -> DataFrame:
    line, i = fixture.lines(spark, d), F.col("l_linenumber")
    flight_id = F.concat(F.lit("P"), F.col("l_orderkey").cast("string"))
    samples = line.select(flight_id.alias("flight_id"), i.alias("idx"), (F.floor(F.col("l_quantity") / 10) * 0.5 + F.floor(i / 2)).alias("t"), (F.col("l_partkey") % 100 / F.lit(1000.0) + 32.8).alias("lat"), (F.col("l_suppkey") % 100 / F.lit(1000.0) - 97.1).alias("lon"), (F.col("l_quantity") * 20.0).alias("h"))
    k = F.col("o_orderkey").cast("string")
    starts = read(spark, d, "orders").select(F.concat(F.lit("P"), k).alias("flight_id"), F.concat(F.lit("S"), k).alias("callsign"), F.lit("abc").alias("icao24"), (F.col("o_custkey") * 10).alias("seed_time"))
    return compress.resampled(samples, starts)


RESAMPLED = f"""track AS (SELECT * FROM (SELECT concat('S', l_orderkey) AS callsign, l_partkey % 100 / 1000.0::DOUBLE + 32.8::DOUBLE AS lat, l_suppkey % 100 / 1000.0::DOUBLE - 97.1::DOUBLE AS lon, concat('P', l_orderkey) AS flight_id, round_even(o_custkey * 10 + floor(l_quantity / 10) * 0.5::DOUBLE + floor(l_linenumber / 2), 0)::BIGINT AS time, l_linenumber AS ordinal, l_quantity * 20.0::DOUBLE AS geoaltitude FROM {LINES} JOIN orders ON o_orderkey = l_orderkey)
  QUALIFY row_number() OVER (PARTITION BY flight_id, time ORDER BY ordinal DESC) = 1)"""


@query(f"WITH {RESAMPLED} SELECT flight_id, time, ordinal::BIGINT AS ordinal, geoaltitude FROM track")
def resampled_plans(spark: SparkSession, d: str) -> DataFrame:
    return plan_payload_tracks(spark, d).select("flight_id", "time", "ordinal", "geoaltitude")


@query()
def plan_payloads(spark: SparkSession, d: str) -> DataFrame:
    whole = plan_payload_tracks(spark, d)
    return compress.compressed_flights(whole, compress.compress(whole, 2000.0, 200.0), 2000.0, 200.0)
