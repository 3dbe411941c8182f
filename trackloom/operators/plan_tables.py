"""Tables of whole plans made from others: node grids, constraint envelopes, splices and extensions.

Each works on any number of plans or routes at once, by one shuffle on their id. None simulates: rows are
counted out, moved by offsets or placed on lines between given ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import flight, scalars
from trackloom.operators import profiles

# Distances at which a grid always has a node, beside both ends and the gates.
ANCHORS_M = (8_000.0, 30_000.0, 60_000.0)


def apportioned(weights: Column, nodes: Column) -> Column:
    """Counts of nodes for the gaps of the given weights (array of doubles above 0), two or more each, for `nodes` in all.

    Neighbouring gaps share a node. Shares are rounded half to even; what is too much is taken from the largest
    count, one by one, and what is missing is given to the heaviest gap. With fewer nodes than two a gap asks for, all
    have two.
    """
    size = F.size(weights)
    share = lambda w, total: w / total * (nodes + size)
    total = F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)
    first = F.transform(weights, lambda w: F.greatest(F.rint(share(w, total)).cast("int"), F.lit(2)))
    held = lambda counts: F.aggregate(counts, F.lit(0), lambda a, c: a + c) - size + 1

    def less(counts: Column, _: Column) -> Column:
        at = F.array_position(counts, F.array_max(counts)) - 1
        return F.transform(counts, lambda c, i: F.when((i == at) & (c > 2), c - 1).otherwise(c))

    over = F.greatest(held(first) - nodes, F.lit(0))
    steps = F.when(over > 0, F.sequence(F.lit(1), F.greatest(over, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    cut = F.aggregate(steps, first, less)
    heaviest = F.array_position(weights, F.array_max(weights)) - 1
    return F.transform(cut, lambda c, i: F.when(i == heaviest, c + F.greatest(nodes - held(cut), F.lit(0))).otherwise(c))


def even(a: Column, b: Column, k: Column, n: Column) -> Column:
    """The k-th (from 0) of n values spread evenly from a to b, both included."""
    return F.when(k == n - 1, b).otherwise(a + (b - a) / F.greatest(n - 1, F.lit(1)) * k)


def node_grid(routes: DataFrame) -> DataFrame:
    """(route_id, idx, s): distances of a plan's nodes, denser where little distance holds much change.

    routes has route_id, length_m, nodes (2 or more), final_gate_m and approach_gate_m. The gates and ANCHORS_M
    that a route reaches always are nodes; the rest are shared out over the gaps between them by the square root of
    their width. With no more nodes than anchors they are spread evenly instead.
    """
    length, nodes = F.col("length_m"), F.col("nodes").cast("int")
    stops = F.array(F.lit(0.0), *(F.least(F.lit(a), length) for a in ANCHORS_M), F.least("final_gate_m", length), F.least("approach_gate_m", length), length)
    anchored = routes.withColumn("stops", F.array_sort(F.array_distinct(stops))).withColumn("gaps", F.transform(F.slice("stops", F.lit(2), F.size("stops")), lambda b, i: F.sqrt(F.greatest(b - F.get(F.col("stops"), i), F.lit(1.0)))))
    few = (F.size("stops") >= nodes) | (F.size("gaps") == 0)
    plain = F.transform(F.sequence(F.lit(0), nodes - 1), lambda k: even(F.lit(0.0), length, k, nodes))
    counted = anchored.withColumn("counts", F.when(~few, apportioned(F.col("gaps"), nodes)))

    def piece(count: Column, g: Column) -> Column:
        a, b = F.get(F.col("stops"), g), F.get(F.col("stops"), g + 1)
        return F.transform(F.sequence(F.when(g == 0, 0).otherwise(1), count - 1), lambda k: even(a, b, k, count))

    s = F.when(few, plain).otherwise(F.flatten(F.transform("counts", piece)))
    return counted.select("route_id", F.posexplode(s).alias("idx", "s"))


# Fixed values of an envelope: margins about thresholds and schedule, and flight path angles in degrees at the gates.
CAPTURE_M, REACH_M = 5_000.0, 60_000.0
ABOVE_THRESHOLD_FT, ABOVE_UPSTREAM_FT, ABOUT_SCHEDULE_KT = 500.0, 2_000.0, 80.0
GAMMA_LOWER_DEG = (-3.8, -4.2, -6.0, -6.0)
GAMMA_UPPER_DEG = (-2.2, -2.0, -0.2, 0.25)


def envelope(routes: DataFrame, schedule: DataFrame, constraints: DataFrame, places: DataFrame) -> DataFrame:
    """Bounds of height, calibrated airspeed and flight path angle along many routes: (route_id, s, six curves, crossed).

    routes: route_id, type, length_m, threshold_h, upstream_h, threshold_cas, upstream_cas_kt, final_gate_m, approach_gate_m.
    schedule: type, s, cas; linear, held at its ends. constraints: route_id, fix_identifier, lower_ft, upper_ft
    (either may be null). places: route_id, identifier, s; a constraint whose fix has no place is left out. Every curve
    is linear between its own nodes and stands at every node that any curve has. crossed marks a height constraint
    that the envelope cannot meet. A route whose type has no schedule has null speeds.
    """
    far = F.greatest("length_m", F.lit(REACH_M))
    final = F.least(F.greatest("final_gate_m", F.lit(0.0)), far)
    approach = F.least(F.greatest(F.col("approach_gate_m"), final), far)
    top = F.col("upstream_h") + scalars.ft_to_m(F.lit(ABOVE_UPSTREAM_FT))
    heights = [(F.lit(0.0), F.col("threshold_h"), F.col("threshold_h") + scalars.ft_to_m(F.lit(ABOVE_THRESHOLD_FT))), (F.least(F.lit(CAPTURE_M), far), F.col("threshold_h"), top), (far, F.col("threshold_h"), top)]
    own = routes.select("route_id", F.inline(F.array(*(F.struct(s.alias("s"), low.alias("h_lower"), high.alias("h_upper")) for s, low, high in heights))))
    at = places.select("route_id", F.upper("identifier").alias("fix"), F.col("s"))
    placed = constraints.withColumn("fix", F.upper("fix_identifier")).join(at, ["route_id", "fix"]).where("lower_ft is not null or upper_ft is not null")
    limits = placed.select("route_id", "s", scalars.ft_to_m(F.col("lower_ft")).alias("h_lower"), scalars.ft_to_m(F.col("upper_ft")).alias("h_upper"))
    height = profiles.tighten(own, limits, "route_id", (("h_lower", "h_upper"),))

    steps = [(F.lit(0.0), 0), (final, 1), (approach, 2), (far, 3)]
    bends = routes.select("route_id", F.inline(F.array(*(F.struct(s.alias("s"), F.lit(k).alias("k"), F.radians(F.lit(GAMMA_LOWER_DEG[k])).alias("gamma_lower"), F.radians(F.lit(GAMMA_UPPER_DEG[k])).alias("gamma_upper")) for s, k in steps))))
    bends = bends.groupBy("route_id", "s").agg(F.max_by("gamma_lower", "k").alias("gamma_lower"), F.max_by("gamma_upper", "k").alias("gamma_upper"))

    speeds = routes.select("route_id", "type", "threshold_cas", scalars.kts_to_mps(F.col("upstream_cas_kt")).alias("upstream_cas"))
    timed = speeds.join(schedule, "type").select("route_id", "threshold_cas", "upstream_cas", "s", "cas")
    end = routes.select("route_id", "threshold_cas", scalars.kts_to_mps(F.col("upstream_cas_kt")).alias("upstream_cas"), far.alias("s"), F.lit(None).cast("double").alias("cas"))
    nodes = timed.unionByName(end).groupBy("route_id", "threshold_cas", "upstream_cas", "s").agg(F.max("cas").alias("cas"))
    nodes = profiles.filled(nodes, ["route_id"], ["cas"])
    about = scalars.kts_to_mps(F.lit(ABOUT_SCHEDULE_KT))
    wide = lambda side, least: F.when(F.col("cas").isNotNull(), F.greatest(F.col("cas") + side * about, F.col(least)))
    speed = nodes.select("route_id", "s", wide(-1, "threshold_cas").alias("cas_lower"), wide(1, "upstream_cas").alias("cas_upper"))

    curves = ["h_lower", "h_upper", "cas_lower", "cas_upper", "gamma_lower", "gamma_upper"]
    every = height.drop("crossed").unionByName(speed, True).unionByName(bends, True)
    merged = every.groupBy("route_id", "s").agg(*(F.max(c).alias(c) for c in curves))
    return profiles.filled(merged, ["route_id"], curves).withColumn("crossed", F.coalesce(F.col("h_lower") > F.col("h_upper"), F.lit(False)))


def splice(first: DataFrame, second: DataFrame, *, key: str = "plan_id", order: str = "idx", carried: tuple[str, ...] = ("t", "distance"), phase: str | None = None) -> DataFrame:
    """The rows of first, then those of second with the carried columns moved on by first's last ones; order counts anew from 0.

    The row that both share is kept once: second's first goes where second has another one and first has any. phase, if given,
    is the phase of all of second's rows. A key that only one table has keeps its rows as they are. Both have the same columns.
    """
    rank = F.row_number().over(Window.partitionBy(key).orderBy(order))
    size = F.count("*").over(Window.partitionBy(key))
    ends = first.groupBy(key).agg(F.count("*").alias("n_first"), *(F.max_by(c, order).alias(f"last_{c}") for c in carried))
    own = second.withColumns({"rank_": rank, "size_": size}).join(ends, key, "left")
    own = own.where(F.col("n_first").isNull() | (F.col("rank_") > 1) | (F.col("size_") == 1))
    moved = own.withColumns({c: F.col(c) + F.coalesce(f"last_{c}", F.lit(0.0)) for c in carried} | ({"phase": F.lit(phase)} if phase else {}))
    both = first.withColumn("part_", F.lit(0)).unionByName(moved.select(*second.columns, F.lit(1).alias("part_")))
    place = F.row_number().over(Window.partitionBy(key).orderBy("part_", order)) - 1
    return both.withColumn("place_", place).select(*(F.col("place_").alias(order) if c == order else c for c in first.columns))


def splice_totals(first: DataFrame, second: DataFrame, *, key: str = "plan_id", order: str = "idx", carried: tuple[str, ...] = ("t", "distance")) -> DataFrame:
    """Per key the last carried values of each part: first_t, second_t and so on; 0 for a part without rows."""
    last = lambda df, name: df.groupBy(key).agg(*(F.max_by(c, order).alias(f"{name}_{c}") for c in carried))
    both = last(first, "first").join(last(second, "second"), key, "full_outer")
    return both.select(key, *(F.coalesce(f"{part}_{c}", F.lit(0.0)).alias(f"{part}_{c}") for part in ("first", "second") for c in carried))


def extend(plans: DataFrame, starts: DataFrame, *, nodes: int = 12, most_jump_kt: float = 5.0, drag: Column | None = None) -> DataFrame:
    """Plans led on, level, to the starts they have to reach: their rows, the new ones, and `outcome` on every row.

    plans: plan_id, idx, s, h, v (true airspeed), cas, t, gamma, thrust, phase, and any others, which are null on new rows; starts: plan_id, start_s, start_cas_kt,
    upstream_h, one a plan. outcome is `reached` (the start lies on the plan, or there is none), `rejected` (the airspeed
    would jump by more than most_jump_kt; jump_kt says by how much) or `extended`. Only the last adds rows: `nodes` at even
    distances up to the start, at upstream_h and the start's airspeed, without wind. drag gives their thrust from phase, v and h.
    """
    last = plans.groupBy("plan_id").agg(F.max_by(F.struct("idx", "s", "cas", "t"), "idx").alias("last"))
    met = last.join(starts, "plan_id", "left")
    cas = scalars.kts_to_mps(F.col("start_cas_kt"))
    jump = F.abs(scalars.mps_to_kts(F.col("last.cas") - cas))
    outcome = F.when(F.col("start_s").isNull() | (F.col("start_s") <= F.col("last.s") + 1e-6), "reached").when(jump > most_jump_kt, "rejected").otherwise("extended")
    judged = met.withColumns({"outcome": outcome, "jump_kt": F.when(outcome != "reached", jump)})
    k = F.explode(F.sequence(F.lit(1), F.lit(nodes)))
    v = flight.tas_of(cas, F.col("upstream_h"), F.lit(0.0))
    made = judged.where("outcome = 'extended'").withColumn("k", k).withColumns({"v": v, "cas": cas, "h": F.col("upstream_h").cast("double"), "gamma": F.lit(0.0)})
    ahead = (F.col("start_s") - F.col("last.s")) / nodes * F.col("k")
    made = made.withColumns({"idx": F.col("last.idx") + F.col("k"), "s": F.when(F.col("k") == nodes, F.col("start_s")).otherwise(F.col("last.s") + ahead), "t": F.col("last.t") + ahead / F.greatest("v", F.lit(1.0))})
    made = made.withColumn("phase", flight.mode_at(F.col("s"))).withColumn("thrust", F.lit(None).cast("double") if drag is None else drag)
    names = ["plan_id", "idx", "s", "h", "v", "cas", "t", "gamma", "thrust", "phase"]
    own = plans.join(judged.select("plan_id", "outcome", "jump_kt"), "plan_id")
    return own.unionByName(made.select(*names, "outcome", "jump_kt"), allowMissingColumns=True)
