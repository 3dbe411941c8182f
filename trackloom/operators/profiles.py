"""Constraint profiles: several piecewise-linear curves on one grid, tightened by altitude constraints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import interp
from trackloom.shared import dealt


def sampled(nodes: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """wanted (keys, s and others) with the curve's value and slope at s, from nodes (keys, s, y; one a place).

    Nodes and wanted rows are sorted together by key, so any number of either will do. Values are held at the ends; the slope is that of
    the segment that holds s (at a node, of the one on its left; beyond an end, of the last one there) and 0 for a single
    node. A key without nodes, or a null s, gives nulls.
    """
    by = Window.partitionBy(*keys)
    order = by.orderBy("s")
    rise = lambda s, y: (F.col("y") - y) / (F.col("s") - s)
    marked = nodes.where("s is not null").withColumns({"left_": rise(F.lag("s").over(order), F.lag("y").over(order)), "right_": rise(F.lead("s").over(order), F.lead("y").over(order))})
    node = F.struct("s", F.col("y").cast("double").alias("y"), "left_", "right_").alias("node_")
    asked = wanted.select(*keys, F.col("s").alias("at_"), F.struct(*wanted.columns).alias("row_"))
    both = asked.unionByName(marked.select(*keys, F.col("s").alias("at_"), node), allowMissingColumns=True)
    asks = F.col("row_").isNotNull()
    side = lambda way: F.last("node_", True).over(by.orderBy(way, asks).rowsBetween(Window.unboundedPreceding, 0))
    met = both.withColumns({"before_": side(F.asc("at_")), "after_": side(F.desc("at_"))}).where(asks)
    a, b = F.coalesce("before_", "after_"), F.coalesce("after_", "before_")
    slope = F.coalesce(F.col("after_.left_"), F.col("after_.right_"), F.col("before_.left_"), F.lit(0.0))
    known = F.col("at_").isNotNull() & a.isNotNull()
    return met.select("row_.*", F.when(known, interp.between(a["s"], a["y"], b["s"], b["y"], F.col("at_"))).alias("value"), F.when(known, slope).alias("slope"))


def filled(rows: DataFrame, keys: list[str], curves: list[str]) -> DataFrame:
    """Rows (keys, s, curves, others) with nulls of a curve taken from the line between its neighbours, its ends held.

    One shuffle by keys and one sort serve both neighbours; at each s at most one row. A curve without a value stays null, as
    does a row without s, which is no neighbour either.
    """
    partition, node = ", ".join(f"`{k}`" for k in keys), "IF(`{c}` IS NOT NULL AND `s` IS NOT NULL, `{x}`, NULL)"
    near = lambda way, c, x: F.expr(f"{way}({node.format(c=c, x=x)}) IGNORE NULLS OVER (PARTITION BY {partition} ORDER BY `s`)")
    values = rows.withColumns({c: F.col(c).cast("double") for c in curves})
    sides = values.withColumns({f"{c}_{way}_{x}": near(way, c, y) for c in curves for way in ("lag", "lead") for x, y in (("s", "s"), ("y", c))})

    def value(c: str) -> Column:
        s0, y0, s1, y1 = (F.col(f"{c}_{way}_{x}") for way in ("lag", "lead") for x in "sy")
        inner = interp.between(s0, y0, s1, y1, F.col("s"))
        return F.when(F.col("s").isNotNull(), F.coalesce(F.col(c), inner, y0, y1))

    return sides.select(*(value(c).alias(c) if c in curves else c for c in rows.columns))


def on_merged_grid(nodes: DataFrame, key: str, curve: str) -> DataFrame:
    """Every curve of a key at every node that any of its curves has: (key, curve, s, value)."""
    grid = nodes.select(key, curve).distinct().join(nodes.select(key, "s").distinct(), key)
    rows = grid.join(nodes.select(key, curve, "s", F.col("y").alias("value")), [key, curve, "s"], "left")
    return filled(rows, [key, curve], ["value"])


PAIR = (("lower", "upper"),)


def tighten(envelope: DataFrame, constraints: DataFrame, key: str, pairs: tuple[tuple[str | None, str | None], ...] = PAIR, rows: int = 0) -> DataFrame:
    """(key, s, curves) on the union of its grid and the constraints', within both.

    pairs names the lower and upper curves, such as (h_lower, h_upper) or (None, cl_max). Constraints at one s
    count together (largest lower, smallest upper); a curve that they lack is not tightened. Between nodes the
    envelope is linear. crossed marks rows where a lower curve is above its upper. Keys without an envelope have
    no rows. rows is about how many rows both have, if known: tasks then stay of one size.
    """
    curves = [c for pair in pairs for c in pair if c]
    lows = {low for low, _ in pairs if low}
    given = [c for c in curves if c in constraints.columns]
    nulls = lambda names: [F.lit(None).cast("double").alias(c) for c in names]
    ours = envelope.select(key, "s", *(F.col(c).cast("double").alias(c) for c in curves), *nulls(f"{c}_limit" for c in given))
    theirs = constraints.select(key, "s", *nulls(curves), *(F.col(c).cast("double").alias(f"{c}_limit") for c in given))
    # One shuffle by key serves the union of both grids, the search for keys with an envelope, and the lines.
    merged = dealt(ours.unionByName(theirs), key, rows=rows).groupBy(key, "s").agg(*(F.max(c).alias(c) for c in curves), *((F.max if c in lows else F.min)(f"{c}_limit").alias(f"{c}_limit") for c in given))
    whole = Window.partitionBy(key).orderBy("s").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    owned = merged.withColumn("own", F.max(F.coalesce(*curves).isNotNull()).over(whole))
    line = filled(owned, [key], curves).where("own")
    met = {c: (F.greatest if c in lows else F.least)(F.col(c), F.col(f"{c}_limit")) for c in given}
    out = line.withColumns(met).select(key, "s", *curves)
    crossed = [F.coalesce(F.col(low) > F.col(high), F.lit(False)) for low, high in pairs if low and high]
    return out.withColumn("crossed", F.greatest(F.lit(False), F.lit(False), *crossed))


def strictly_increasing(nodes: DataFrame, key: str, s: str = "s", order: str = "idx") -> DataFrame:
    """Per key whether s rises from row to row."""
    step = F.col(s) - F.lag(s).over(Window.partitionBy(key).orderBy(order))
    return nodes.withColumn("step", step).groupBy(key).agg(F.coalesce(F.bool_and(F.col("step") > 0), F.lit(True)).alias("increasing"))


def well_ordered(nodes: DataFrame, key: str, s: str = "s", t: str = "t", order: str = "idx") -> DataFrame:
    """Per key whether it has two rows or more, s rises from row to row, and t never falls."""
    by = Window.partitionBy(key).orderBy(order)
    steps = nodes.withColumns({"ds_": F.col(s) - F.lag(s).over(by), "dt_": F.col(t) - F.lag(t).over(by)})
    return steps.groupBy(key).agg((F.count("*") >= 2).alias("enough"), F.coalesce(F.bool_and(F.col("ds_") > 0), F.lit(True)).alias("rises"), F.coalesce(F.bool_and(F.col("dt_") >= 0), F.lit(True)).alias("in_time"))


def constraints_by_fix(rows: DataFrame, procedure: str, transition: str) -> DataFrame:
    """(fix_identifier, lower_ft, upper_ft) of one procedure's legs: two altitudes bound, one fixes."""
    from trackloom.functions import scalars

    own = rows.where((F.upper("sid_star_approach_identifier") == procedure.upper()) & (F.upper("transition_identifier") == transition.upper()) & scalars.clean(F.col("fix_identifier")).isNotNull())
    own = own.withColumns({"a": scalars.altitude_ft(F.col("altitude")), "b": scalars.altitude_ft(F.col("altitude_2"))}).where("a is not null or b is not null")
    return own.select(F.upper(F.trim("fix_identifier")).alias("fix_identifier"), F.least("a", "b").alias("lower_ft"), F.greatest("a", "b").alias("upper_ft"))
