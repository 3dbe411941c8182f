"""Checks of descent plans as column arithmetic: defects, margins, objective terms and phase totals.

A plan is rows (plan_id, idx, s, h, v, t, gamma, thrust) in order of idx, s being distance to go. Lateral
checks also take cross (metres off the path), heading_error, bank and roll (its rate), and the path's track
and curvature.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import flight


def rates(nodes: DataFrame, mass: float, area: float, cd0: float, k: float, wind_along: float = 0.0, delta_isa: float = 0.0) -> DataFrame:
    """Adds dh_ds, dv_ds and dt_ds of the three states by distance to go."""
    lit = F.lit
    drag = flight.drag_n(lit(cd0), lit(k), lit(mass), lit(area), F.col("v"), F.col("h"), F.col("gamma"), lit(0.0), lit(delta_isa))
    r = flight.distance_rates(F.col("v"), F.col("gamma"), F.col("thrust"), drag, lit(mass), lit(wind_along))
    return nodes.withColumn("r", r).select("*", "r.*").drop("r")


def lateral_rates(nodes: DataFrame, least_along: float = 1.0) -> DataFrame:
    """Adds along (speed along the path) and dt_ds, dcross_ds, dheading_error_ds and dbank_ds.

    Rows also hold wind_east and wind_north; track is measured from east towards north.
    """
    v, course = F.greatest(F.col("v"), F.lit(1.0)), F.col("track") + F.col("heading_error")
    east, north = v * F.cos(course) + F.col("wind_east"), v * F.sin(course) + F.col("wind_north")
    own = nodes.withColumns({"v_": v, "along": F.greatest(east * F.cos("track") + north * F.sin("track"), F.lit(least_along)), "across": north * F.cos("track") - east * F.sin("track")})
    turn = flight.heading_rate(F.col("bank"), F.col("v_"))
    rate = {"dt_ds": 1.0 / F.col("along"), "dcross_ds": -F.col("across") / F.col("along"), "dheading_error_ds": F.col("curvature") - turn / F.col("along"), "dbank_ds": -F.col("roll") / F.col("along")}
    return own.withColumns(rate).drop("v_", "across")


def defects(with_rates: DataFrame, states: tuple[str, ...] = ("h", "v", "t")) -> DataFrame:
    """Trapezoid defect of each state over each interval: plan_id, idx, s, and defect_h and so on."""
    order = Window.partitionBy("plan_id").orderBy("idx")
    ds = F.lead("s").over(order) - F.col("s")
    gap = lambda x, dx: F.lead(x).over(order) - F.col(x) - 0.5 * ds * (F.col(dx) + F.lead(dx).over(order))
    out = with_rates.withColumns({f"defect_{x}": gap(x, f"d{x}_ds") for x in states} | {"following": F.lead("idx").over(order)})
    return out.where("following is not null").select("plan_id", "idx", "s", *(f"defect_{x}" for x in states))


def endpoint_defects(nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """What a plan's first and last rows have above what is wanted: plan_id, end, state, defect.

    wanted is rows (plan_id, end, state, value) with end first or last; a plan without rows has no defects.
    """
    numbers = [c for c, kind in nodes.dtypes if kind == "double"]
    ends = nodes.groupBy("plan_id").agg(*(f(F.struct(*numbers), "idx").alias(n) for n, f in (("first", F.min_by), ("last", F.max_by))))
    # One row a plan meets what is wanted of it, and the state is picked there.
    met = ends.hint("merge").join(wanted, "plan_id")
    found, named = F.lit(None).cast("double"), F.lit(False)
    for e in ("first", "last"):
        for c in numbers:
            here = (F.col("end") == e) & (F.col("state") == c)
            found, named = F.when(here, F.col(e)[c]).otherwise(found), named | here
    return met.where(named).select("plan_id", "end", "state", (found - F.col("value")).alias("defect"))


def worst_defects(of: DataFrame) -> DataFrame:
    """Per plan and state the largest absolute defect and where it is (the first, of equal ones)."""
    states = [c.removeprefix("defect_") for c in of.columns if c.startswith("defect_")]
    # Aggregated as they stand, one row a plan; only then a row a state.
    best = of.groupBy("plan_id").agg(*(F.max(F.struct(F.abs(f"defect_{x}").alias("size"), (-F.col("idx")).alias("back"), "s")).alias(x) for x in states))
    return best.select("plan_id", F.inline(F.array(*(F.struct(F.lit(x).alias("state"), F.col(x)["size"].alias("worst"), F.col(x)["s"].alias("at_s")) for x in states))))


@dataclass(frozen=True)
class Limits:
    """Limits of a whole plan; None leaves a family out. slack maps a quantity to what one unit of slack is worth."""

    idle_share: float | None = None
    descend_only: bool = False
    gamma_deg_per_km: float | None = None
    gamma_deg_per_km2: float | None = None
    slack: dict[str, float] = field(default_factory=dict)


BOUNDED = ("h", "v", "cas", "thrust", "bank", "roll", "along", "gamma", "cl")


def margin_families(columns: list[str], limits: Limits = Limits()) -> dict[str, Column]:
    """Name and margin of every family that the columns and limits call for; a margin below 0 breaks it.

    A quantity is bounded where x_lower or x_upper is a column, a plan's last row also by x_end_lower and
    x_end_upper. Rows with a column slack (0 or more, one number a plan) have their margins widened by it.
    """
    order = Window.partitionBy("plan_id").orderBy("idx")
    ahead = lambda c, n=1: F.lead(c, n).over(order)
    give = lambda x: F.col("slack") * limits.slack.get(x, 0.0) if "slack" in columns else F.lit(0.0)
    last = ahead("idx").isNull()
    found = {}
    for x in BOUNDED:
        for side, margin in (("above lower", lambda b, x=x: F.col(x) - F.col(b)), ("below upper", lambda b, x=x: F.col(b) - F.col(x))):
            bound = side.split()[1]
            if f"{x}_{bound}" in columns:
                found[f"{x} {side}"] = margin(f"{x}_{bound}") + give(x)
            if f"{x}_end_{bound}" in columns:
                found[f"{x} {side} at end"] = F.when(last, margin(f"{x}_end_{bound}") + give(x))
    if limits.idle_share is not None:
        band = F.col("idle") + limits.idle_share * F.greatest(F.col("thrust_upper") - F.col("idle"), F.lit(0.0))
        found |= {"thrust above idle": F.col("thrust") - F.col("idle"), "thrust in idle band": band - F.col("thrust")}
    if limits.descend_only:
        found["no climb"] = ahead("h") - F.col("h") + give("h")
    step = F.greatest(F.abs(ahead("s") - F.col("s")), F.lit(1.0)) / 1000.0
    if limits.gamma_deg_per_km is not None:
        most, change = math.radians(limits.gamma_deg_per_km) * step, ahead("gamma") - F.col("gamma")
        found |= {"gamma rise": most - change + give("gamma"), "gamma fall": most + change + give("gamma")}
    if limits.gamma_deg_per_km2 is not None:
        most, bend = math.radians(limits.gamma_deg_per_km2) * step * step, ahead("gamma", 2) - 2.0 * ahead("gamma") + F.col("gamma")
        found |= {"gamma bend up": most - bend + give("gamma"), "gamma bend down": most + bend + give("gamma")}
    return found | {"time order": ahead("t") - F.col("t")}


def margins(nodes: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Per plan and family the smallest margin, where it is (the first, of equal ones), and whether the family holds.

    Time must not fall as distance to go rises. Families without a margin in a plan have no row of it.
    """
    families = margin_families(nodes.columns, limits)
    names = {n: f"m{k}" for k, n in enumerate(families)}
    wide = nodes.select("plan_id", "idx", "s", *(m.alias(names[n]) for n, m in families.items()))
    # Rows stand in order of their plan: one pass makes a row a plan, and only that becomes a row a family.
    best = wide.groupBy("plan_id").agg(*(F.min(F.when(F.col(c).isNotNull(), F.struct(F.col(c).alias("margin"), "idx", "s"))).alias(c) for c in names.values()))
    long = best.select("plan_id", F.explode(F.array(*(F.struct(F.lit(n).alias("family"), F.col(c).alias("l")) for n, c in names.items()))).alias("x")).select("plan_id", "x.*").where("l is not null")
    return long.select("plan_id", "family", F.col("l.margin").alias("least_margin"), F.col("l.s").alias("at_s"), (F.col("l.margin") >= 0).alias("holds"))


def objective(nodes: DataFrame) -> DataFrame:
    """Means and peaks of a plan's controls, with their changes from node to node."""
    order = Window.partitionBy("plan_id").orderBy("idx")
    own = nodes.withColumns({"dg": F.col("gamma") - F.lag("gamma").over(order), "dthrust": F.col("thrust") - F.lag("thrust").over(order)})
    return own.groupBy("plan_id").agg(
        F.avg("thrust").alias("mean_thrust"), F.sqrt(F.avg(F.col("gamma") * F.col("gamma"))).alias("rms_gamma"), F.max(F.abs("gamma")).alias("peak_gamma"),
        F.avg(F.col("dg") * F.col("dg")).alias("gamma_roughness"), F.avg(F.col("dthrust") * F.col("dthrust")).alias("thrust_roughness"), (F.max("t") - F.min("t")).alias("duration"), F.count("*").alias("nodes"),
    )


@dataclass(frozen=True)
class Weights:
    """Weights of the terms of a plan's cost."""

    reach: float = 1.0
    thrust: float = 1.0
    gamma: float = 1.0
    cross: float = 1.0
    heading_error: float = 1.0
    bank: float = 1.0
    roll: float = 1.0
    slack: float = 1.0


# What counts as one unit of heading error and of bank, and the least cross-track unit.
HEADING_UNIT_DEG = 5.0
BANK_UNIT_DEG = 20.0
CROSS_UNIT_M = 100.0


def cost(nodes: DataFrame, weights: Weights, thrust_unit: float, roll_unit: float, idle_band: bool = False) -> DataFrame:
    """A plan's cost: total, its terms, the peaks behind them and the units they are measured in; one row a plan.

    Rows also hold idle, cross, heading_error, bank, roll and slack. A longer descent is a gain, so reach counts
    below zero. A plan of one row has no change of angle. Where an idle band already bounds the thrust (idle_band), thrust
    costs nothing and a longer descent is a loss.
    """
    order = Window.partitionBy("plan_id").orderBy("idx")
    own = nodes.withColumns({"dg": F.col("gamma") - F.lag("gamma").over(order), "over": F.col("thrust") - F.col("idle")})
    square = lambda c: F.avg(F.col(c) * F.col(c)).alias(f"{c}_2")
    peak = lambda c: F.coalesce(F.max(F.abs(c)), F.lit(0.0)).alias(f"peak_{c}")
    quantities = ("over", "dg", "cross", "heading_error", "bank", "roll")
    sums = own.groupBy("plan_id").agg(F.max("s").alias("reach_m"), F.count("*").alias("nodes"), F.max("slack").alias("slack"), *(f(c) for c in quantities for f in (square, peak)))
    unit = {"ds": F.greatest(F.col("reach_m") / F.greatest(F.col("nodes") - 1, F.lit(1)), F.lit(1.0)), "thrust_unit": F.lit(max(thrust_unit, 1.0)), "cross_unit": F.greatest(F.col("peak_cross"), F.lit(CROSS_UNIT_M)), "heading_unit_deg": F.lit(HEADING_UNIT_DEG), "bank_unit_deg": F.lit(BANK_UNIT_DEG), "roll_unit": F.lit(max(roll_unit, 1e-3))}
    km = F.col("reach_m") / 1000.0
    scaled = lambda c, u: F.col(f"{c}_2") / (u * u)
    terms = {
        "reach_term": (weights.reach if idle_band else -weights.reach) * km,
        "thrust_term": F.lit(0.0) if idle_band else weights.thrust * km * scaled("over", F.col("thrust_unit")),
        "gamma_term": F.coalesce(weights.gamma * scaled("dg", F.radians(F.lit(1.0)) * F.col("ds") / 1000.0), F.lit(0.0)),
        "cross_term": weights.cross * scaled("cross", F.col("cross_unit")),
        "heading_error_term": weights.heading_error * scaled("heading_error", F.radians("heading_unit_deg")),
        "bank_term": weights.bank * scaled("bank", F.radians("bank_unit_deg")),
        "roll_term": weights.roll * scaled("roll", F.col("roll_unit")),
        "slack_term": weights.slack * F.col("slack") * F.col("slack"),
    }
    peaks = {"rms_over_idle": F.sqrt("over_2"), "peak_over_idle": F.col("peak_over"), "peak_gamma_step_deg": F.degrees("peak_dg"), "peak_cross_m": F.col("peak_cross"), "peak_heading_error_deg": F.degrees("peak_heading_error"), "peak_bank_deg": F.degrees("peak_bank"), "peak_roll_rate": F.col("peak_roll")}
    with_terms = sums.withColumns(unit).withColumns(terms)
    total = sum((F.col(c) for c in list(terms)[1:]), F.col("reach_term"))
    return with_terms.select("plan_id", total.alias("total"), *terms, *(v.alias(n) for n, v in peaks.items()), *unit)


def phase_spans(rows: DataFrame) -> DataFrame:
    """Runs of equal phase: plan_id, span, phase, first and last idx."""
    order = Window.partitionBy("plan_id").orderBy("idx")
    changed = F.coalesce((F.col("phase") != F.lag("phase").over(order)).cast("int"), F.lit(0))
    spans = rows.withColumn("changed", changed).withColumn("span", F.sum("changed").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return spans.groupBy("plan_id", "span", "phase").agg(F.min("idx").alias("first_idx"), F.max("idx").alias("last_idx"))


def phase_totals(rows: DataFrame) -> DataFrame:
    """Time and distance by phase; the interval to the next row belongs to the row's phase, the last row to none."""
    order = Window.partitionBy("plan_id").orderBy("idx")
    own = rows.withColumns({"dt": F.lead("t").over(order) - F.col("t"), "ds": F.abs(F.lead("s").over(order) - F.col("s"))}).where("dt is not null")
    return own.groupBy("plan_id", "phase").agg(F.sum("dt").alias("time_s"), F.sum("ds").alias("distance_m"))


def time_profile(nodes: DataFrame, wind_along: float = 0.0) -> DataFrame:
    """Adds time from the plan's first node at the mean ground speed of each interval."""
    order = Window.partitionBy("plan_id").orderBy("idx")
    ground = flight.ground_speed(F.col("v"), F.lit(wind_along))
    own = nodes.withColumn("ground", ground)
    step = F.abs(F.col("s") - F.lag("s").over(order)) / (0.5 * (F.col("ground") + F.lag("ground").over(order)))
    own = own.withColumn("step", F.coalesce(step, F.lit(0.0)))
    return own.withColumn("elapsed", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("ground", "step")


def usable(metrics: DataFrame, residual: float = 2e-2, replay: float = 500.0) -> DataFrame:
    """Whether a plan may be used: it succeeded, and slack, defects and replay error are within bounds."""
    ok = F.col("success") & (F.col("max_slack") <= residual) & (F.col("max_defect") <= residual) & (F.col("replay_error") <= replay)
    return metrics.withColumn("usable", F.coalesce(ok, F.lit(False)))


def around(nodes: DataFrame, centre: DataFrame, window: int) -> DataFrame:
    """Rows at most window places from each plan's centre (plan_id, centre_idx)."""
    return nodes.join(centre, "plan_id").where(F.abs(F.col("idx") - F.col("centre_idx")) <= window).drop("centre_idx")


def polar_fit(samples: DataFrame, keys: list[str]) -> DataFrame:
    """Least squares drag coefficient = cd0 + k * lift coefficient squared, by mode; one partial sum per group is shuffled."""
    x = F.col("cl") * F.col("cl")
    return samples.groupBy(*keys).agg(F.regr_intercept("cd", x).alias("cd0"), F.regr_slope("cd", x).alias("k"), F.count("*").alias("samples"))
