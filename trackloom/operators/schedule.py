"""Schedules and health figures from events, fix sequences and compressed flights."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars


def last_per_flight(frame: DataFrame, order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("flight_id").orderBy(F.desc(order)))
    return frame.withColumn("rank", rank).where("rank = 1").drop("rank")


def departures(events: DataFrame) -> DataFrame:
    out = events.where("operation = 'departure'").orderBy("event_time", "flight_id")
    return out.select("flight_id", "callsign", "icao24", F.col("event_time").alias("departure_time"), F.col("event_time_utc").alias("departure_time_utc"), "runway")


def arrivals_with_sequences(events: DataFrame, sequences: DataFrame) -> DataFrame:
    """Arrivals with their sequence columns where there are any; a repeated sequence repeats the arrival."""
    some = sequences.select("flight_id", "first_time", "last_time", "fix_sequence", "fix_count")
    return events.where(F.lower("operation") == "arrival").join(some, "flight_id", "left")


def arrivals(events: DataFrame, sequences: DataFrame, trajectories: DataFrame, order: str = "ordinal") -> DataFrame:
    """Arrivals that have a sequence and a trajectory; the last of several counts. The time is the sequence's first."""
    one = last_per_flight(sequences, order).select("flight_id", "first_time", "fix_sequence", "fix_count")
    held = last_per_flight(trajectories, order).drop(order, "callsign", "icao24", "first_time")
    joined = events.where("operation = 'arrival'").join(one, "flight_id").join(held, "flight_id")
    extra = [c for c in held.columns if c != "flight_id"]
    return joined.select(
        "flight_id",
        "callsign",
        "icao24",
        F.col("first_time").alias("arrival_time"),
        scalars.iso_utc(F.col("first_time")).alias("arrival_time_utc"),
        "runway",
        F.col("fix_sequence").alias("original_fix_sequence"),
        F.col("fix_count").alias("original_fix_count"),
        *extra,
    ).orderBy("arrival_time", "flight_id")


def health(events: DataFrame, sequences: DataFrame, trajectories: DataFrame) -> DataFrame:
    """One row of counts: each id is looked at once, flagged by where it occurs."""
    flag = lambda df, name: df.select("flight_id").distinct().withColumn(name, F.lit(True))
    ids = flag(events.where("operation = 'arrival'"), "arrives").join(flag(events.where("operation = 'departure'"), "departs"), "flight_id", "full_outer")
    ids = ids.join(flag(sequences, "fixed"), "flight_id", "full_outer").join(flag(trajectories, "flown"), "flight_id", "full_outer")
    missing = lambda a, b: F.count_if(F.col(a).isNotNull() & F.col(b).isNull())
    counts = ids.agg(
        F.count("fixed").alias("fix_sequences_count"),
        F.count("flown").alias("compressed_flights_count"),
        missing("arrives", "fixed").alias("arrivals_missing_fix_sequences_count"),
        missing("arrives", "flown").alias("arrivals_missing_trajectories_count"),
        missing("departs", "flown").alias("departures_missing_trajectories_count"),
        F.count("departs").alias("skipped_departures_count"),
    )
    rows = events.agg(F.count("*").alias("events_count"), F.count_if(F.col("operation") == "arrival").alias("arrivals_count"), F.count_if(F.col("operation") == "departure").alias("departures_count"))
    return rows.crossJoin(counts)


def intervention_diff(spark) -> DataFrame:
    """The log of interventions; none are made yet."""
    return spark.createDataFrame([], "flight_id string, field string, before string, after string")


def apply_diff(trajectories: DataFrame, diff: DataFrame) -> DataFrame:
    """Trajectories with the last logged value of each text field that the log names; an empty log changes nothing."""
    fields = [c for c, kind in trajectories.dtypes if kind == "string" and c != "flight_id"]
    patch = diff.groupBy("flight_id").agg(*(F.max(F.when(F.col("field") == c, F.col("after"))).alias(f"new_{c}") for c in fields))
    joined = trajectories.join(patch, "flight_id", "left")
    return joined.select(*(F.coalesce(f"new_{c}", c).alias(c) if c in fields else c for c in trajectories.columns))


def skipped(rows: DataFrame, reason: str) -> DataFrame:
    """Rows of a manifest for flights that were not made: no points, and the reason."""
    none = {"first_time": F.lit(None).cast("long"), "last_time": F.lit(None).cast("long")}
    none |= {c: F.lit(0) for c in ("raw_point_count", "compressed_point_count", "lateral_breakpoint_count", "altitude_breakpoint_count")}
    return rows.select(*(F.col(c).cast("string").alias(c) for c in ("flight_id", "callsign", "icao24"))).withColumns(none | {"status": F.lit("skipped"), "reason": F.lit(reason)})


def manifest(results: DataFrame) -> DataFrame:
    """One row of totals: counts by status, and points of generated flights."""
    made = F.col("status") == "generated"
    total = lambda c: F.coalesce(F.sum(F.when(made, F.col(c))), F.lit(0))
    return results.agg(F.count_if(made).alias("generated_count"), F.count_if(~made).alias("skipped_count"), total("raw_point_count").alias("raw_points"), total("compressed_point_count").alias("compressed_points"))


def manifest_flights(results: DataFrame) -> DataFrame:
    """The flights of a manifest, a row each, in order of status, first time (none counts as 0) and id."""
    return results.orderBy("status", F.coalesce("first_time", F.lit(0)), "flight_id").select("status", "flight_id", "first_time", "raw_point_count", "compressed_point_count", "reason")
