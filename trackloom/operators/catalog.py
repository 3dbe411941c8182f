"""Catalogs of arrivals and departures: cleaning, range pruning, union, and differences between two of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import scalars


def authoritative(flights: DataFrame, airport: str) -> DataFrame:
    """Distinct arrivals and departures of an airport from (callsign, icao24, firstseen, lastseen, origin, destination)."""

    def side(kind: str, place: str, time: str) -> DataFrame:
        some = flights.where((F.col(place) == airport) & F.col(time).isNotNull() & (F.trim("callsign") != "") & (F.trim("icao24") != ""))
        return some.select(F.lit(kind).alias("flight_type"), F.trim("callsign").alias("callsign"), F.trim("icao24").alias("icao24"), F.col(time).cast("long").alias("event_time")).distinct()

    return side("arrival", "destination", "lastseen").unionByName(side("departure", "origin", "firstseen"))


def cleaned(catalog: DataFrame) -> DataFrame:
    """Trimmed rows with flight_id, one per flight_type and flight: the first by callsign, address and time."""
    rows = catalog.select(*(F.trim(c).alias(c) for c in ("flight_type", "callsign", "icao24")), "event_time")
    rows = rows.withColumn("flight_id", scalars.flight_id(F.col("callsign"), F.col("icao24")))
    order = Window.partitionBy("flight_type", "flight_id").orderBy("callsign", "icao24", "event_time")
    return rows.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def pruned(catalog: DataFrame, from_epoch: int, to_epoch: int) -> DataFrame:
    """Rows whose event time is a number within the range, with event_time_utc as a timestamp."""
    time = F.col("event_time").cast("string").try_cast("double").cast("long")
    return catalog.withColumn("event_time", time).where(F.col("event_time").between(from_epoch, to_epoch)).withColumn("event_time_utc", F.timestamp_seconds("event_time"))


def keys(frame: DataFrame, kind: str) -> DataFrame:
    """Distinct kind|base callsign|lower-case address."""
    return frame.select(F.concat_ws("|", F.trim(kind), scalars.base_callsign(F.col("callsign")), F.lower(F.trim("icao24"))).alias("catalog_key")).distinct()


def difference(derived: DataFrame, other: DataFrame, examples: int = 5) -> DataFrame:
    """One row per side: number of keys only there (and shared), and the first keys in order."""
    a, b = keys(derived, "operation"), keys(other, "flight_type")
    both = a.withColumn("in_a", F.lit(1)).join(b.withColumn("in_b", F.lit(1)), "catalog_key", "full_outer")
    side = F.when(F.col("in_b").isNull(), "derived only").when(F.col("in_a").isNull(), "authoritative only").otherwise("shared")
    sided = both.select("catalog_key", side.alias("side"))
    counts = sided.groupBy("side").agg(F.count("*").alias("keys"))
    first = sided.where("side <> 'shared'").withColumn("rank", F.row_number().over(Window.partitionBy("side").orderBy("catalog_key"))).where(F.col("rank") <= examples)
    shown = first.groupBy("side").agg(F.array_join(F.array_sort(F.collect_list("catalog_key")), ",").alias("examples"))
    return counts.join(shown, "side", "left").select("side", "keys", F.coalesce("examples", F.lit("")).alias("examples"))
