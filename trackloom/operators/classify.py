"""Flight segments as arrivals, departures, overflights or neither.

A point hits a threshold if it is within the radius and not above the ceiling. Only hits meet the
thresholds (a grid join); distances of a segment's ends are computed once per threshold that it hits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geo, scalars
from trackloom.operators.proximity import near

# Fixed value: 10,000 ft.
CEILING_M = 3048.0


def classify(rows: DataFrame, segments: DataFrame, thresholds: DataFrame, radius_m: float = 5000.0, floor_m: float = 500.0) -> DataFrame:
    """One row per segment: classification and, for arrivals and departures, the threshold event.

    rows: segment rows with rn; segments: source_flight, segment and ids of all segments, also those
    without valid rows; thresholds: runway, place_lat, place_lon, place_ord.

    A threshold's event is the first hit. It is an arrival if the segment's start was at least as much
    further away than its end will be, a departure otherwise; less than floor_m either way is none. The
    threshold with the largest change wins, then the nearest event, then the lowest place_ord.
    """
    key = ["source_flight", "segment"]
    point = F.struct("rn", "time", "lat", "lon", "geoaltitude")
    hits = near(rows.select(*key, "rn", "time", "lat", "lon", "geoaltitude"), thresholds, radius_m).withColumn("low", F.coalesce(F.col("geoaltitude") <= CEILING_M, F.lit(False)))
    first = hits.groupBy(*key, "place_ord").agg(F.min(F.when(F.col("low"), F.struct("rn", "distance_m", "time", "lat", "lon", "geoaltitude"))).alias("event"), F.first("runway").alias("runway"), F.first("place_lat").alias("place_lat"), F.first("place_lon").alias("place_lon"), F.max("low").alias("low"))
    ends = rows.groupBy(*key).agg(F.min(point).alias("a"), F.max(point).alias("z"), F.count("*").alias("valid_rows"))
    candidates = first.where("event is not null").join(ends, key)
    away = lambda e: F.round(geo.haversine_m(F.col(f"{e}.lat"), F.col(f"{e}.lon"), F.col("place_lat"), F.col("place_lon")), 3)
    moved = candidates.withColumns({"approach": away("a") - F.col("event.distance_m"), "leave": away("z") - F.col("event.distance_m")}).where(F.greatest("approach", "leave") >= floor_m)
    arrives = F.col("approach") >= F.col("leave")
    described = moved.select(
        *key,
        "runway",
        "place_ord",
        F.when(arrives, "arrival").otherwise("departure").alias("operation"),
        "event",
        F.when(arrives, F.col("a")).otherwise(F.col("z")).alias("comparison"),
        F.when(arrives, -F.col("approach")).otherwise(F.col("leave")).alias("distance_delta_m"),
        F.when(arrives, F.col("event.geoaltitude") - F.col("a.geoaltitude")).otherwise(F.col("z.geoaltitude") - F.col("event.geoaltitude")).alias("altitude_delta_m"),
        F.col("place_lat").alias("threshold_lat"),
        F.col("place_lon").alias("threshold_lon"),
    )
    order = Window.partitionBy(*key).orderBy(F.abs("distance_delta_m").desc(), "event.distance_m", "place_ord")
    best = described.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank", "place_ord")
    close = first.groupBy(*key).agg(F.max("low").alias("low"))
    label = F.coalesce(F.col("operation"), F.when(F.col("valid_rows").isNull() | F.coalesce(F.col("low"), F.lit(False)), "unclassified").otherwise("overflight"))
    return segments.join(ends.select(*key, "valid_rows"), key, "left").join(close, key, "left").join(best, key, "left").withColumn("classification", label)


def events(classified: DataFrame, date_label: str) -> DataFrame:
    """The 19 columns of threshold events, ordered by nothing."""
    return classified.where("operation is not null").select(
        F.lit(date_label).alias("date"),
        "flight_id",
        "callsign",
        "icao24",
        "operation",
        "runway",
        F.col("event.time").cast("long").alias("event_time"),
        scalars.iso_utc(F.col("event.time").cast("long")).alias("event_time_utc"),
        F.col("event.lat").alias("event_lat"),
        F.col("event.lon").alias("event_lon"),
        F.col("event.geoaltitude").alias("event_geoaltitude"),
        "threshold_lat",
        "threshold_lon",
        F.col("event.distance_m").alias("distance_to_threshold_m"),
        F.col("comparison.time").cast("long").alias("comparison_time"),
        scalars.iso_utc(F.col("comparison.time").cast("long")).alias("comparison_time_utc"),
        F.col("comparison.geoaltitude").alias("comparison_geoaltitude"),
        "distance_delta_m",
        "altitude_delta_m",
    )
