"""Tracks into flight segments: de-duplication, gap splitting and per-flight summaries.

A track row has flight_id, callsign, icao24, time, lat, lon, geoaltitude and a column `ordinal` that gives
the order of ingestion, which breaks every tie. All functions shuffle by flight at most once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trackloom.functions import geo, scalars


def valid_position() -> Column:
    return F.col("time").isNotNull() & F.col("lat").isNotNull() & F.col("lon").isNotNull()


def within_box(tracks: DataFrame, west: float, east: float, south: float, north: float, stale_s: float = 15.0) -> DataFrame:
    """Rows inside a box whose last contact is at most stale_s before them."""
    fresh = F.col("time") - F.col("lastcontact") <= stale_s
    return tracks.where(F.col("lat").between(south, north) & F.col("lon").between(west, east) & fresh)


def latest_per_minute(tracks: DataFrame) -> DataFrame:
    """All rows at the last time of each minute (ties stay); rows without a time go.

    The last times are aggregated before they meet the rows by a join, which adaptive execution splits at a crowded minute.
    """
    latest = tracks.groupBy(F.floor(F.col("time") / 60).alias("of_minute")).agg(F.max("time").alias("latest"))
    met = tracks.join(latest, F.floor(F.col("time") / 60) == F.col("of_minute"))
    return met.where("time = latest").drop("latest", "of_minute")


def keep_last(tracks: DataFrame) -> DataFrame:
    """Complete rows only, one per flight and second: the one ingested last."""
    whole = tracks.dropna(subset=["time", "lat", "lon", "geoaltitude"]).withColumn("time", F.col("time").cast("long"))
    order = Window.partitionBy("flight_id", "time").orderBy(F.desc("ordinal"))
    return whole.withColumn("rank", F.row_number().over(order)).where("rank = 1").drop("rank")


def split_by_gap(tracks: DataFrame, gap_s: float = 1500.0) -> DataFrame:
    """Adds segment (from 1) and renames callsign and flight_id after it; a new segment starts after a gap longer than gap_s.

    A null time neither ends a segment nor starts one. Rows are in order of time, nulls last, then ordinal.
    """
    order = Window.partitionBy("flight_id").orderBy(F.col("time").asc_nulls_last(), "ordinal")
    opened = F.coalesce((F.col("time") - F.lag("time").over(order) > gap_s).cast("int"), F.lit(0))
    numbered = tracks.withColumn("opened", opened)
    numbered = numbered.withColumn("segment", (F.sum("opened").over(order.rowsBetween(Window.unboundedPreceding, 0)) + 1).cast("int")).drop("opened")
    sign = F.concat("callsign", F.lit("M"), F.col("segment").cast("string"))
    return numbered.withColumn("source_flight", F.col("flight_id")).withColumn("flight_id", F.concat(sign, F.col("icao24"))).withColumn("callsign", sign)


def segment_rows(split: DataFrame) -> DataFrame:
    """Valid rows of each segment with rn from 0, in order."""
    order = Window.partitionBy("source_flight", "segment").orderBy("time", "ordinal")
    return split.where(valid_position()).withColumn("rn", F.row_number().over(order) - 1)


def only_flights(tracks: DataFrame, flights: DataFrame) -> DataFrame:
    return tracks.join(flights.select("flight_id"), "flight_id", "left_semi")


def arrival_departure_flights(catalog: DataFrame) -> DataFrame:
    return catalog.where(F.lower(F.trim("operation")).isin("arrival", "departure")).select(F.trim("flight_id").alias("flight_id")).distinct()


def flight_tasks(tracks: DataFrame) -> DataFrame:
    """One row per flight: its points as an ordered array, and the first callsign and address."""
    points = F.array_sort(F.collect_list(F.struct("time", "ordinal", "lat", "lon", "geoaltitude")))
    first = F.min(F.struct("time", "ordinal", "callsign", "icao24"))
    tasks = tracks.groupBy("flight_id").agg(points.alias("points"), first.alias("first"))
    return tasks.select("flight_id", "first.callsign", "first.icao24", F.size("points").alias("point_count"), "points")


def bounds(tracks: DataFrame) -> DataFrame:
    return tracks.agg(F.min("time").alias("first_time"), F.max("time").alias("last_time"), F.count_distinct("flight_id").alias("flights"))


def check_bounds(tracks: DataFrame, from_epoch: float, to_epoch: float) -> None:
    """Raises unless the tracks begin at or after from_epoch and end by to_epoch; an empty table is an error."""
    found = bounds(tracks).first()
    if found["first_time"] is None:
        raise ValueError("no timestamps in the tracks")
    if not (from_epoch <= found["first_time"] and found["last_time"] <= to_epoch):
        raise ValueError(f"tracks span {found['first_time']} to {found['last_time']}, outside {from_epoch} to {to_epoch}")


def local_plane(tracks: DataFrame) -> DataFrame:
    """Adds x_m and y_m about the flight's mean position."""
    flight = Window.partitionBy("flight_id")
    lat0, lon0 = F.avg("lat").over(flight), F.avg("lon").over(flight)
    return tracks.withColumns({"lat0": lat0, "lon0": lon0}).withColumns({"x_m": geo.local_east_m(F.col("lat0"), F.col("lon"), F.col("lon0")), "y_m": geo.local_north_m(F.col("lat"), F.col("lat0"))}).drop("lat0", "lon0")


def labels(tracks: DataFrame) -> DataFrame:
    """First and last local time and altitude of each flight, as text."""
    by = tracks.groupBy("flight_id").agg(F.min(F.struct("time", "ordinal", "geoaltitude")).alias("a"), F.max(F.struct("time", "ordinal", "geoaltitude")).alias("b"))
    text = lambda e: F.concat(scalars.local_clock(F.col(f"{e}.time").cast("long")), F.lit(" "), F.when(F.col(f"{e}.geoaltitude").isNull(), "n/a").otherwise(F.format_string("%.0f m", F.col(f"{e}.geoaltitude"))))
    return by.select("flight_id", text("a").alias("first_label"), text("b").alias("last_label"))


def seeds(tracks: DataFrame, wanted: DataFrame) -> DataFrame:
    """For (flight_id, first_time): the row at exactly that time and its ground speed to the next row, else from the one before.

    Of several rows at the time, the first counts. Speeds of 1 m/s or less, and flights of one row, give nothing.
    """
    order = Window.partitionBy("flight_id").orderBy("time", "ordinal")
    near = F.struct("time", "lat", "lon")
    rows = tracks.withColumns({"next": F.lead(near).over(order), "before": F.lag(near).over(order), "rank": F.row_number().over(Window.partitionBy("flight_id", "time").orderBy("ordinal"))})
    found = rows.where("rank = 1").join(wanted.select("flight_id", F.col("first_time").alias("time")), ["flight_id", "time"]).withColumn("other", F.coalesce("next", "before"))
    gap = F.abs(F.col("other.time") - F.col("time"))
    distance = geo.equirectangular_m(F.col("lat"), F.col("lon"), F.col("other.lat"), F.col("other.lon"))
    fast = found.withColumn("ground_speed_mps", F.when(gap > 0, distance / gap)).where("ground_speed_mps > 1")
    return fast.select("flight_id", "time", "lat", "lon", "geoaltitude", "heading", "ground_speed_mps")


def flight_track(tracks: DataFrame, callsign: str, icao24: str, segment: int = 2, gap_s: float = 1500.0) -> DataFrame:
    """One segment of one flight; the flight is picked before the split, which its key allows."""
    own = tracks.where((F.col("callsign") == callsign) & (F.lower("icao24") == icao24.lower()))
    return split_by_gap(own, gap_s).where(F.col("segment") == segment).orderBy("time", "ordinal")


def first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first n rows in order of ingestion."""
    return rows.orderBy("ordinal").limit(n)
