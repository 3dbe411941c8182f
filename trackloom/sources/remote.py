"""Remote position and flight tables over JDBC, by the hour, and what a local copy of them still lacks.

Credentials come from the caller; nothing is stored here.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trackloom.functions import scalars
from trackloom.operators import segments
from trackloom.shared import written


def hours(spark: SparkSession, first: str, last: str, zone: str) -> DataFrame:
    """hour_utc of every hour from first to last, the end included; each is a local time of zone unless it states an offset."""
    bounds = spark.range(1).select(scalars.datetime_range(F.lit(first), F.lit(last), zone).alias("r"))
    return bounds.select(F.explode(F.sequence("r.utc_from", "r.utc_to", F.expr("interval 1 hour"))).alias("hour_utc"))


def missing_hours(grid: DataFrame, held: DataFrame) -> DataFrame:
    """Hours of the grid that a table already written does not hold."""
    return grid.join(held.select("hour_utc").distinct(), "hour_utc", "left_anti")


def read(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """The rows of a query on a remote database; an empty result is an error."""
    found = spark.read.format("jdbc").option("url", url).option("query", query).options(**options).load()
    if found.isEmpty():
        raise ValueError("the query gave no rows")
    return found


def hour_query(table: str, hour_epoch: int, box: tuple[float, float, float, float], stale_s: int = 15) -> str:
    """SQL for one hour partition inside (west, east, south, north), at the latest second of each minute."""
    west, east, south, north = box
    inside = f"hour = {hour_epoch} and lat between {south} and {north} and lon between {west} and {east} and time - lastcontact <= {stale_s}"
    return f"select time, icao24, lat, lon, heading, callsign, geoaltitude from (select *, max(time) over (partition by floor(time / 60)) as latest from {table} where {inside}) as t where time = latest"


def read_hours(spark: SparkSession, url: str, table: str, hours_epoch: list[int], *, column: str = "hour", **options: str) -> DataFrame:
    """The rows of a remote table in the given hours: one partition of the scan an hour, each with a predicate of its own.

    Further filters and the choice of columns are pushed down by Spark. column is spelled as the database spells it. Without hours there are no rows.
    """
    wanted = [f'"{column}" = {h}' for h in sorted(hours_epoch)] or ["1 = 0"]
    return spark.read.jdbc(url, table, predicates=wanted, properties=options)


def in_box(found: DataFrame, box: tuple[float, float, float, float], stale_s: float = 15.0) -> DataFrame:
    """Rows inside (west, east, south, north) with a fresh contact, at the latest time of each minute. The box is part of the remote scan, which is read once."""
    return segments.latest_per_minute(written(segments.within_box(found, *box, stale_s), "remote"))


def fetch_missing(spark: SparkSession, url: str, table: str, hours_epoch: list[int], path: str, box: tuple[float, float, float, float], *, column: str = "hour", **options: str) -> list[int]:
    """Fetches the hours that the Parquet table at path lacks, each into a partition folder of its own; returns them.

    Whole hours replace what a broken run left of them and touch no other (dynamic overwrite), so a run can be repeated. An hour without
    rows has no folder and is asked for again. hours_epoch is a grid of hours, thousands at most.
    """
    try:
        held = {r[0] for r in spark.read.parquet(path).select(column).distinct().collect()}
    except AnalysisException as missing:
        if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        held = set()
    lacking = [h for h in hours_epoch if h not in held]
    if lacking:
        rows = in_box(read_hours(spark, url, table, lacking, column=column, **options), box)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(column).parquet(path)
    return lacking
