"""The domain's tables derived from the driver's: tracks from events, fixes from suppliers, catalogs from orders.

Integer arithmetic makes the derived positions the same in every engine. The runways are invented.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trackloom.session import reach_workers
from trackloom.shared import dealt

# Invented thresholds, in the order that breaks ties.
RUNWAYS = [
    (1, "13L", 32.91, -97.02),
    (2, "13R", 32.90, -97.08),
    (3, "17C", 32.9157, -97.026),
    (4, "18L", 32.92, -97.05),
    (5, "31L", 32.88, -97.04),
    (6, "31R", 32.89, -97.00),
    (7, "35C", 32.865, -97.026),
    (8, "36R", 32.87, -97.05),
]
GAP_S = 28_800.0


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return reach_workers(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_tracks(read(spark, sf_dir, "events"))


def as_tracks(events: DataFrame) -> DataFrame:
    """Positions of one flight a user, from events as a table or a stream."""
    e = events.select("event_id", "user_id", "event_type", "value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    icao = F.concat(F.lit("a"), F.col("user_id").cast("string"))
    sign = F.concat(F.lit("FL"), F.col("user_id").cast("string"))
    return e.select(
        F.concat(sign, icao).alias("flight_id"),
        sign.alias("callsign"),
        icao.alias("icao24"),
        (F.col("us") / F.lit(1e6)).alias("time"),
        (F.lit(32.9157) + (F.col("event_id") % 97 - 48) * F.lit(0.004)).alias("lat"),
        (F.lit(-97.026) + (F.col("event_id") % 89 - 44) * F.lit(0.005)).alias("lon"),
        F.when(F.col("event_id") % 53 != 0, F.col("value") * 20).alias("geoaltitude"),
        ((F.col("event_id") * 7) % 360).cast("double").alias("heading"),
        F.col("event_id").alias("ordinal"),
    )


def thresholds(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RUNWAYS, "place_ord int, runway string, place_lat double, place_lon double")


def fixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(
        F.concat(F.lit("FX"), key.cast("string")).alias("identifier"), key.alias("place_ord"), (F.lit(32.9157) + (key * 7 % 97 - 48) * F.lit(0.004)).alias("place_lat"), (F.lit(-97.026) + (key * 11 % 89 - 44) * F.lit(0.005)).alias("place_lon")
    )


def line_count(spark: SparkSession, sf_dir: str) -> int:
    """Order lines, from the footers of their files: how many tasks they are dealt to follows from it."""
    return read(spark, sf_dir, "lineitem").count()


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order line, numbered anew from 1 in its order by line number and then all other columns: repeated numbers are lines too."""
    rest = ["l_partkey", "l_suppkey", "l_quantity", "l_discount", "l_tax", "l_returnflag"]
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", *rest)
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", *rest)
    return dealt(rows, "l_orderkey", rows=line_count(spark, sf_dir)).select("l_orderkey", F.row_number().over(order).alias("l_linenumber"), *rest)


def legs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Procedure legs from order lines: one procedure per order, its lines in sequence."""
    line = lines(spark, sf_dir)
    return line.select(
        (F.col("l_orderkey") * 1000 + F.col("l_linenumber")).alias("line_no"),
        F.element_at(F.array(F.lit("PD"), F.lit("PE"), F.lit("PF")), (F.col("l_orderkey") / 10 % 3 + 1).cast("int")).alias("section_code"),
        F.concat(F.lit("P"), F.col("l_orderkey").cast("string")).alias("sid_star_approach_identifier"),
        F.lit("4").alias("route_type"),
        F.concat(F.lit("T"), (F.col("l_orderkey") % 7).cast("string")).alias("transition_identifier"),
        F.format_string("%03d", F.col("l_linenumber") * 10).alias("sequence_number"),
        F.when(F.col("l_partkey") % 11 != 0, F.concat(F.lit("X"), (F.col("l_partkey") % 40).cast("string"))).alias("fix_identifier"),
    )


def lateral_plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plans with lateral states, wind and slack."""
    i, part, supplier = F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey")
    extra = [
        (F.lit(60.0) + i * 8.0).alias("cas"),
        (F.lit(8000.0) + supplier % 10 * 50.0).alias("idle"),
        (supplier % 50 - 25.0).alias("cross"),
        ((part % 17 - 8.0) / 200.0).alias("heading_error"),
        ((supplier % 21 - 10.0) / 100.0).alias("bank"),
        ((part % 11 - 5.0) / 1000.0).alias("roll"),
        (i * 0.1).alias("track"),
        (i * 0.0001).alias("curvature"),
        F.lit(2.0).alias("wind_east"),
        F.lit(-1.0).alias("wind_north"),
        F.lit(0.05).alias("slack"),
        (F.lit(0.4) + F.col("l_discount")).alias("cl"),
    ]
    return lines(spark, sf_dir).select(*plan_columns(), *extra)


def plan_columns() -> list[Column]:
    i = F.col("l_linenumber")
    return [
        F.col("l_orderkey").alias("plan_id"),
        i.alias("idx"),
        (i * 4000.0).alias("s"),
        (i * 250.0 + F.col("l_quantity")).alias("h"),
        (F.lit(70.0) + i * 8.0 + F.col("l_discount") * 10).alias("v"),
        (i * 45.0 + F.col("l_tax")).alias("t"),
        (F.lit(-0.02) - F.col("l_tax") / 10).alias("gamma"),
        (F.lit(9000.0) + F.col("l_quantity") * 100).alias("thrust"),
        F.when(F.col("l_linenumber") <= 3, "final").when(F.col("l_quantity") > 25, "approach").otherwise("clean").alias("phase"),
    ]


def plan_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plans from order lines: states that fall and rise by simple rules."""
    return lines(spark, sf_dir).select(*plan_columns())
