"""Results written as files by all tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackloom.functions import scalars


def csv(df: DataFrame, path: str, by: list[str] | None = None) -> None:
    """A folder of CSV files with headers, in partition folders of `by`."""
    writer = df.write.mode("overwrite").option("header", True)
    (writer.partitionBy(*by) if by else writer).csv(path)


def holds_nan(value: Column, kind: T.DataType) -> Column | None:
    """Whether a value holds NaN at any depth; None where its type has no place for one."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        return F.isnan(value)
    if isinstance(kind, T.ArrayType):
        inner = holds_nan(F.lit(None), kind.elementType)
        return None if inner is None else F.exists(value, lambda v: F.coalesce(holds_nan(v, kind.elementType), F.lit(False)))
    if isinstance(kind, T.MapType):
        sides = [holds_nan(f(value), T.ArrayType(k)) for f, k in ((F.map_keys, kind.keyType), (F.map_values, kind.valueType))]
    elif isinstance(kind, T.StructType):
        sides = [holds_nan(value.getField(f.name), f.dataType) for f in kind]
    else:
        return None
    some = [F.coalesce(s, F.lit(False)) for s in sides if s is not None]
    return F.greatest(*some, F.lit(False), F.lit(False)) if some else None


def json_lines(df: DataFrame, path: str) -> None:
    """One JSON object per line; NaN in a number, at any depth, is an error."""
    tests = {f.name: holds_nan(df[f.name], f.dataType) for f in df.schema}
    checked = [df[c] if t is None else F.when(t, F.raise_error(F.lit(f"{c} is NaN"))).otherwise(df[c]).alias(c) for c, t in tests.items()]
    df.select(*checked).write.mode("overwrite").json(path)


def flight_manifest(flights: DataFrame) -> DataFrame:
    """A row per compressed flight in order of first time (nulls last) and id, the ratio with six places."""
    share = scalars.ratio(F.col("compressed_point_count"), F.col("raw_point_count"))
    rows = flights.select("flight_id", "callsign", "icao24", "first_time", "last_time", "raw_point_count", "compressed_point_count", F.size("lateral_breakpoint_times").alias("lateral_breakpoint_count"), F.size("altitude_breakpoint_times").alias("altitude_breakpoint_count"), F.format_string("%.6f", share).alias("compression_ratio"))
    return rows.orderBy(F.col("first_time").asc_nulls_last(), "flight_id")


def run_metadata(flights: DataFrame, lateral_m: float, altitude_m: float) -> DataFrame:
    """One row of totals of a compression run, as columns and as JSON."""
    raw, kept = F.coalesce(F.sum("raw_point_count"), F.lit(0)), F.coalesce(F.sum("compressed_point_count"), F.lit(0))
    totals = flights.agg(F.count("*").alias("flight_count"), raw.alias("raw_point_count"), kept.alias("compressed_point_count"))
    totals = totals.withColumns({"compression_ratio": scalars.ratio(F.col("compressed_point_count"), F.col("raw_point_count")), "lateral_tolerance_m": F.lit(lateral_m), "altitude_tolerance_m": F.lit(altitude_m)})
    return totals.withColumn("json", F.to_json(F.struct("*")))


def extraction_report(failures: DataFrame, summary: DataFrame, airport: str) -> DataFrame:
    """Lines of a text report: the counts, then failures by falling number of uses and token."""
    counts = summary.select(F.posexplode(F.array(*(F.format_string(f"{c}: %d", F.col(c)) for c in summary.columns))).alias("n", "line")).select(F.lit(0).alias("part"), F.lit(0).cast("long").alias("order"), F.format_string("%04d", "n").alias("token"), "line")
    lost = failures.select(F.lit(1).alias("part"), (-F.col("uses")).cast("long").alias("order"), "token", F.concat_ws(" | ", "token", "kind", F.col("uses").cast("string"), "reason", "airports").alias("line"))
    return counts.unionByName(lost).orderBy("part", "order", "token").select("line").withColumn("line", F.concat(F.lit(f"{airport} "), F.col("line")))
