"""Structured Streaming forms of the track operators.

A stream has event time `ts` (a timestamp), a key and a value column. State is bounded by the watermark in
the windowed forms and in keep-last; numbering keeps one small row per flight and drops it after a timeout.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType

#: Holds state beyond memory: spark.sql.streaming.stateStore.providerClass.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def table(spark: SparkSession, path: str, schema: StructType, **options: object) -> DataFrame:
    """A Parquet table as a stream of its files: a folder of part files, or a single file. A path without either is an error.

    options are those of the file source, such as maxFilesPerTrigger.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not store.exists(place):
        raise FileNotFoundError(path)
    reader = spark.readStream.schema(schema).options(**options)
    if store.getFileStatus(place).isDirectory():
        return reader.parquet(path)
    folder, _, name = path.rpartition("/")
    return reader.option("pathGlobFilter", name).parquet(folder)


def sessions(stream: DataFrame, key: str, gap: str = "25 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key that end after a gap: start, end of the last row's gap, and rows. A gap of exactly that length joins."""
    windows = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), key).agg(F.count("*").alias("rows"))
    return windows.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "rows")


def latest_per_minute(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The latest event time of each minute, with the number of rows."""
    windows = stream.withWatermark("ts", late).groupBy(F.window("ts", "1 minute")).agg(F.max("ts").alias("latest"), F.count("*").alias("rows"))
    return windows.select(F.col("window.start").alias("minute"), "latest", "rows")


def number_segments(stream: DataFrame, key: str, gap_s: float, late: str = "10 minutes", keep: str = "1 day") -> DataFrame:
    """Rows (key, ts) numbered by segment as they come, in order of time within a micro-batch.

    State is each key's last time and segment; it goes when the watermark is `keep` past the last row.
    """
    kind = dict(stream.dtypes)[key]
    millis = int(pd.Timedelta(keep).total_seconds() * 1000)

    def step(group: tuple[Any, ...], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values("ts", kind="stable")
        last, segment = state.get if state.exists else (None, 1)
        times = rows["ts"].to_numpy().astype("datetime64[us]").astype("int64") / 1e6
        before = np.concatenate(([times[0] if last is None else last], times[:-1]))
        out = segment + np.cumsum(times - before > gap_s)
        last, segment = float(times[-1]), int(out[-1])
        state.update((last, segment))
        state.setTimeoutTimestamp(max(int(last * 1000), state.getCurrentWatermarkMs()) + millis)
        yield pd.DataFrame({key: rows[key].to_numpy(), "ts": rows["ts"].to_numpy(), "segment": out.astype("int32")})

    return stream.select(key, "ts").withWatermark("ts", late).groupBy(key).applyInPandasWithState(step, f"{key} {kind}, ts timestamp, segment int", "last double, segment int", "append", GroupStateTimeout.EventTimeTimeout)


def keep_last(stream: DataFrame, late: str = "10 minutes") -> DataFrame:
    """The stream's form of segments.keep_last: of each flight and second the complete row ingested last, once no more can come.

    stream has flight_id, time, lat, lon, geoaltitude, ordinal (distinct, not null) and others. State is one row
    a flight and second, replaced by a row of greater ordinal; when the watermark passes the second, it is emitted and
    its state cleared. Rows later than that are dropped. Output mode append; state is best kept in STATE_STORE.
    """
    whole = stream.dropna(subset=["time", "lat", "lon", "geoaltitude"]).withColumn("time", F.floor("time").cast("long"))
    timed = whole.withColumn("event_time", F.timestamp_seconds("time")).withWatermark("event_time", late)
    newest = F.max_by(F.struct(*stream.columns), "ordinal").alias("newest")
    return timed.groupBy("flight_id", F.window("event_time", "1 second")).agg(newest).select("newest.*")
