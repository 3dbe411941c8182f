"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[tuple[SparkSession, str]] = []
#: By application: the folder of a session on this machine alone.
_temporary: dict[str, str] = {}
#: Rows of a task, about: wide ones of several sorts then need some hundred MB at any size of the input.
TASK_ROWS = 1 << 18


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a session on this machine alone gets a temporary one; on a cluster that is an error.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if context.applicationId not in _temporary:
        _temporary[context.applicationId] = tempfile.mkdtemp(prefix="trackloom-")
    return "file://" + _temporary[context.applicationId]


def place(spark: SparkSession, name: str) -> str:
    """A new folder's path in the shared folder, deleted when the program ends."""
    path = f"{shared_folder(spark)}/trackloom-{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a Parquet table in the shared folder: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = place(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._trackloom_path = path
    return out


def dealt(df: DataFrame, *keys: str, rows: int = 0) -> DataFrame:
    """df dealt by keys to all of spark.sql.shuffle.partitions tasks, or to more: one for every TASK_ROWS of rows (about how many df has, if known).

    Adaptive execution joins small partitions by their compressed bytes. Where few bytes become many rows, or wide ones,
    that leaves a task too many of them; partitions of a given number stay.
    """
    return df.repartition(max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // TASK_ROWS)), *keys)


def forget(*tables: DataFrame) -> None:
    """Deletes tables made by written() that no later step reads, and lets Spark drop finished steps' shuffle files.

    Spark deletes a shuffle's files once the driver has collected the objects that name it; without the hint
    they can stay until the end of a job.
    """
    for df in tables:
        _forget(df)
    if tables:
        gc.collect()
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def _forget(df: DataFrame) -> None:
    path = getattr(df, "_trackloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _written[:] = [x for x in _written if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _forget_all() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may be gone by now
            break
    for folder in _temporary.values():
        shutil.rmtree(folder, ignore_errors=True)
