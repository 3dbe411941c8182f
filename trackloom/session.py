"""Session settings that every job of this library expects."""

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def session(app_name: str = "trackloom", master: str | None = None, **extra) -> SparkSession:
    """A session in UTC with adaptive execution; further settings come as keyword arguments."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        **extra,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def reach_workers(spark: SparkSession) -> SparkSession:
    """Lets Python workers import this package, whatever their own folder and machine.

    Workers of this machine find it where the driver did; a cluster gets it as an archive through Spark.
    """
    context = spark.sparkContext
    root = str(Path(__file__).resolve().parent.parent)
    paths = [p for p in context.environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        context.environment["PYTHONPATH"] = os.pathsep.join([*paths, root])
        if not (context.master == "local" or context.master.startswith("local[")):
            folder = tempfile.mkdtemp(prefix="trackloom-")  # Spark serves the archive from there while it runs
            atexit.register(shutil.rmtree, folder, True)
            context.addPyFile(shutil.make_archive(f"{folder}/trackloom", "zip", root, "trackloom"))
    return spark
