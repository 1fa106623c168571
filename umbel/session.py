"""Sessions tuned for large tables; every setting may be overridden."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.files.maxPartitionBytes": "128m",
    "spark.serializer": "org.apache.spark.serializer.KryoSerializer",
}


def session(master: str | None = None, **settings: str) -> SparkSession:
    """A session with SETTINGS; keyword arguments use __ for . in names."""
    b = SparkSession.builder.appName("umbel")
    if master:
        b = b.master(master)
    for k, v in (SETTINGS | {k.replace("__", "."): v for k, v in settings.items()}).items():
        b = b.config(k, v)
    return ship(b.getOrCreate())


#: By application: the folder of the archive that was sent, which executors may fetch as long as it runs.
_shipped: dict[str, tempfile.TemporaryDirectory] = {}


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors, once an application: their Python needs it wherever the driver found it."""
    app, here = spark.sparkContext.applicationId, Path(__file__).resolve().parent
    if app not in _shipped and here.is_dir():  # no folder: the package was itself imported from an archive
        d = _shipped[app] = tempfile.TemporaryDirectory(prefix="umbel-package-")
        shutil.copytree(here, f"{d.name}/tree/umbel", ignore=shutil.ignore_patterns("__pycache__"))
        spark.sparkContext.addPyFile(shutil.make_archive(f"{d.name}/umbel-package", "zip", f"{d.name}/tree"))
    return spark
