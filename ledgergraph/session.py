"""Sessions, and making this package importable in Python workers."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent


def local_session(cores: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings that tests and the benchmark use."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("ledgergraph")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send the package to Python workers that would not find it by ``PYTHONPATH``."""
    paths = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    context = spark.sparkContext
    if str(ROOT) in paths or getattr(context, "_ledgergraph_shipped", False):
        return
    folder = tempfile.mkdtemp(prefix="ledgergraph-ship-")
    archive = shutil.make_archive(f"{folder}/ledgergraph", "zip", ROOT, "ledgergraph")
    context.addPyFile(archive)
    context._ledgergraph_shipped = True
