"""SparkSession factory for local runs; on a cluster the caller brings its own session."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, app: str = "inkwell", partitions: int = 8) -> SparkSession:
    """A local session with the settings the queries assume: UTC, AQE on, small shuffles."""
    n = cores or min(8, os.cpu_count() or 1)
    spark = (
        SparkSession.builder.master(f"local[{n}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("INKWELL_DRIVER_MEMORY", "8g"))
        # the exact percentile keeps a value map per group; below this many groups it stays a hash aggregate
        .config("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "4096")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark
