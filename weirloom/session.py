"""Session settings shared by tests, the benchmark and command-line use."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(app: str = "weirloom", cores: str | None = None) -> SparkSession:
    """A local session; on a cluster the settings of spark-submit win over these."""
    n = cores or os.environ.get("BENCH_CPUS", "8")
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.mapKeyDedupPolicy", "LAST_WIN")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    if "SPARK_REMOTE" not in os.environ and "MASTER" not in os.environ:
        builder = (
            builder.master(f"local[{n}]")
            .config("spark.driver.memory", os.environ.get("WEIRLOOM_DRIVER_MEMORY", "8g"))
            .config("spark.sql.shuffle.partitions", n if n.isdigit() else "8")
        )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
