"""Session factory: one place for the settings every query relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

#: Settings that change results, not only speed.
SEMANTICS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "casegraph", cores: int | str | None = None, **extra: str) -> SparkSession:
    """A session for local work; on a cluster the master and sizes come from spark-submit."""
    builder = SparkSession.builder.appName(app)
    if cores is not None:
        builder = builder.master(f"local[{cores}]")
        builder = builder.config("spark.driver.memory", os.environ.get("CASEGRAPH_DRIVER_MEMORY", "8g"))
        builder = builder.config("spark.ui.enabled", "false")
        builder = builder.config("spark.sql.shuffle.partitions", str(cores) if str(cores).isdigit() else "8")
    for key, value in {**SEMANTICS, **extra}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark
