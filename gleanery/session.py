"""Session settings the engine relies on, and a local session for tests and benches."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int = 8, partitions: int = 8, memory: str = "6g") -> SparkSession:
    """A single-JVM session; clusters bring their own session and only need SETTINGS."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("gleanery")
        .config(map=SETTINGS)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
