"""An extension over the batch engine: sessions of a stream of items, with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanery.scratch import shared_folder


def stream_sessions(stream: DataFrame, by: str, time: str, gap: str = "10 seconds", late: str = "1 hour") -> DataFrame:
    """(by, started_at, last_at, items): sessions with gaps of at most ``gap``, emitted when the watermark, ``late``
    behind the newest time, has passed them; rows older than the watermark are dropped. Same border as the batch form."""
    rows = stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    grouped = rows.groupBy(by, F.session_window(time, gap)).agg(
        F.count(F.lit(1)).alias("items"), F.min(time).alias("started_at"), F.max(time).alias("last_at")
    )
    return grouped.select(by, "started_at", "last_at", "items")


def run_available(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now, into the shared folder, and returns the written table."""
    import uuid

    spark: SparkSession = stream.sparkSession
    out = f"{shared_folder(spark)}/gleanery-stream-{uuid.uuid4().hex}"
    query = (
        stream.writeStream.format("parquet").outputMode(mode).option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")
