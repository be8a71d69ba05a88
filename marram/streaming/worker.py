"""A worker that takes queued runs from a stream of run rows (ST1)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

OPEN = ("queued", "running")


def start(spark: SparkSession, folder: str, schema: StructType, process: Callable[[DataFrame, int], None], checkpoint: str, every: str | None = "2 seconds", oldest: str | None = None) -> StreamingQuery:
    """Run rows (run_id, status, ...) that appear as Parquet files in ``folder`` go to ``process`` in batches,
    those that are queued or running, by the column ``oldest`` where it is named. ``every`` None: what is there now, then stop."""
    rows = spark.readStream.schema(schema).parquet(folder).where(F.col("status").isin(*OPEN))
    writer = rows.writeStream.foreachBatch(lambda df, batch: process(df.orderBy(oldest) if oldest else df, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def windowed_counts(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Events and values by type and hour, late ones dropped after the watermark (an extra)."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))
