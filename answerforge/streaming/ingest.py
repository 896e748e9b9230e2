"""Structured Streaming: passages taken in as files arrive, and windowed counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def windowed_counts(events: DataFrame, every: str = "1 hour", late: str | None = None) -> DataFrame:
    """(hour, event_type, events, total); works on batch and streaming frames. `late`: watermark."""
    rows = events.withWatermark("ts", late) if late else events
    out = rows.groupBy(F.window("ts", every).alias("w"), "event_type").agg(F.count("*").alias("events"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("hour"), "event_type", "events", "total")


def read_stream(spark: SparkSession, folder: str, schema: StructType, fmt: str = "parquet", files: int = 64) -> DataFrame:
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files).load(folder)


def ingest_passages(stream: DataFrame, target: str, checkpoint: str, key: str = "pid") -> None:
    """Appends what has arrived, each passage id once for all runs with this checkpoint, and stops; rerunning goes on where it ended.

    Ids seen are the stream's state. A micro-batch is written to a folder of its own, which a retry overwrites, so
    none is there twice; readers of the target see the column `ingest` beside the passages' own."""
    run = uuid.uuid5(uuid.NAMESPACE_URL, checkpoint).hex[:12]

    def add(batch: DataFrame, no: int) -> None:
        batch.write.mode("overwrite").parquet(f"{target}/ingest={run}-{no}")

    stream.dropDuplicates([key]).writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def count_stream(stream: DataFrame, target: str, checkpoint: str, late: str = "10 minutes") -> None:
    """Windowed counts appended once their window is past the watermark."""
    out = windowed_counts(stream, late=late)
    out.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
