"""Streaming ingestion, an extension: the batch operators over files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.operators import sections


def arriving(spark: SparkSession, path: str, schema: str, format: str = "parquet", per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema).format(format)
    return (r.option("maxFilesPerTrigger", per_trigger) if per_trigger else r).load(path)


def chunk_stream(docs: DataFrame, out: str, checkpoint: str, size: int = 1000):
    """Chunk every new document once; the checkpoint is the ledger of what is done.

    Processes what is there and stops. Each batch writes under its own number, so a batch
    that is repeated after a failure replaces what it wrote.
    """

    def write(batch: DataFrame, number: int) -> None:
        sections.build_chunks(batch, size=size, step=size).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", by: str = "event_type") -> DataFrame:
    """Counts and sums per window and kind; rows later than the watermark are dropped."""
    w = F.window("ts", width)
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(w, by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")
