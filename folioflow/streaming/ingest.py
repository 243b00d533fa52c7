"""Structured Streaming: files as they arrive, and windowed timing reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.sources import pdf


def windowed_report(events: DataFrame, *, late: str = "10 minutes", window: str = "1 hour", slide: str | None = None) -> DataFrame:
    """Counts and values by type and event-time window; rows later than `late` are dropped once their window is closed."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    return events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def read_events(spark: SparkSession, folder: str, name: str = "events.parquet") -> DataFrame:
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def run_once(stream: DataFrame, target: str, checkpoint: str) -> None:
    """All that is there, as one table; the last complete result stays."""
    save = lambda batch, _: batch.write.mode("overwrite").parquet(target)
    stream.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()


def ingest_spans(spark: SparkSession, folder: str, target: str, checkpoint: str) -> None:
    """Spans of files that have arrived since the last call, appended to a table; a repeated batch is not written twice."""

    def save(batch: DataFrame, number: int) -> None:
        pdf.spans(batch).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{target}/batch={number}")

    pdf.stream_pdfs(spark, folder).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
