"""Incremental scoring: filings that arrive as files are scored once, under a checkpoint."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.text import doc_tones


def score_stream(spark: SparkSession, source: str, schema: StructType, target: str, checkpoint: str, size: int = 512, most: int = 8) -> StreamingQuery:
    """Score new Parquet files of ``source`` into ``target``, each document once; run again to go on where it stopped."""
    stream = spark.readStream.schema(schema).parquet(source)
    scored = doc_tones(stream.select("document_id", "text"), size, most)
    return scored.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def event_counts(events: DataFrame, late: str = "1 day", width: str = "1 day") -> DataFrame:
    """Events by window and type; works on a stream (with a watermark) and on a table alike."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    return e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
