"""Service figures over a stream of requests, and passages of documents as they land."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from trovelle.operators.chunking import ChunkConfig, chunk_documents


def hourly(events: DataFrame, late: str = "10 minutes") -> DataFrame:
    """(event_type, window_start, n, total): tumbling hours over events (ts, event_type, value), streaming or not."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    grouped = timed.where("ts is not null").groupBy("event_type", F.window("ts", "1 hour").alias("w"))
    return grouped.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select("event_type", F.col("w.start").alias("window_start"), "n", "total")


def sliding_usage(events: DataFrame, window: str = "60 seconds", slide: str = "10 seconds", late: str = "2 minutes") -> DataFrame:
    """(user_id, w, used, n): usage in sliding windows, the streaming kin of the rolling limiter."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy("user_id", F.window("ts", window, slide).alias("w")).agg(F.sum("value").alias("used"), F.count(F.lit(1)).alias("n"))


def chunk_landing(spark: SparkSession, source: str, sink: str, checkpoint: str, schema: str, cfg: ChunkConfig = ChunkConfig()) -> StreamingQuery:
    """Documents (parquet) that land in `source` come out as passages in `sink`; restarts go on from `checkpoint`."""
    docs = spark.readStream.schema(schema).parquet(source)
    return chunk_documents(docs, cfg).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
