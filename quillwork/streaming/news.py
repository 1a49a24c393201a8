"""Streams of collected news and events."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import identity
from ..operators.tables import shared_dir


def first_deliveries(news: DataFrame, delay: str = "30 days") -> DataFrame:
    """The first delivery of each canonical URL: in batches that of the earliest collected_at (of equal ones the least row), on streams the first to arrive within the watermark. Rows without a
    URL or time are left out."""
    keyed = news.withColumn("url_key", identity.url_key(F.col("url"))).where("url_key is not null and collected_at is not null")
    if news.isStreaming:
        return keyed.withWatermark("collected_at", delay).dropDuplicatesWithinWatermark(["url_key"])
    rest = [c for c in news.columns if c != "collected_at"]
    return keyed.groupBy("url_key").agg(F.min(F.struct("collected_at", *rest)).alias("d")).select(*(F.col(f"d.{c}").alias(c) for c in news.columns), "url_key")


def windowed_counts(events: DataFrame, time: str, keys: list[str], width: str = "1 hour", slide: str | None = None, value: Column | None = None, delay: str = "2 hours") -> DataFrame:
    """(window_start, window_end, keys, n, total): events per window and key; on streams late ones within `delay` still count."""
    source = events.withWatermark(time, delay) if events.isStreaming else events
    window = F.window(time, width, slide) if slide else F.window(time, width)
    out = source.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("n"), F.sum(value if value is not None else F.lit(1.0)).alias("total"))
    return out.select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), *keys, "n", "total")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is available now into Parquet files (exactly once, by the checkpoint), then stops."""
    stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()


def stream_to_table(stream: DataFrame) -> DataFrame:
    """What the stream gives now, as a table in the shared folder."""
    path = f"{shared_dir(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    run_once(stream, f"{path}/out", f"{path}/checkpoint")
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/out")
