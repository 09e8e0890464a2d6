"""Structured Streaming forms of the operators that need no global order.

Filters and projections of the operators work on streams as they are; here are windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed(stream: DataFrame, time: str, by: list[str], value: str, width: str, slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """n, total and mean of value by window and keys; rows later than `late` are left out."""
    w = F.window(time, width, slide) if slide else F.window(time, width)
    g = stream.withWatermark(time, late).groupBy(w, *by).agg(F.count("*").alias("n"), F.sum(value).alias("total"), F.avg(value).alias("mean"))
    return g.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), *by, "n", "total", "mean")


def sessions(stream: DataFrame, time: str, by: list[str], gap: str, late: str = "10 minutes") -> DataFrame:
    g = stream.withWatermark(time, late).groupBy(F.session_window(time, gap), *by).agg(F.count("*").alias("n"))
    return g.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("stop"), *by, "n")


def running_counts(stream: DataFrame, genotypes_key: list[str], dosage: str) -> DataFrame:
    """Call counts and alternate allele counts so far, for update or complete output."""
    return stream.groupBy(*genotypes_key).agg(F.count("*").alias("n"), F.count(dosage).alias("called"), F.sum(dosage).alias("alternate"))


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """What has arrived, written as Parquet; called again it goes on where it stopped."""
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q
