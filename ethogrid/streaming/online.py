"""Streaming forms of the batch operators, for event streams with a timestamp; late rows beyond the watermark are
dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def windowed_rates(stream: DataFrame, ts: str, keys: list[str], size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and means of value per sliding time window and key."""
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = stream.withWatermark(ts, late).groupBy(w.alias("w"), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("mean"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n", "mean")


def sessions(stream: DataFrame, ts: str, keys: list[str], gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Islands of events: rows of a key at most `gap` apart."""
    g = stream.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), F.col("w.end").alias("stop"), *keys, "n")
