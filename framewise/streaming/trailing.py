"""Structured Streaming forms of trailing features and gap sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def sessions(events: DataFrame, keys: list[str], time: str, gap: str, late: str) -> DataFrame:
    """Spans of events at most ``gap`` apart, the streaming form of islands; rows later than ``late`` are dropped."""
    held = events.withWatermark(time, late)
    found = held.groupBy(*keys, F.session_window(time, gap).alias("_s")).agg(F.count("*").alias("n_rows"), F.max(time).alias("last"))
    return found.select(*keys, F.col("_s.start").alias("start"), "last", "n_rows")


def trailing_means(frames: DataFrame, keys: list[str], time: str, columns: list[str], length: str, slide: str, late: str) -> DataFrame:
    """Means over trailing windows of ``length`` that end every ``slide``."""
    held = frames.withWatermark(time, late)
    found = held.groupBy(*keys, F.window(time, length, slide).alias("_w")).agg(*[F.avg(c).alias(f"{c}_trailing") for c in columns], F.count("*").alias("n_rows"))
    return found.select(*keys, F.col("_w.end").alias("at"), *[f"{c}_trailing" for c in columns], "n_rows")
