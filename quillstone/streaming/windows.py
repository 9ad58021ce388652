"""Event-time windows with watermarks; the same functions serve batch and stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _late(df: DataFrame, ts: str, delay: str) -> DataFrame:
    return df.withWatermark(ts, delay) if df.isStreaming else df


def tumbling(df: DataFrame, ts: str, key: str, length: str = "1 hour", delay: str = "10 days") -> DataFrame:
    """Counts by window and key. The default delay covers rows that come up to nine days late."""
    return _late(df, ts, delay).groupBy(F.window(ts, length).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), key, "n")


def sliding(df: DataFrame, ts: str, length: str = "2 hours", slide: str = "1 hour", delay: str = "10 days") -> DataFrame:
    return _late(df, ts, delay).groupBy(F.window(ts, length, slide).alias("w")).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "n")


def sessions(df: DataFrame, ts: str, key: str, gap: str = "30 minutes", delay: str = "10 days") -> DataFrame:
    return _late(df, ts, delay).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def domain_hits(df: DataFrame, domain: str, hit: str) -> DataFrame:
    """Running attempts and hits by domain: a stateful aggregation on a stream."""
    return df.groupBy(domain).agg(F.count(F.lit(1)).alias("attempts"), F.sum(F.col(hit).cast("int")).alias("hits"))
