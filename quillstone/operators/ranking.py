"""First of each key, last of each key, and most frequent values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The whole row that comes first in ``order`` of each key.

    An aggregate, not a window: rows are reduced before the shuffle, so a hot key is no hot task.
    """
    return df.groupBy(*keys).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("row_")).select("row_.*")


def last_by(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.max_by(F.struct(*df.columns), F.struct(*order)).alias("row_")).select("row_.*")


def top_values(df: DataFrame, column: str, k: int) -> DataFrame:
    return df.groupBy(column).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), column).limit(k)


def first_k(df: DataFrame, group: str, order: str, k: int, shards: int = 64) -> DataFrame:
    """The first ``k`` rows of each group with their place ``k``; a group is first ranked in ``shards`` parts, of which only k rows each go on, so a hot one is no single task."""
    by = lambda *keys: F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    part = df.withColumn("shard_", F.pmod(F.xxhash64(order), F.lit(shards)))
    few = part.withColumn("k", by(group, "shard_")).where(F.col("k") <= k).drop("k", "shard_")
    return few.withColumn("k", by(group)).where(F.col("k") <= k)
