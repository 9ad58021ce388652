"""Pairs of rows that share a key, with hot keys cut into blocks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sides(left: DataFrame, right: DataFrame) -> tuple[list[Column], list[Column]]:
    return [F.col(f"`{c}`").alias(f"a_{c}") for c in left.columns], [F.col(f"`{c}`").alias(f"b_{c}") for c in right.columns]


def _heavy(df: DataFrame, key: str, block: int) -> DataFrame:
    """Keys of more than ``block`` rows, with their number of blocks."""
    counts = df.groupBy(F.col(key).alias("k_")).agg(F.count(F.lit(1)).alias("n_")).where(F.col("n_") > block)
    return counts.select("k_", F.ceil(F.col("n_") / block).cast("int").alias("blocks_"))


def pairs_across(left: DataFrame, right: DataFrame, key: str, member: str, where: Column, block: int = 1000) -> DataFrame:
    """Join of two frames on ``key``: columns a_* of ``left`` and b_* of ``right`` of the pairs that pass ``where``.

    Rows of ``right`` under a key of more than ``block`` rows are spread over blocks by the hash of ``member``, and each row of ``left`` meets the blocks one by one,
    in tasks of their own. Only the keys above a block are looked up, so the look-up is a broadcast where that list is small and
    else a join whose skewed side the adaptive planner may split. No pair is lost or doubled. Null keys meet nothing.
    """
    heavy = _heavy(right, key, block)
    a, b = _sides(left, right)
    same = F.col(f"a_{key}") == F.col(f"b_{key}")
    plain = lambda df: df.join(heavy, F.col(key) == F.col("k_"), "left_anti")
    light = plain(left).select(*a).join(plain(right).select(*b), same & where)
    marked = lambda df: df.join(heavy, F.col(key) == F.col("k_"))
    spread = marked(left).select(*a, F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)).alias("a_block_"))
    placed = marked(right).select(*b, F.pmod(F.xxhash64(member), F.col("blocks_")).cast("int").alias("b_block_"))
    return light.unionByName(spread.join(placed, same & (F.col("a_block_") == F.col("b_block_")) & where).drop("a_block_", "b_block_"))


def pairs_within(df: DataFrame, key: str, member: str, where: Column, block: int = 1000) -> DataFrame:
    """Self-join of ``df`` on ``key``: columns a_* and b_* of the pairs that pass ``where``; hot keys as in ``pairs_across``.

    ``df`` is read several times, so the caller cuts its lineage where it is dear to compute.
    """
    return pairs_across(df, df, key, member, where, block)


def looked_up(df: DataFrame, key: str, member: str, values: DataFrame, block: int = 100_000) -> DataFrame:
    """Left join of ``df`` with ``values`` (distinct ``key``), where rows of one key may be a large part of ``df``.

    The values of keys with more than ``block`` rows are copied to each block of their rows. Rows without a key are not moved.
    """
    heavy = _heavy(df.where(F.col(key).isNotNull()), key, block)
    none = [F.lit(None).cast(f.dataType).alias(f.name) for f in values.schema if f.name != key]
    bare = df.where(F.col(key).isNull()).select("*", *none)
    marked = df.where(F.col(key).isNotNull()).join(heavy, F.col(key) == F.col("k_"), "left").withColumn("block_", F.pmod(F.xxhash64(member), F.coalesce("blocks_", F.lit(1))).cast("int")).drop("k_", "blocks_")
    copied = values.join(heavy, F.col(key) == F.col("k_"), "left").withColumn("block_", F.explode(F.sequence(F.lit(0), F.coalesce("blocks_", F.lit(1)) - 1))).drop("k_", "blocks_")
    return marked.join(copied, [key, "block_"], "left").drop("block_").select(*bare.columns).unionByName(bare)


def cells(df: DataFrame, group: str, member: str, block: int) -> DataFrame:
    """``df`` once for each cell it takes part in: columns ``cell_g``, ``cell_i``, ``cell_j`` and ``block_``.

    The rows of a group are spread over blocks of about ``block`` rows by the hash of ``member``; a cell is two blocks of a group, or one with itself, so any two
    rows of a group are together in one cell, whatever the size of the group. A task gets many cells, so their number of partitions is fixed. Null groups meet nothing.
    """
    spark = df.sparkSession
    counts = df.groupBy(F.col(group).alias("cell_g")).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks_"))
    rows = df.join(counts, F.col(group) == F.col("cell_g")).withColumn("block_", F.pmod(F.xxhash64(member), F.col("blocks_")).cast("int"))
    spread = rows.withColumn("other_", F.explode(F.sequence(F.lit(0), F.col("blocks_") - 1)))
    out = spread.select(*[c for c in df.columns if c != group], "cell_g", F.least("block_", "other_").alias("cell_i"), F.greatest("block_", "other_").alias("cell_j"), "block_")
    return out.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism), "cell_g", "cell_i", "cell_j")
