"""Chunks of documents: fixed stride, and recursive by separators; global and per-document indexes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEPARATORS = ("\n\n", "\n", ". ", " ")


def fixed_stride(df: DataFrame, key: str, text: str, size: int = 4000, overlap: int = 800) -> DataFrame:
    """Rows (key, pos, start, chunk): windows of ``size`` every ``size - overlap`` characters."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - overlap - 1, F.lit(0)), F.lit(size - overlap))
    rows = df.where(F.col(text).isNotNull()).select(key, text, F.posexplode(starts).alias("pos", "start"))
    return rows.select(key, "pos", "start", F.substr(text, F.col("start") + 1, F.lit(size)).alias("chunk"))


def split_recursive(text: str, size: int, overlap: int, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Pieces of at most ``size``, cut at the coarsest separator that serves; each piece begins with up to ``overlap`` characters of the one before."""

    def atoms(part: str, level: int) -> Iterator[str]:
        if len(part) <= size - overlap:
            yield part
        elif level == len(separators):
            for a in range(0, len(part), size - overlap):
                yield part[a : a + size - overlap]
        else:
            sep, begin = separators[level], 0
            while begin < len(part):
                end = part.find(sep, begin)
                end = len(part) if end < 0 else end + len(sep)
                yield from atoms(part[begin:end], level + 1)
                begin = end

    pieces, held, length = [], [], 0
    for atom in atoms(text, 0):
        if length + len(atom) > size:
            pieces.append("".join(held))
            # Whole atoms from the end, as many as fit the overlap and the next atom.
            while held and (length > overlap or length + len(atom) > size):
                length -= len(held.pop(0))
        held.append(atom)
        length += len(atom)
    if held:
        pieces.append("".join(held))
    return [p for p in pieces if p.strip()]


def recursive(df: DataFrame, key: str, text: str, size: int = 4000, overlap: int = 800) -> DataFrame:
    """Rows (key, pos, chunk); short texts stay in the JVM."""
    present = df.where(F.col(text).isNotNull() & (F.trim(text) != ""))
    short = present.where(F.length(text) <= size).select(key, F.lit(0).alias("pos"), F.col(text).alias("chunk"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, i, c) for k, t in zip(batch[key], batch[text], strict=True) for i, c in enumerate(split_recursive(t, size, overlap))]
            yield pd.DataFrame(rows, columns=[key, "pos", "chunk"])

    long = present.where(F.length(text) > size).select(key, text).mapInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, pos int, chunk string")
    return short.unionByName(long)


def running_offsets(df: DataFrame, order: str, value: str, name: str = "offset") -> DataFrame:
    """``df`` with the sum of ``value`` over all rows before in ``order``.

    Rows are range-partitioned; each range sums locally and is shifted by the totals of the ranges before it, one row for each
    range. No task sees all rows.
    """
    ranged = df.repartitionByRange(order).withColumn("range_", F.spark_partition_id())
    totals = ranged.groupBy("range_").agg(F.sum(value).alias("total"))
    shifts = totals.select("range_", F.coalesce(F.sum("total").over(Window.orderBy("range_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("shift"))
    local = F.coalesce(F.sum(value).over(Window.partitionBy("range_").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("local_", local).join(shifts, "range_").withColumn(name, F.col("local_") + F.col("shift")).drop("range_", "local_", "shift")
