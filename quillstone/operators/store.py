"""Chunk store: keyed upsert, context blocks, tool output, file dispatch."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import fixed


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Old rows whose key is not in ``new``, and the new rows, once for each key."""
    return old.join(new.select(*keys), list(keys), "left_anti").unionByName(new.dropDuplicates(list(keys)))


def context_blocks(chunks: DataFrame, group: str, order: str, text: str, k: int) -> DataFrame:
    """The first ``k`` chunks of each group as numbered source blocks; only ``k`` rows of a group are gathered."""
    ranked = chunks.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(order))).where(F.col("rank") <= k)
    source = F.concat_ws(" | ", F.coalesce(F.col("source_filename"), F.lit("unknown")), F.nullif("geography", F.lit("")), F.nullif("date_published", F.lit("")))
    block = F.struct("rank", F.concat(F.lit("[Source "), "rank", F.lit("] ("), source, F.lit(")\n"), F.coalesce(text, F.lit(""))).alias("t"))
    return ranked.groupBy(group).agg(F.array_join(F.transform(F.array_sort(F.collect_list(block)), lambda x: x["t"]), "\n\n---\n\n").alias("context"))


def parsed_output(df: DataFrame, key: str, output: str) -> DataFrame:
    """Rows (key, kind, name, place) of the sources and actors that the lines of a tool's output name, each where it first appears."""
    lines = df.select(key, F.posexplode(F.split(output, "\n")).alias("place", "line"))
    source = F.when(F.contains("line", F.lit("Source:")), F.trim(F.regexp_extract("line", r"Source:([^(]*)(?:\(.*)?$", 1)))
    actor = F.when(F.col("line").rlike(r"\[(PERSON|ORG|GROUP)\]"), F.trim(F.regexp_extract("line", r"\]([^\]]*)$", 1)))
    rows = lines.select(key, "place", F.inline(F.array(F.struct(F.lit("source").alias("kind"), source.alias("name")), F.struct(F.lit("actor").alias("kind"), actor.alias("name"))))).where("name <> ''")
    return rows.groupBy(key, "kind", "name").agg(F.min("place").alias("place"))


def readable_files(df: DataFrame, name: str) -> DataFrame:
    """Files of a type that can be read, with their suffix."""
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    return df.select(name, suffix.alias("suffix")).where(F.col("suffix").isin(list(fixed.SUFFIXES)))
