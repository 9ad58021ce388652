"""Precision, recall and F1 of extractions against gold, and judge inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def per_chunk(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Rows (chunk_id, label, tp, fp, fn, precision, recall, f1). Inputs: (chunk_id, label, text), compared in lower case as sets.

    Both sides are marked, united and reduced by one aggregation: a full outer join without a join.
    """
    mark = lambda df, g, p: df.select("chunk_id", "label", F.lower(F.trim("text")).alias("t"), F.lit(g).alias("g"), F.lit(p).alias("p"))
    both = mark(gold, 1, 0).unionByName(mark(predicted, 0, 1)).groupBy("chunk_id", "label", "t").agg(F.max("g").alias("g"), F.max("p").alias("p"))
    counts = both.groupBy("chunk_id", "label").agg(F.count_if((F.col("g") == 1) & (F.col("p") == 1)).alias("tp"), F.count_if(F.col("g") == 0).alias("fp"), F.count_if(F.col("p") == 0).alias("fn"))
    ratio = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    f1 = ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn"))
    return counts.select("*", F.round(precision, 4).alias("precision"), F.round(recall, 4).alias("recall"), F.round(f1, 4).alias("f1"))


def macro(scores: DataFrame, digits: int = 4) -> DataFrame:
    """Mean of the chunk scores by label, over the chunks that have the label."""
    exact = lambda c: F.round(F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.count(F.lit(1)) + 1e-9, digits).alias(c)
    return scores.groupBy("label").agg(exact("precision"), exact("recall"), exact("f1"), F.count(F.lit(1)).alias("chunk_count"))


def judge_inputs(mentions: DataFrame, triples: DataFrame, events: DataFrame) -> DataFrame:
    """Every chunk with any extraction, and how many of each kind it has."""
    part = lambda df, k: df.select(F.col("source_chunk_id").alias("chunk_id"), *[F.lit(int(i == k)).alias(c) for i, c in enumerate(("entities", "relations", "events"))])
    rows = part(mentions, 0).unionByName(part(triples, 1)).unionByName(part(events, 2))
    return rows.groupBy("chunk_id").agg(*[F.sum(c).alias(c) for c in ("entities", "relations", "events")])


def report(scores: DataFrame, target: float) -> DataFrame:
    """Rows (metric, score, target, reached): means over all rows of ``per_chunk``."""
    mean = lambda c: F.round(F.sum(F.col(c).cast("decimal(20,4)")).cast("double") / F.count(F.lit(1)) + 1e-9, 4)
    row = scores.agg(*[mean(c).alias(c) for c in ("precision", "recall", "f1")])
    rows = row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("score")) for c in ("precision", "recall", "f1")])))
    return rows.select("metric", "score", F.lit(target).alias("target"), (F.col("score") >= target).alias("reached"))


def judge_means(judged: DataFrame) -> DataFrame:
    """How many chunks were judged, and the means of their four scores."""
    mean = lambda c: F.round(F.sum(F.round(c, 6).cast("decimal(20,6)")).cast("double") / F.count(F.lit(1)) + 1e-9, 4).alias(c)
    return judged.agg(F.count(F.lit(1)).alias("chunks"), *[mean(c) for c in ("ner", "relation", "event", "overall")])


def counts(parts: dict[str, DataFrame]) -> DataFrame:
    """Rows (part, n)."""
    out = None
    for name, df in parts.items():
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out
