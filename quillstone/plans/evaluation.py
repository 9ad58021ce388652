"""Evaluation of extractions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.functions import exprs as X
from quillstone.operators import metrics
from quillstone.plans.base import Plans

plans = Plans()
query = plans.query

_GOLD = f"(SELECT chunk_id, e.label AS label, lower(trim(e.text)) AS t, 1 AS g, 0 AS p FROM (SELECT chunk_id, unnest(entities) AS e FROM {A.GOLD}))"
_PRED = f"(SELECT source_chunk_id AS chunk_id, label, lower(trim(text)) AS t, 0 AS g, 1 AS p FROM {A.MENTIONS} WHERE source_chunk_id IN (SELECT chunk_id FROM ner_gold))"
_SETS = f"(SELECT chunk_id, label, t, max(g) AS g, max(p) AS p FROM (SELECT * FROM {_GOLD} UNION ALL SELECT * FROM {_PRED}) GROUP BY 1, 2, 3)"
_COUNTS = f"(SELECT chunk_id, label, count(*) FILTER (g = 1 AND p = 1) AS tp, count(*) FILTER (g = 0) AS fp, count(*) FILTER (p = 0) AS fn FROM {_SETS} GROUP BY 1, 2)"
_SCORES = f"""(SELECT *, CAST(round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 4) AS DOUBLE) AS precision, CAST(round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 4) AS DOUBLE) AS recall,
 CAST(round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 4) AS DOUBLE) AS f1 FROM {_COUNTS})"""


def _scores(spark: SparkSession, d: str) -> DataFrame:
    gold = A.gold(spark, d)
    flat = gold.select("chunk_id", F.explode("entities").alias("e")).select("chunk_id", "e.label", "e.text")
    predicted = A.mentions(spark, d).join(gold.select("chunk_id").distinct(), F.col("source_chunk_id") == F.col("chunk_id"), "left_semi").select(F.col("source_chunk_id").alias("chunk_id"), "label", "text")
    return metrics.per_chunk(flat, predicted)


@query(f"SELECT chunk_id, label, tp, fp, fn, precision, recall, f1 FROM {_SCORES}")
def ner_prf_per_chunk(spark: SparkSession, d: str) -> DataFrame:
    return _scores(spark, d)


_mean = lambda c: f"round(CAST(sum(CAST({c} AS DECIMAL(20,4))) AS DOUBLE) / count(*) + 1e-9, 4) AS {c}"


@query(f"SELECT label, {_mean('precision')}, {_mean('recall')}, {_mean('f1')}, count(*) AS chunk_count FROM {_SCORES} GROUP BY label")
def ner_macro(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro(_scores(spark, d))


_PARTS = " UNION ALL ".join(f"SELECT source_chunk_id AS chunk_id, {int(i == 0)} AS entities, {int(i == 1)} AS relations, {int(i == 2)} AS events FROM {t}" for i, t in enumerate((A.MENTIONS, A.TRIPLES, A.EVENTS)))


@query(f"SELECT chunk_id, CAST(sum(entities) AS BIGINT) AS entities, CAST(sum(relations) AS BIGINT) AS relations, CAST(sum(events) AS BIGINT) AS events FROM ({_PARTS}) GROUP BY 1")
def judge_join(spark: SparkSession, d: str) -> DataFrame:
    return metrics.judge_inputs(A.mentions(spark, d), A.triples(spark, d), A.events(spark, d))


_sql_mean = lambda: "round(CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / count(confidence) + 1e-9, 4)"


@query(f"SELECT 'entities' AS part, {_sql_mean()} AS score FROM {A.MENTIONS} UNION ALL SELECT 'relations', {_sql_mean()} FROM {A.TRIPLES} UNION ALL SELECT 'events', {_sql_mean()} FROM {A.EVENTS}")
def judge_aggregate(spark: SparkSession, d: str) -> DataFrame:
    part = lambda df, name: df.agg(X.mean(F.col("confidence")).alias("score")).select(F.lit(name).alias("part"), "score")
    return part(A.mentions(spark, d), "entities").unionByName(part(A.triples(spark, d), "relations")).unionByName(part(A.events(spark, d), "events"))


@query("SELECT item_id, question, ground_truth, length(ground_truth) AS answer_chars FROM eval_items")
def rag_dataset(spark: SparkSession, d: str) -> DataFrame:
    return A.table(spark, d, "eval_items").select("item_id", "question", "ground_truth", F.length("ground_truth").alias("answer_chars"))
