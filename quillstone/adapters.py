"""The stored tables as the engine's data model: redelivered rows once, explicit order columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.session import table

# The same for SQL.
CHUNKS = "(SELECT DISTINCT chunk_id, source_filename, source_url, doc_type, language, date_published, geography, chunk_index FROM chunk_metadata)"
GOLD = "(SELECT DISTINCT chunk_id, chunk_text, entities FROM ner_gold)"
MENTIONS = "(SELECT DISTINCT mention_id AS ord, text, label, confidence, source_chunk_id FROM mentions)"
TRIPLES = "(SELECT DISTINCT triple_id AS ord, subject, predicate, object, location, date, confidence, evidence, source_chunk_id FROM triples)"
EVENTS = "(SELECT DISTINCT result_id AS ord, event_type, confidence, date, location, perpetrator, victim_group, source_chunk_id FROM event_results)"
CANDIDATES = "(SELECT DISTINCT candidate_id AS ord, title, url, source, date, relevance_score, trigger_entity, snippet FROM candidates)"
REGISTRY = f"""(SELECT substr(sha256(label || '::' || lower(canonical)), 1, 12) AS canonical_id, canonical AS canonical_text, label, list_sort(list_filter(names, lambda x: x <> canonical)) AS aliases, occurrences, mean_confidence
FROM (SELECT label, key, max_by(text, struct_pack(n := n, o := -first_ord)) AS canonical, list(text) AS names, CAST(sum(n) AS BIGINT) AS occurrences, round(CAST(sum(total) AS DOUBLE) / sum(n) + 1e-9, 4) AS mean_confidence
FROM (SELECT label, lower(trim(text)) AS key, text, count(*) AS n, sum(CAST(confidence AS DECIMAL(20,6))) AS total, min(ord) AS first_ord FROM {MENTIONS} GROUP BY ALL) GROUP BY label, key))"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunk_metadata").drop("ingested_at").distinct()


def gold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ner_gold").distinct()


def mentions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "mentions").select(F.col("mention_id").alias("ord"), "text", "label", "confidence", "source_chunk_id").distinct()


def triples(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "triples").drop("extracted_at").withColumnRenamed("triple_id", "ord").distinct()


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "event_results").drop("extracted_at").withColumnRenamed("result_id", "ord").distinct()


def candidates(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "candidates").drop("discovered_at").withColumnRenamed("candidate_id", "ord").distinct()


def known_urls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "source_register").where("source_url <> ''").select(F.col("source_url").alias("url")).distinct()


def registry(spark: SparkSession, d: str) -> DataFrame:
    """Entities that differ in case and outer spaces only, under their most frequent spelling."""
    exact = mentions(spark, d).groupBy("label", F.lower(F.trim("text")).alias("key"), "text").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("confidence").cast("decimal(20,6)")).alias("total"), F.min("ord").alias("first_ord"))
    rows = exact.groupBy("label", "key").agg(
        F.max_by("text", F.struct("n", (-F.col("first_ord")).alias("o"))).alias("canonical_text"), F.collect_list("text").alias("names"), F.sum("n").alias("occurrences"), F.round(F.sum("total").cast("double") / F.sum("n") + 1e-9, 4).alias("mean_confidence"),
    )
    aliases = F.array_sort(F.filter("names", lambda x: x != F.col("canonical_text")))
    return rows.select(X.canonical_id(F.col("label"), F.col("canonical_text")).alias("canonical_id"), "canonical_text", "label", aliases.alias("aliases"), "occurrences", "mean_confidence")
