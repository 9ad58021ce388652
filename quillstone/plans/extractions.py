"""Extraction by the offline rule model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.operators import evidence
from quillstone.operators import extraction as E
from quillstone.plans.base import Plans
from quillstone.plans.relational import _CLAIM, _KEYED, _PAIR, _RELATION
from quillstone.providers import RuleModel

plans = Plans()
query = plans.query


@query()
def ner_extract(spark: SparkSession, d: str) -> DataFrame:
    return E.entities(A.gold(spark, d).select("chunk_id", "chunk_text").distinct(), "chunk_id", "chunk_text")


@query()
def relation_extract(spark: SparkSession, d: str) -> DataFrame:
    return E.relations(A.gold(spark, d).select("chunk_id", "chunk_text").distinct(), "chunk_id", "chunk_text")


_KINDS = list(RuleModel.TYPES)
_HITS = "[" + ", ".join(f"len(regexp_extract_all(lower(chunk_text), '{p}'))" for _, p in _KINDS) + "]"
_NAMES = "[" + ", ".join(f"'{k}'" for k, _ in _KINDS) + "]"


@query(f"""SELECT chunk_id AS source_chunk_id, CASE WHEN n > 0 THEN {_NAMES}[list_position(hits, n)] ELSE 'no_event' END AS event_type, CAST(round(least(0.95, 0.4 + 0.15 * n), 2) AS DOUBLE) AS confidence, CASE WHEN round(least(0.95, 0.4 + 0.15 * n), 2) < {E.SURE} THEN 'few_shot' ELSE 'zero_shot' END AS strategy
 FROM (SELECT chunk_id, hits, list_max(hits) AS n FROM (SELECT chunk_id, {_HITS} AS hits FROM (SELECT DISTINCT chunk_id, chunk_text FROM ner_gold) WHERE chunk_text IS NOT NULL))""")
def event_classify_fallback(spark: SparkSession, d: str) -> DataFrame:
    return E.events(A.gold(spark, d).select("chunk_id", "chunk_text").distinct(), "chunk_id", "chunk_text")


@query(r"""SELECT doc_id AS key, regexp_matches(text, '\S') AND (""" + " OR ".join(f"contains(lower(text), '{w}')" for w in RuleModel.KEPT) + r""") AS keep, CASE WHEN regexp_matches(text, '\S') THEN 'model' ELSE 'empty' END AS reason FROM documents WHERE text IS NOT NULL""")
def prescreen(spark: SparkSession, d: str) -> DataFrame:
    return E.prescreen(A.table(spark, d, "documents"), "doc_id", "text")


@query(f"SELECT ord, ord % 4 <> 3 AS ok, CASE WHEN ord % 4 <> 3 THEN 'predicate,subject' END AS keys FROM {A.TRIPLES}")
def json_salvage(spark: SparkSession, d: str) -> DataFrame:
    """Triples as model answers: plain, fenced, after prose, and broken."""
    body = F.to_json(F.struct("subject", "predicate"))
    i = F.col("ord") % 4
    answer = F.when(i == 0, body).when(i == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(i == 2, F.concat(F.lit("Thus {so} it is: "), body, F.lit(" end"))).otherwise(F.concat(F.lit("no json {"), "subject"))
    return E.salvaged(A.triples(spark, d).withColumn("answer", answer), "ord", "answer")


_EV = f"(SELECT 'event' AS kind, a, b FROM ({_PAIR}{_KEYED}) ORDER BY a, b LIMIT 50)"
_RE = f"(SELECT 'relation' AS kind, a, b FROM (SELECT a, b, row_number() OVER (ORDER BY a, b) AS n FROM ({_RELATION})) WHERE n <= 100 - (SELECT count(*) FROM {_EV}))"
_ASKED = f"""(SELECT kind, a, b, substr(ca.claim, 1, 800) AS x, substr(cb.claim, 1, 800) AS y FROM {_EV} JOIN {_CLAIM(800, A.EVENTS)} ca ON ca.ord = a JOIN {_CLAIM(800, A.EVENTS)} cb ON cb.ord = b
 UNION ALL SELECT kind, a, b, substr(coalesce(ca.predicate, '') || ' ' || ca.claim, 1, 800), substr(coalesce(cb.predicate, '') || ' ' || cb.claim, 1, 800) FROM {_RE} JOIN {_CLAIM(400, A.TRIPLES)} ca ON ca.ord = a JOIN {_CLAIM(400, A.TRIPLES)} cb ON cb.ord = b)"""


@query(rf"""SELECT kind, a, b, 'numerical' AS type, CAST(0.7 AS DOUBLE) AS confidence FROM (SELECT kind, a, b, list_sort(list_distinct(regexp_extract_all(x, '\p{{Nd}}+'))) AS p, list_sort(list_distinct(regexp_extract_all(y, '\p{{Nd}}+'))) AS q FROM {_ASKED}) WHERE len(p) > 0 AND len(q) > 0 AND p <> q""")
def contradictions_confirmed(spark: SparkSession, d: str) -> DataFrame:
    pairs = evidence.to_verify(A.events(spark, d), A.triples(spark, d), 100)
    return E.verified(evidence.all_claims(pairs, A.events(spark, d), A.triples(spark, d), A.gold(spark, d)))
