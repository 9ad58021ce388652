"""Vector retrieval and coverage gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.functions import exprs as X
from quillstone.operators import silence
from quillstone.operators import vectors as V
from quillstone.operators.components import connected_components
from quillstone.plans.base import Plans
from quillstone.plans.scalars import QUARTER
from quillstone.providers import HashEmbedder
from quillstone.session import cut, table

plans = Plans()
query = plans.query

_COS = "round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6)"
#: The stated query set: every vector whose id is divisible by 50.
_TOP = f"(SELECT query, key, cosine, rank FROM (SELECT a.vec_id AS query, b.vec_id AS key, {_COS} AS cosine, row_number() OVER (PARTITION BY a.vec_id ORDER BY {_COS} DESC, b.vec_id) AS rank FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0) WHERE rank <= 8)"
_NEAR = f"(SELECT a.vec_id AS a, b.vec_id AS b, {_COS} AS cosine FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings")


def _top(spark: SparkSession, d: str, k: int = 8, **more) -> DataFrame:
    rows = _embeddings(spark, d)
    return V.top_k(rows.where("vec_id % 50 = 0"), rows, "vec_id", "embedding", k, **more)


@query(f"SELECT a, b, cosine FROM {_NEAR} WHERE cosine >= 0.3")
def cosine_pairs(spark: SparkSession, d: str) -> DataFrame:
    return V.cosine_pairs(_embeddings(spark, d), "vec_id", "label", "embedding", 0.3)


@query(f"SELECT query, key, cosine, rank FROM {_TOP}")
def similarity_topk(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d)


@query(f"SELECT query, round(avg(cosine), 4) AS confidence FROM {_TOP} WHERE rank <= 3 GROUP BY query")
def retrieval_confidence(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d, 3).groupBy("query").agg(F.round(F.avg("cosine"), 4).alias("confidence"))


@query("SELECT label, pos, round(avg(x), 6) AS mean FROM (SELECT label, CAST(unnest(embedding) AS DOUBLE) AS x, unnest(range(len(embedding))) AS pos FROM embeddings) GROUP BY ALL")
def mean_embedding(spark: SparkSession, d: str) -> DataFrame:
    return V.mean_vector(_embeddings(spark, d), "label", "embedding")


_SIX = f"(SELECT t.*, CAST(e.embedding AS DOUBLE[]) AS v FROM {_TOP} t JOIN embeddings e ON e.vec_id = t.key WHERE rank <= 6)"


@query(f"""WITH c AS MATERIALIZED (SELECT * FROM {_SIX}), p1 AS (SELECT * FROM c WHERE rank = 1),
 p2 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.query ORDER BY round(0.5 * c.cosine - 0.5 * list_cosine_similarity(c.v, p1.v), 9) DESC, c.rank) AS k FROM c JOIN p1 ON p1.query = c.query AND p1.key <> c.key) WHERE k = 1),
 p3 AS (SELECT * FROM (SELECT c.*, row_number() OVER (PARTITION BY c.query ORDER BY round(0.5 * c.cosine - 0.5 * greatest(list_cosine_similarity(c.v, p1.v), list_cosine_similarity(c.v, p2.v)), 9) DESC, c.rank) AS k FROM c JOIN p1 ON p1.query = c.query AND p1.key <> c.key
 JOIN p2 ON p2.query = c.query AND p2.key <> c.key) WHERE k = 1) SELECT query, key, 1 AS pick FROM p1 UNION ALL SELECT query, key, 2 FROM p2 UNION ALL SELECT query, key, 3 FROM p3""")
def mmr_k3(spark: SparkSession, d: str) -> DataFrame:
    """Three diverse picks out of the six nearest."""
    return V.mmr(_top(spark, d, 6, with_vectors=True), 3)


@query()
def mmr_general(spark: SparkSession, d: str) -> DataFrame:
    return V.mmr(_top(spark, d, 16, with_vectors=True), 8)


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {_NEAR} WHERE cosine >= 0.3 UNION SELECT b, a FROM {_NEAR} WHERE cosine >= 0.3), r AS (SELECT DISTINCT a AS node, a AS reached FROM e UNION SELECT node, b FROM r JOIN e ON reached = a)
 SELECT node, min(reached) AS component FROM r GROUP BY node""")
def resolve_entities_cosine(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of one label linked by cosine, with their connected group."""
    return connected_components(V.cosine_pairs(_embeddings(spark, d), "vec_id", "label", "embedding", 0.3))


@query(f"""SELECT ord, score, rank FROM (SELECT ord, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, ord) AS rank FROM (SELECT ord, source, len(list_filter(['records', 'papers', 'captured'], lambda w: contains(lower(title), w))) AS score FROM {A.CANDIDATES})) WHERE rank <= 3""")
def lexical_rerank(spark: SparkSession, d: str) -> DataFrame:
    return silence.rerank(A.candidates(spark, d), ["records", "papers", "captured"], "title", "source", 3).select("ord", "score", "rank")


_CELLS = f"(SELECT coalesce(nullif(geography, ''), 'unknown') AS place, {QUARTER} AS quarter, count(*) AS chunk_count, count(DISTINCT source_filename) AS files FROM {A.CHUNKS} GROUP BY 1, 2)"
_EVENT_QUARTER = QUARTER.replace("date_published", "date")
_GRID = f"(SELECT place, quarter, round(n / max(n) OVER (), 4) AS intensity FROM (SELECT coalesce(nullif(location, ''), 'unknown') AS place, {_EVENT_QUARTER} AS quarter, count(*) AS n FROM {A.EVENTS} WHERE event_type <> 'no_event' GROUP BY 1, 2))"
_DENSITY = f"(SELECT c.*, round(chunk_count / max(chunk_count) OVER (), 4) AS density FROM {_CELLS} c)"


@query(f"SELECT c.place, c.quarter, chunk_count, files, round(coalesce(intensity, 0) - density, 4) AS score FROM {_DENSITY} c LEFT JOIN {_GRID} g ON g.place = c.place AND g.quarter = c.quarter")
def silence_density_map(spark: SparkSession, d: str) -> DataFrame:
    cells = silence.density(A.chunks(spark, d))
    return silence.gaps(cells, silence.grid(A.events(spark, d))).select("place", "quarter", "chunk_count", "files", "score")


@query(f"SELECT coalesce(c.place, g.place) AS place, coalesce(c.quarter, g.quarter) AS quarter, round(coalesce(intensity, 0) - coalesce(density, 0), 4) AS score FROM {_DENSITY} c FULL JOIN {_GRID} g ON g.place = c.place AND g.quarter = c.quarter")
def silence_with_empty_cells(spark: SparkSession, d: str) -> DataFrame:
    """Also the places and quarters of events that no chunk covers."""
    return silence.gaps(silence.density(A.chunks(spark, d)), silence.grid(A.events(spark, d)), include_empty=True).select("place", "quarter", "score")


@query(f"""SELECT query AS event_id, intensity, confidence, round(intensity - confidence, 4) AS score, CASE WHEN intensity > 0.7 AND confidence < 0.3 THEN 'high-intensity event with little coverage' WHEN intensity > confidence + 0.3 THEN 'notable gap between intensity and coverage' ELSE 'moderate gap' END AS reason
 FROM (SELECT query, round(query % 10 / 10, 4) AS intensity, round(avg(cosine), 4) AS confidence FROM {_TOP} WHERE rank <= 3 GROUP BY query)""")
def silence_expectation_gap(spark: SparkSession, d: str) -> DataFrame:
    """Stated events against what retrieval finds for them."""
    rows = retrieval_confidence(spark, d).withColumn("intensity", F.round(F.col("query") % 10 / 10, 4))
    return rows.select(F.col("query").alias("event_id"), "intensity", "confidence", F.round(F.col("intensity") - F.col("confidence"), 4).alias("score"), X.silence_reason(F.col("intensity"), F.col("confidence")).alias("reason"))


@query()
def fuzzy_ratio_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Spellings of one label whose match ratio is at least 72."""
    return silence.fuzzy_pairs(A.registry(spark, d), 72.0)


@query()
def resolve_entities_full(spark: SparkSession, d: str) -> DataFrame:
    """Registry entities joined by cosine of at least 0.88 or match ratio of at least 72: members and mentions."""
    registry = cut(A.registry(spark, d))
    rows = silence.resolved_entities(registry, silence.entity_links(registry, HashEmbedder()))
    return rows.select("entity", "canonical_text", "spellings", "occurrences")
