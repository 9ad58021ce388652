"""Reports: evaluation, judge, silence, status."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.functions import exprs as X
from quillstone.operators import metrics, ranking, silence
from quillstone.plans.base import Plans
from quillstone.plans.evaluation import _SCORES, _scores
from quillstone.plans.graphs import COLLAPSED, EDGES, NODES, _graph
from quillstone.plans.relational import _CAPPED
from quillstone.plans.vector_queries import _DENSITY, _GRID
from quillstone.session import table

plans = Plans()
query = plans.query

_FLAT = lambda c: f"CAST(round(CAST(sum(CAST({c} AS DECIMAL(20,4))) AS DOUBLE) / count(*) + 1e-9, 4) AS DOUBLE)"


@query(" UNION ALL ".join(f"SELECT '{c}' AS metric, {_FLAT(c)} AS score, 0.7 AS target, {_FLAT(c)} >= 0.7 AS reached FROM {_SCORES}" for c in ("precision", "recall", "f1")).replace("0.7 AS target", "CAST(0.7 AS DOUBLE) AS target"))
def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Scores over all chunks and labels against their target."""
    return metrics.report(_scores(spark, d), 0.7)


_JUDGED = f"""(SELECT m.source_chunk_id AS chunk_id, least(1.0, CAST(count(*) AS DOUBLE) / 10) AS ner, CAST(round(CAST(sum(CAST(confidence AS DECIMAL(20,6))) AS DOUBLE) / count(confidence) + 1e-9, 4) AS DOUBLE) AS relation, CAST(count(DISTINCT label) AS DOUBLE) / 7 AS event
 FROM {A.MENTIONS} m GROUP BY 1)"""
_MEAN4 = lambda c: f"CAST(round(CAST(sum(CAST(round({c}, 6) AS DECIMAL(20,6))) AS DOUBLE) / count(*) + 1e-9, 4) AS DOUBLE) AS {c}"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Scores a judge could have given, made from the mentions of each chunk."""
    rows = A.mentions(spark, d).groupBy(F.col("source_chunk_id").alias("chunk_id")).agg(F.least(F.lit(1.0), F.count(F.lit(1)) / 10.0).alias("ner"), X.mean(F.col("confidence")).alias("relation"), (F.count_distinct("label") / 7.0).alias("event"))
    return rows.withColumn("overall", (F.col("ner") + F.col("relation") + F.col("event")) / 3)


@query(f"SELECT count(*) AS chunks, {_MEAN4('ner')}, {_MEAN4('relation')}, {_MEAN4('event')}, {_MEAN4('overall')} FROM (SELECT *, (ner + relation + event) / 3 AS overall FROM {_JUDGED})")
def judge_scores(spark: SparkSession, d: str) -> DataFrame:
    """Means of the four scores of a judge's rows."""
    return metrics.judge_means(_judged(spark, d))


@query(f"""SELECT issue, count(*) AS n FROM (SELECT unnest(list_filter([CASE WHEN coalesce(evidence, '') = '' THEN 'no evidence' END, CASE WHEN object IS NULL THEN 'no object' END, CASE WHEN coalesce(date, '') = '' THEN 'no date' END, CASE WHEN coalesce(location, '') = '' THEN 'no place' END,
 CASE WHEN confidence < 0.5 THEN 'unsure' END, CASE WHEN confidence >= 0.9 AND coalesce(evidence, '') = '' THEN 'sure without evidence' END], x -> x IS NOT NULL)) AS issue FROM {A.TRIPLES}) GROUP BY 1 ORDER BY n DESC, issue LIMIT 5""".replace("x -> x IS NOT NULL", "lambda x: x IS NOT NULL"))
def judge_issues(spark: SparkSession, d: str) -> DataFrame:
    """The five issues named most, over the issues that can be read off the relations themselves."""
    empty = lambda c: F.coalesce(c, F.lit("")) == ""
    found = F.array_compact(F.array(
        F.when(empty("evidence"), "no evidence"), F.when(F.col("object").isNull(), "no object"), F.when(empty("date"), "no date"), F.when(empty("location"), "no place"),
        F.when(F.col("confidence") < 0.5, "unsure"), F.when((F.col("confidence") >= 0.9) & empty("evidence"), "sure without evidence"),
    ))
    return ranking.top_values(A.triples(spark, d).select(F.explode(found).alias("issue")), "issue", 5)


_GAP = f"(SELECT c.place, c.quarter, round(coalesce(intensity, 0) - density, 4) AS score, density, coalesce(intensity, 0) AS intensity FROM {_DENSITY} c LEFT JOIN {_GRID} g ON g.place = c.place AND g.quarter = c.quarter)"


def _gaps(spark: SparkSession, d: str) -> DataFrame:
    return silence.gaps(silence.density(A.chunks(spark, d)), silence.grid(A.events(spark, d)))


@query(f"""SELECT place, quarter, score, CASE WHEN intensity > 0.7 AND density < 0.3 THEN 'high-intensity event with little coverage' WHEN intensity > density + 0.3 THEN 'notable gap between intensity and coverage' ELSE 'moderate gap' END AS reason FROM {_GAP} WHERE score > 0""")
def silence_export(spark: SparkSession, d: str) -> DataFrame:
    """Every gap with its reason, the rows of the silence export."""
    return silence.export_rows(_gaps(spark, d))


_SILENT = f"(SELECT place FROM {_GAP} WHERE place <> 'unknown' GROUP BY place ORDER BY max(score) DESC, place LIMIT 15)"


@query(f"SELECT DISTINCT c.ord, place FROM {A.CANDIDATES} c JOIN {_SILENT} ON contains(lower(c.title), lower(place))")
def discover_for_silences(spark: SparkSession, d: str) -> DataFrame:
    """Candidates that name one of the 15 places with the widest gaps (the size of a silence search)."""
    places = silence.silent_places(_gaps(spark, d), 15)
    return silence.naming(A.candidates(spark, d), "title", places).select("ord", "place")


@query(f"""SELECT 'files' AS part, count(DISTINCT source_filename) AS n FROM {A.CHUNKS} UNION ALL SELECT 'chunks', count(*) FROM {A.CHUNKS} UNION ALL SELECT 'registered', count(DISTINCT filename) FROM source_register UNION ALL SELECT 'pdf files', count(DISTINCT filename) FROM source_register WHERE lower(filename) LIKE '%.pdf'
 UNION ALL SELECT 'mentions', count(*) FROM {A.MENTIONS} UNION ALL SELECT 'relations', count(*) FROM {A.TRIPLES} UNION ALL SELECT 'events', count(*) FROM {A.EVENTS} UNION ALL SELECT 'entities', count(*) FROM {A.REGISTRY} UNION ALL SELECT 'graph nodes', count(*) FROM {NODES} UNION ALL SELECT 'graph edges', count(*) FROM {COLLAPSED}""")
def project_status(spark: SparkSession, d: str) -> DataFrame:
    """The counts of a project's status page."""
    nodes, edges = _graph(spark, d)
    register = table(spark, d, "source_register").select("filename").distinct()
    parts = {
        "files": A.chunks(spark, d).select("source_filename").distinct(), "chunks": A.chunks(spark, d), "registered": register, "pdf files": register.where(F.endswith(F.lower("filename"), F.lit(".pdf"))), "mentions": A.mentions(spark, d), "relations": A.triples(spark, d),
        "events": A.events(spark, d), "entities": A.registry(spark, d), "graph nodes": nodes, "graph edges": edges.select("source_id", "target_id").distinct(),
    }
    return metrics.counts(parts)


@query(f"SELECT 'node' AS part, type, count(*) AS n FROM {NODES} GROUP BY type UNION ALL SELECT 'edge', CASE WHEN is_command THEN 'command' ELSE 'other' END, count(*) FROM {EDGES} GROUP BY 2")
def graph_summary(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    count = lambda df, part: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(part).alias("part"), "type", "n")
    return count(nodes, "node").unionByName(count(edges.withColumn("type", F.when(F.col("is_command"), "command").otherwise("other")), "edge"))


@query(f"SELECT kind, count(*) AS pairs, count(DISTINCT a) AS firsts, min(a) AS first_a FROM {_CAPPED} GROUP BY kind")
def contradiction_summary(spark: SparkSession, d: str) -> DataFrame:
    from quillstone.operators import evidence

    rows = evidence.assessed(A.events(spark, d), A.triples(spark, d), 100)
    return rows.groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.count_distinct("a").alias("firsts"), F.min("a").alias("first_a"))


_BAG = lambda c: f"list_distinct(regexp_extract_all(lower(coalesce({c}, '')), '[\\p{{L}}\\p{{N}}]{{3,}}'))"
_SHARE = lambda a, b: f"CAST(CASE WHEN len({a}) > 0 THEN round(len(list_intersect({a}, {b})) / len({a}), 4) ELSE 0 END AS DOUBLE)"


@query(f"SELECT item_id, {_SHARE('a', 'c')} AS faithfulness, {_SHARE('g', 'c')} AS context_recall, {_SHARE('g', 'a')} AS answer_relevance FROM (SELECT item_id, {_BAG('substr(ground_truth, 1, 120)')} AS a, {_BAG('question')} AS c, {_BAG('ground_truth')} AS g FROM eval_items)")
def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    """Lexical scores of answers; the first 120 characters of the truth stand in for the answer, the question for the context."""
    from quillstone import agents

    rows = table(spark, d, "eval_items").select("item_id", F.substr("ground_truth", F.lit(1), F.lit(120)).alias("answer"), F.col("question").alias("context"), "ground_truth")
    return agents.answer_scores(rows).select("item_id", "faithfulness", "context_recall", "answer_relevance")
