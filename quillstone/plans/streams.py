"""Stateful operators on their final state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone import adapters as A
from quillstone.functions import exprs as X
from quillstone.plans.base import Plans
from quillstone.plans.scalars import DOMAIN, PDF, TRUSTED, domain_stats
from quillstone.session import table
from quillstone.streaming import frontier as S
from quillstone.streaming import windows as W

plans = Plans()
query = plans.query

_FRONTIER = f"(SELECT url, max(relevance_score) AS priority FROM {A.CANDIDATES} WHERE (relevance_score >= 0.6 OR {PDF} OR {TRUSTED}) AND url NOT IN (SELECT source_url FROM source_register WHERE source_url <> '') GROUP BY url ORDER BY priority DESC, url LIMIT 5000)"


def _items(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("url", F.col("relevance_score").alias("priority"), "trigger_entity", "source", F.lit(0).alias("depth"))


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    empty = spark.createDataFrame([], S.ITEM)
    return S.enqueue(empty, A.known_urls(spark, d), S.gated(_items(spark, d), 0.6))


@query(f"SELECT url, round(priority, 6) AS priority, row_number() OVER (ORDER BY priority DESC, url) <= 40 AS taken FROM {_FRONTIER}")
def frontier_step(spark: SparkSession, d: str) -> DataFrame:
    """One session: the 40 best items (the session's size) are taken, the others stay."""
    taken, rest = S.step(_frontier(spark, d), A.known_urls(spark, d), 40)
    mark = lambda df, flag: df.select("url", F.round("priority", 6).alias("priority"), F.lit(flag).alias("taken"))
    return mark(taken, True).unionByName(mark(rest, False))


@query(f"SELECT domain, attempts, CAST(hits AS BIGINT) AS hits FROM (SELECT {DOMAIN} AS domain, count(*) AS attempts, count(*) FILTER (url IN (SELECT source_url FROM source_register WHERE source_url <> '')) AS hits FROM {A.CANDIDATES} GROUP BY 1)")
def domain_stats_stream(spark: SparkSession, d: str) -> DataFrame:
    """The final state of the crawler's domain counts, as a stream over the same visits leaves it."""
    return domain_stats(spark, d)


@query(f"SELECT DISTINCT 'search ' || lower(trigger_entity) AS query FROM {A.CANDIDATES} WHERE trigger_entity IS NOT NULL AND source <> 'manual' AND lower(trigger_entity) NOT IN (SELECT lower(trigger_entity) FROM {A.CANDIDATES} WHERE source = 'manual' AND trigger_entity IS NOT NULL)")
def query_queue_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Queries not yet run; those of manual rows count as run."""
    rows = A.candidates(spark, d).where("trigger_entity is not null").select("source", F.concat(F.lit("search "), F.lower("trigger_entity")).alias("query"))
    return rows.where("source <> 'manual'").select("query").distinct().join(rows.where("source = 'manual'").select("query"), "query", "left_anti")


_ITEM = f"(SELECT DISTINCT ON (url) url, trigger_entity FROM {A.CANDIDATES} WHERE (relevance_score >= 0.6 OR {PDF} OR {TRUSTED}) ORDER BY url, relevance_score DESC, source DESC)"
_ABOUT = "lower(f.url || ' ' || coalesce(trigger_entity, ''))"


@query(f"SELECT f.url FROM {_FRONTIER} f JOIN {_ITEM} i ON i.url = f.url WHERE contains({_ABOUT}, 'guard') OR contains({_ABOUT}, 'docs') ORDER BY priority DESC, f.url LIMIT 200")
def prune_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The 200 best items on topic, by address or entity, the size a drifting frontier is cut to."""
    return S.pruned(_frontier(spark, d), ["guard", "docs"], 200).select("url")


@query("SELECT user_id, event_id, k FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM events) WHERE k % 3 = 0")
def reason_every_n(spark: SparkSession, d: str) -> DataFrame:
    """Every third event of a user fires."""
    k = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return table(spark, d, "events").select("user_id", "event_id", k.alias("k")).where("k % 3 = 0")


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def window_tumbling(spark: SparkSession, d: str) -> DataFrame:
    return W.tumbling(table(spark, d, "events"), "ts", "event_type")


@query("SELECT start, count(*) AS n FROM (SELECT date_trunc('hour', ts) - INTERVAL (h) HOUR AS start FROM events, (VALUES (0), (1)) t(h)) GROUP BY 1")
def window_sliding(spark: SparkSession, d: str) -> DataFrame:
    return W.sliding(table(spark, d, "events"), "ts")


@query("""SELECT min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS n FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events)) GROUP BY user_id, s""")
def window_session(spark: SparkSession, d: str) -> DataFrame:
    return W.sessions(table(spark, d, "events"), "ts", "user_id")


@query(f"SELECT ord, {PDF} OR {TRUSTED} OR relevance_score >= 0.5 AS passes FROM {A.CANDIDATES}")
def frontier_gate(spark: SparkSession, d: str) -> DataFrame:
    url = F.col("url")
    return A.candidates(spark, d).select("ord", (X.is_pdf(url) | X.trusted(url) | (F.col("relevance_score") >= 0.5)).alias("passes"))
