"""Crawler and agent sessions over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.functions import exprs as X
from quillstone.functions import fixed
from quillstone.plans.base import Plans
from quillstone.plans.relational import SESSIONS
from quillstone.plans.scalars import DOMAIN, DOMAIN_STATS, PDF, TRUSTED, _list
from quillstone.plans.streams import _FRONTIER, _frontier, _items
from quillstone.session import table
from quillstone.sources import connectors
from quillstone.streaming import frontier as S
from quillstone.streaming import sessions as N

plans = Plans()
query = plans.query

_KNOWN = "(SELECT DISTINCT source_url AS url FROM source_register WHERE source_url <> '')"
_SCORE = "CAST(round(greatest(0.0, least(1.0, 0.6 * {rel} + 0.3 * coalesce(score, 0.5) + CASE WHEN {pdf} THEN 0.15 ELSE 0.0 END + CASE WHEN {trusted} THEN 0.1 ELSE 0.0 END - 0.1 * {depth})), 3) AS DOUBLE)"
_SCORES = f"(SELECT domain, round(hits / attempts, 3) AS score FROM {DOMAIN_STATS} WHERE domain <> '')"


def _visits(spark: SparkSession, d: str) -> DataFrame:
    """Every candidate as a visit; those that are registered gave chunks."""
    known = A.known_urls(spark, d).withColumn("chunks", F.lit(1))
    return A.candidates(spark, d).join(known, "url", "left").select("url", F.coalesce("chunks", F.lit(0)).alias("chunks"))


@query(f"SELECT domain, attempts, hits, CAST(round(hits / attempts, 3) AS DOUBLE) AS score FROM {DOMAIN_STATS} WHERE domain <> '' ORDER BY score DESC, hits DESC, domain LIMIT 5")
def crawler_top_domains(spark: SparkSession, d: str) -> DataFrame:
    """The five domains that give most, as in the crawler's summary."""
    return N.domain_scores(_visits(spark, d)).orderBy(F.desc("score"), F.desc("hits"), "domain").limit(5)


@query(f"SELECT trigger_entity AS entity, count(*) AS mention_count FROM {A.CANDIDATES} WHERE trigger_entity IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def agent_top_entities(spark: SparkSession, d: str) -> DataFrame:
    """The ten leads seen most often, as in the agent's summary."""
    rows = A.candidates(spark, d).where("trigger_entity is not null").groupBy(F.col("trigger_entity").alias("entity")).agg(F.count(F.lit(1)).alias("mention_count"))
    return rows.orderBy(F.desc("mention_count"), "entity").limit(10)


@query(f"SELECT DISTINCT url FROM {A.CANDIDATES} WHERE ({PDF} OR {TRUSTED}) AND url NOT IN (SELECT url FROM {_KNOWN})")
def link_gate(spark: SparkSession, d: str) -> DataFrame:
    return N.worth_following(A.candidates(spark, d).select("url").distinct(), A.known_urls(spark, d))


@query(f"SELECT ord, host FROM (SELECT ord, CASE WHEN ord LIKE '%7' THEN 'reddit.com' ELSE {DOMAIN} END AS host FROM {A.CANDIDATES}) WHERE NOT list_contains({_list(fixed.BLOCKED_HOSTS)}, host)")
def blocked_hosts(spark: SparkSession, d: str) -> DataFrame:
    """Candidates without those of blocked hosts; none of the stored ones is blocked, so every key that ends in 7 stands in for one."""
    url = F.when(F.endswith("ord", F.lit("7")), F.lit("https://www.reddit.com/r/x")).otherwise(F.col("url"))
    rows = N.not_blocked(A.candidates(spark, d).select("ord", url.alias("url")))
    return rows.select("ord", X.domain(F.col("url")).alias("host"))


_BUSY = f"(SELECT DISTINCT {DOMAIN} AS host FROM {A.CANDIDATES} WHERE source = 'manual')"


@query(f"""SELECT url, round(priority, 6) AS priority FROM (SELECT *, {DOMAIN} AS host FROM (SELECT * FROM {_FRONTIER} ORDER BY priority DESC, url LIMIT 20)) WHERE NOT list_contains({_list(fixed.BLOCKED_HOSTS)}, host)
 ORDER BY host IN (SELECT host FROM {_BUSY}), priority DESC, url LIMIT 1""")
def next_fetch(spark: SparkSession, d: str) -> DataFrame:
    """The item a fetcher takes next while the hosts of manual rows are busy."""
    busy = A.candidates(spark, d).where("source = 'manual'").select(X.domain(F.col("url")).alias("domain"))
    return N.next_item(_frontier(spark, d), busy).select("url", F.round("priority", 6).alias("priority"))


_ITEM = f"(SELECT DISTINCT ON (url) * FROM {A.CANDIDATES} WHERE (relevance_score >= 0.6 OR {PDF} OR {TRUSTED}) AND url NOT IN (SELECT url FROM {_KNOWN}) ORDER BY url, relevance_score DESC, source DESC)"
_TAKEN = f"(SELECT url FROM {_FRONTIER} ORDER BY priority DESC, url LIMIT 40)"
_LINK = f"(SELECT DISTINCT regexp_replace(t.url, '[^/]*$', '') || 'annex.pdf' AS url, trigger_entity FROM {_TAKEN} t JOIN {_ITEM} i ON i.url = t.url WHERE NOT {PDF.replace('url', 't.url')})"
_RELEVANCE = r"round(least(1.0, 0.3 + 0.2 * len(list_filter(regexp_split_to_array(lower(trim(trigger_entity)), '\s+'), lambda t: t <> '' AND contains(lower(url), t)))), 3)"


@query(f"""WITH v AS MATERIALIZED (SELECT url, count(*) FILTER (k) AS chunks, count(*) AS n FROM (SELECT url, url IN (SELECT url FROM {_KNOWN}) AS k FROM {A.CANDIDATES} UNION ALL SELECT url, TRUE FROM {_TAKEN}) GROUP BY url),
 s AS (SELECT domain, round(sum(chunks) / sum(n), 3) AS score FROM (SELECT {DOMAIN} AS domain, chunks, n FROM v) GROUP BY 1),
 l AS (SELECT url, max({_SCORE.format(rel=_RELEVANCE, pdf=PDF, trusted=TRUSTED, depth=1)}) AS priority FROM (SELECT *, {DOMAIN} AS host FROM {_LINK} WHERE url NOT IN (SELECT url FROM v)) LEFT JOIN s ON host = domain GROUP BY url)
 SELECT url, priority, 1 AS depth FROM l""")
def crawl_links(spark: SparkSession, d: str) -> DataFrame:
    """One session of the crawler: 40 items (the session's size) are visited, each page has a report and a mail link; what it adds to the frontier."""
    frontier = _frontier(spark, d)
    taken, _ = S.step(frontier, frontier, 40)
    html = F.concat(F.lit('<a href="annex.pdf">a</a><a href="mailto:a@b.example">m</a><a href="plain.html">p</a><b>'), "url", F.lit("</b>"))
    pages = taken.select("url", html.alias("html"), F.lit(1).alias("chunks"))
    _, after = N.crawl(frontier, _visits(spark, d), pages, 40)
    return after.where("depth > 0").select("url", "priority", "depth")


_WEB = "('duckduckgo', 'wikipedia', 'crossref')"
_FIRST = f"(SELECT trigger_entity FROM {A.CANDIDATES} WHERE trigger_entity IS NOT NULL GROUP BY 1 ORDER BY min(ord) LIMIT 5)"


@query(f"""SELECT ord, {_SCORE.format(rel='relevance_score', pdf=PDF, trusted=TRUSTED, depth=0)} AS priority FROM (SELECT *, {DOMAIN} AS host FROM {A.CANDIDATES} WHERE url NOT IN (SELECT url FROM {_KNOWN})
 AND (source IN {_WEB} OR (source <> 'manual' AND trigger_entity IN (SELECT trigger_entity FROM {_FIRST})))) LEFT JOIN (SELECT DISTINCT {DOMAIN} AS domain, 1.0 AS score FROM {_KNOWN} WHERE {DOMAIN} <> '') ON host = domain""")
def seed_frontier(spark: SparkSession, d: str) -> DataFrame:
    """The web pass for all entities and the API pass for the first five; registered documents are the visits so far."""
    rows = A.candidates(spark, d).select("ord", "url", F.col("relevance_score").alias("relevance"), "trigger_entity", "source", F.lit(0).alias("depth"))
    web, api = rows.where(F.col("source").isin("duckduckgo", "wikipedia", "crossref")), rows.where(~F.col("source").isin("duckduckgo", "wikipedia", "crossref", "manual"))
    entities = rows.where("trigger_entity is not null").groupBy(F.col("trigger_entity").alias("entity")).agg(F.min("ord").alias("ord"))
    seeded = N.seeds(web.withColumn("source", F.col("ord")), api.withColumn("source", F.col("ord")), entities, A.known_urls(spark, d).withColumn("chunks", F.lit(1)))
    return seeded.select(F.col("source").alias("ord"), "priority")


_KEYS = _list(fixed.TEMPLATES)


@query(f"""SELECT template, yield_rate, row_number() OVER (ORDER BY yield_rate DESC, place) - 1 AS position FROM (SELECT template, place, CAST(CASE WHEN coalesce(sum(runs), 0) = 0 THEN 1.0 ELSE round(sum(hits) / sum(runs), 3) END AS DOUBLE) AS yield_rate
 FROM (SELECT unnest({_KEYS}) AS template, unnest(range(5)) AS place) LEFT JOIN (SELECT {_KEYS}[1 + length(title) % 4] AS t, 1 AS runs, CAST(relevance_score >= 0.4 AS INT) AS hits FROM {A.CANDIDATES}) ON t = template GROUP BY ALL)""")
def template_order(spark: SparkSession, d: str) -> DataFrame:
    """The templates in the order of what they gave; candidates are spread over four of the five by the length of their title."""
    keys = F.array(*[F.lit(k) for k in fixed.TEMPLATES])
    runs = A.candidates(spark, d).select(F.element_at(keys, F.length("title") % 4 + 1).alias("template"), F.lit(1).alias("runs"), (F.col("relevance_score") >= 0.4).cast("int").alias("new_docs"))
    return N.template_order(runs).select("template", "yield_rate", "position")


_SIZED = "(SELECT CAST(floor(event_id / 500) AS BIGINT) AS session, count(*) FILTER (event_type = 'error') AS skipped, count(*) FILTER (event_type = 'view') % 12 AS frontier, count(*) AS n FROM events GROUP BY 1)"


@query(f"SELECT session, CASE WHEN skipped > 0.22 * n THEN 'drift' WHEN frontier < 5 THEN 'frontier' WHEN session % 6 = 0 THEN 'interval' END AS reason FROM {_SIZED}")
def reseed_rules(spark: SparkSession, d: str) -> DataFrame:
    """Which sessions seed again and why; a session is 500 events, its skips are the errors."""
    rows = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("session")).agg(F.count_if(F.col("event_type") == "error").alias("skipped"), (F.count_if(F.col("event_type") == "view") % 12).alias("frontier"), F.count(F.lit(1)).alias("n"))
    return rows.select("session", N.reseed_reason(F.col("frontier"), F.col("session"), F.col("skipped") > 0.22 * F.col("n")).alias("reason"))


@query("SELECT user_id, count(*) // 100 AS milestones, count(*) FILTER (event_type <> 'error') // 5 AS saves FROM events GROUP BY 1")
def session_milestones(spark: SparkSession, d: str) -> DataFrame:
    """Milestones (every 100 classified) and saves (every 5 ingested) of each user's events."""
    rows = table(spark, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("classified"), F.count_if(F.col("event_type") != "error").alias("ingested"))
    return rows.select("user_id", *N.milestones(F.col("classified"), F.col("ingested")))


@query("SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 14")
def activity_ring(spark: SparkSession, d: str) -> DataFrame:
    return N.activity(table(spark, d, "events"), [F.desc("ts"), F.desc("event_id")]).select("event_id", "event_type")


_LATEST = f"(SELECT sum(skipped) / sum(skipped + ingested) > 0.1 AS drift FROM (SELECT * FROM {SESSIONS} ORDER BY session DESC LIMIT 3))"
_ABOUT = "(contains(lower(f.url || ' ' || coalesce(trigger_entity, '')), 'guard') OR contains(lower(f.url || ' ' || coalesce(trigger_entity, '')), 'reports'))"


@query(f"SELECT f.url FROM {_FRONTIER} f JOIN {_ITEM} i ON i.url = f.url CROSS JOIN {_LATEST} l WHERE NOT drift OR {_ABOUT} ORDER BY priority DESC, f.url LIMIT (SELECT CASE WHEN drift THEN 200 ELSE 5000 END FROM {_LATEST})")
def drift_prune(spark: SparkSession, d: str) -> DataFrame:
    """If the last three sessions skip too much, the frontier is cut to 200 items on topic."""
    sessions = table(spark, d, "events").groupBy(F.floor(F.col("event_id") / 500).alias("session")).agg(F.count_if(F.col("event_type") == "error").alias("skipped"), F.count_if(F.col("event_type") != "error").alias("ingested"))
    last = sessions.orderBy(F.desc("session")).limit(3).agg(F.sum("skipped") / F.sum(F.col("skipped") + F.col("ingested"))).first()[0] or 0.0
    frontier = _frontier(spark, d)
    return (S.pruned(frontier, ["guard", "reports"], 200) if last > 0.1 else frontier).select("url")


_URL = "replace(replace(url_encode(entity), '%20', '+'), '~', '%7E')"


@query(f"SELECT source, entity, replace(pattern, '{{q}}', {_URL}) AS url FROM (SELECT canonical_text AS entity FROM {A.REGISTRY} WHERE label IN ('PERSON', 'ORG') AND regexp_full_match(canonical_text, '[A-Za-z0-9 .-]+') ORDER BY occurrences DESC, canonical_id LIMIT 10), (SELECT unnest({_list(fixed.SEARCH_URLS)}) AS source, unnest({_list(fixed.SEARCH_URLS.values())}) AS pattern)")
def source_requests(spark: SparkSession, d: str) -> DataFrame:
    """The requests of a discovery run for the ten entities mentioned most whose names are plain letters."""
    top = A.registry(spark, d).where(F.col("label").isin("PERSON", "ORG") & F.col("canonical_text").rlike("^[A-Za-z0-9 .-]+$")).orderBy(F.desc("occurrences"), "canonical_id").limit(10)
    return connectors.requests(top.select(F.col("canonical_text").alias("entity")))


_TYPE = "CASE WHEN source = 'arxiv' THEN 'application/pdf' WHEN source = 'gdelt' THEN NULL ELSE 'text/html; charset=utf-8' END"


@query(f"SELECT ord, CASE WHEN contains(coalesce({_TYPE}, 'text/html'), 'pdf') OR ends_with(lower(url), '.pdf') THEN 'download' WHEN contains(coalesce({_TYPE}, 'text/html'), 'text/html') THEN 'page' ELSE 'skip' END AS route FROM {A.CANDIDATES}")
def content_route(spark: SparkSession, d: str) -> DataFrame:
    """How each candidate would be fetched, by its content type and name; an unknown type counts as a page."""
    kind = F.when(F.col("source") == "arxiv", "application/pdf").when(F.col("source") != "gdelt", "text/html; charset=utf-8")
    return A.candidates(spark, d).select("ord", X.route(F.col("url"), kind).alias("route"))


_PICK = f"(SELECT * FROM {A.CANDIDATES} WHERE relevance_score >= 0.5 AND url NOT IN (SELECT url FROM {_KNOWN}))"


@query(f"""SELECT (SELECT count(*) FROM {A.CANDIDATES}) AS candidates_found, (SELECT count(*) FROM {_PICK}) AS above_threshold, count(*) AS fetched, coalesce(sum(chunks), 0)::BIGINT AS chunks_added, count(*) FILTER (chunks = 0) AS skipped
 FROM (SELECT length(title) % 5 AS chunks FROM {_PICK} ORDER BY relevance_score DESC, ord LIMIT 100)""")
def fetch_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of a fetch run of at most 100 documents; the chunks each gave are stood in for by the length of its title."""
    rows = A.candidates(spark, d)
    pick = rows.where("relevance_score >= 0.5").join(A.known_urls(spark, d), "url", "left_anti")
    return connectors.fetch_totals(rows, pick, pick.orderBy(F.desc("relevance_score"), "ord").limit(100).select((F.length("title") % 5).alias("chunks")))


@query(f"""SELECT source, count(*) AS documents, count(*) FILTER (relevance_score >= 0.4) AS relevant, 2 * (SELECT count(DISTINCT trigger_entity) FROM {A.CANDIDATES}) + 9 AS query_count FROM {A.CANDIDATES} GROUP BY source""")
def discovery_report(spark: SparkSession, d: str) -> DataFrame:
    """What a discovery run found by source, and how many requests it took: two sources ask once for each entity, nine once for all."""
    rows = A.candidates(spark, d)
    asked = rows.agg((2 * F.count_distinct("trigger_entity") + 9).alias("query_count")).withColumn("one", F.lit(1))
    found = rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.col("relevance_score") >= 0.4).alias("relevant"))
    return found.withColumn("one", F.lit(1)).join(F.broadcast(asked), "one").drop("one")  # asked is one row


@query(f"SELECT ord FROM (SELECT *, row_number() OVER (PARTITION BY url ORDER BY ord) AS k FROM (SELECT c.* FROM {A.CANDIDATES} c JOIN (SELECT DISTINCT ON (ord) ord FROM {A.CANDIDATES}) o ON o.ord = c.ord)) WHERE k = 1 AND url NOT IN (SELECT url FROM {_KNOWN})")
def new_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each document that no source had before."""
    rows = A.candidates(spark, d).groupBy("url").agg(F.min("ord").alias("ord"))
    return rows.join(A.known_urls(spark, d), "url", "left_anti").select("ord")
