"""Crawler and agent sessions as steps over tables: visits, links, domain scores, seeding, choice of the next item, milestones, drift.

Visits are appended, never rewritten: what is known of a domain or a query template is an aggregate over them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from quillstone.functions import exprs as X
from quillstone.functions import fixed
from quillstone.streaming import frontier as S

API_ENTITIES, SCANNED, RING = 5, 20, 14
MILESTONE, SAVE_EVERY = 100, 5


def domain_scores(visits: DataFrame) -> DataFrame:
    """Rows (domain, attempts, hits, score) of visits (url, chunks): a visit that gave chunks is a hit."""
    rows = visits.groupBy(X.domain(F.col("url")).alias("domain")).agg(F.count(F.lit(1)).alias("attempts"), F.count_if(F.col("chunks") > 0).alias("hits"))
    return rows.where("domain <> ''").withColumn("score", X.ratio_or(F.col("hits"), F.col("attempts"), 0.5))


def prioritised(items: DataFrame, scores: DataFrame) -> DataFrame:
    """Items (url, relevance, depth, …) with a priority from relevance, the domain's hit rate, trust and depth."""
    rows = items.withColumn("domain_", X.domain(F.col("url"))).join(scores.select(F.col("domain").alias("known_"), "score"), F.col("domain_") == F.col("known_"), "left")
    return rows.withColumn("priority", X.frontier_priority(F.col("relevance"), F.col("score"), F.col("url"), F.col("depth"))).drop("domain_", "known_", "score")


def worth_following(links: DataFrame, visited: DataFrame) -> DataFrame:
    """Links (url, …) to report files and trusted hosts that were not visited."""
    return links.where(X.is_pdf(F.col("url")) | X.trusted(F.col("url"))).join(visited.select("url"), "url", "left_anti")


def not_blocked(items: DataFrame) -> DataFrame:
    return items.where(~X.domain(F.col("url")).isin(list(fixed.BLOCKED_HOSTS)))


def next_item(frontier: DataFrame, saturated: DataFrame) -> DataFrame:
    """The item to fetch next: of the best ``SCANNED``, the first whose host is neither blocked nor saturated, else the best that is not blocked."""
    best = frontier.orderBy(F.desc("priority"), "url").limit(SCANNED)
    busy = saturated.select(F.col("domain").alias("busy_")).distinct()
    rows = not_blocked(best).join(busy, X.domain(F.col("url")) == F.col("busy_"), "left")
    return rows.orderBy(F.col("busy_").isNotNull(), F.desc("priority"), "url").limit(1).drop("busy_")


def links_of(pages: DataFrame, visited: DataFrame, scores: DataFrame) -> DataFrame:
    """Frontier items, one level deeper, from the links of visited pages (url, html, trigger_entity, source, depth)."""
    found = pages.where(~X.is_pdf(F.col("url"))).select("trigger_entity", "source", (F.col("depth") + 1).alias("depth"), F.explode(X.links(F.col("html"), F.col("url"))).alias("url"))
    found = worth_following(found, visited).withColumn("relevance", X.relevance(F.col("trigger_entity"), F.col("url"), 0.3))
    return prioritised(found, scores).select("url", "priority", "trigger_entity", "source", "depth")


def crawl(frontier: DataFrame, visits: DataFrame, pages: DataFrame, batch: int, min_relevance: float = 0.4) -> tuple[DataFrame, DataFrame]:
    """One session: (new visits, new frontier). ``pages`` (url, html, chunks) is what fetching the taken items gave; an item without a page had no chunks."""
    taken, rest = S.step(frontier, visits, batch)
    fetched = S.gated(taken, min_relevance).join(pages, "url", "left")
    new = taken.select("url", "trigger_entity").join(fetched.select("url", F.coalesce("chunks", F.lit(0)).alias("n_")), "url", "left").select("url", "trigger_entity", F.coalesce("n_", F.lit(0)).cast("long").alias("chunks"))
    known = visits.select("url", "chunks").unionByName(new.select("url", "chunks"))
    links = links_of(fetched.where("html is not null").select("url", "html", "trigger_entity", "source", "depth"), known, domain_scores(known))
    return new, S.enqueue(rest, known, links)


def seeds(web: DataFrame, api: DataFrame, entities: DataFrame, visits: DataFrame) -> DataFrame:
    """Items of the web pass for all entities (entity, ord), and of the API pass for the first ``API_ENTITIES`` only."""
    first = entities.orderBy("ord").limit(API_ENTITIES).select(F.col("entity").alias("trigger_entity"))
    rows = web.unionByName(api.join(first, "trigger_entity", "left_semi"))
    return prioritised(rows.join(visits.select("url"), "url", "left_anti"), domain_scores(visits)).select("url", "priority", "trigger_entity", "source", "depth")


def template_order(runs: DataFrame, templates: dict[str, str] = fixed.TEMPLATES) -> DataFrame:
    """Rows (template, pattern, yield_rate, position) of the search templates, best yield first; ``runs`` has (template, new_docs, runs). A template never run comes with the best."""
    stats = runs.groupBy("template").agg(F.sum("new_docs").alias("new_docs"), F.sum("runs").alias("runs"))
    listed = F.inline(F.array(*[F.struct(F.lit(i).alias("place"), F.lit(k).alias("template"), F.lit(v).alias("pattern")) for i, (k, v) in enumerate(templates.items())]))
    rows = runs.sparkSession.range(1).select(listed).join(stats, "template", "left").withColumn("yield_rate", X.ratio_or(F.coalesce("new_docs", F.lit(0)), F.coalesce("runs", F.lit(0)), 1.0))
    # The templates are a fixed list of five, so their array is small.
    ranked = rows.groupBy().agg(F.array_sort(F.collect_list(F.struct((-F.col("yield_rate")).alias("y"), "place", "template", "pattern", "yield_rate"))).alias("r")).select(F.posexplode("r").alias("position", "r"))
    return ranked.select("r.template", "r.pattern", "r.yield_rate", "position")


def reseed_reason(frontier: Column, sessions: Column, drifting: Column, low: int = 5, every: int = 6) -> Column:
    """Why the frontier is seeded again, null where it is not."""
    return F.when(drifting, "drift").when(frontier < low, "frontier").when(sessions % every == 0, "interval")


def milestones(classified: Column, ingested: Column) -> tuple[Column, Column]:
    """How many milestones and how many saves a session has passed."""
    return F.floor(classified / MILESTONE).alias("milestones"), F.floor(ingested / SAVE_EVERY).alias("saves")


def activity(events: DataFrame, order: list[Column]) -> DataFrame:
    """The latest ``RING`` rows, what the live panel shows."""
    return events.orderBy(*order).limit(RING)


class Activity(StreamingQueryListener):
    """Keeps the last ``RING`` progress reports of the session's streams."""

    def __init__(self) -> None:
        self.lines: list[str] = []

    def _push(self, line: str) -> None:
        self.lines = [*self.lines, line][-RING:]

    def onQueryStarted(self, event) -> None:  # noqa: ANN001, N802
        self._push(f"started {event.id}")

    def onQueryProgress(self, event) -> None:  # noqa: ANN001, N802
        self._push(f"batch {event.progress.batchId}: {event.progress.numInputRows} rows")

    def onQueryIdle(self, event) -> None:  # noqa: ANN001, N802
        self._push(f"idle {event.id}")

    def onQueryTerminated(self, event) -> None:  # noqa: ANN001, N802
        self._push(f"ended {event.id}")
