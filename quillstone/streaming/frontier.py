"""Discovery frontier: a pure batch step, and the stream that applies it batch by batch.

State is two tables in one folder. The frontier, of bounded size, is versioned: a batch reads version n and writes n + 1. Visits are only added, a part for each batch, so a
session's cost does not grow with what was visited before but for one anti-join. A batch that is run again gives the same version and the same part, and nothing twice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quillstone.functions import exprs as X

ITEM = "url string, priority double, trigger_entity string, source string, depth int"


def gated(items: DataFrame, min_relevance: float) -> DataFrame:
    """Items worth a visit: sure enough, or a report file, or a trusted host."""
    return items.where((F.col("priority") >= min_relevance) | X.is_pdf(F.col("url")) | X.trusted(F.col("url")))


def enqueue(frontier: DataFrame, visited: DataFrame, new: DataFrame, cap: int = 5000) -> DataFrame:
    """The frontier with the new items that are neither visited nor queued, the best ``cap`` of them (the frontier's size is a feature)."""
    fresh = new.groupBy("url").agg(F.max_by(F.struct(*[c for c in new.columns if c != "url"]), F.struct("priority", "source")).alias("i")).select("url", "i.*")
    fresh = fresh.join(visited.select("url"), "url", "left_anti").join(frontier.select("url"), "url", "left_anti")
    return frontier.unionByName(fresh.select(frontier.columns)).orderBy(F.desc("priority"), "url").limit(cap)


def step(frontier: DataFrame, visited: DataFrame, batch: int) -> tuple[DataFrame, DataFrame]:
    """(taken, remaining): the best ``batch`` items, and the others."""
    taken = frontier.orderBy(F.desc("priority"), "url").limit(batch)
    return taken, frontier.join(taken.select("url"), "url", "left_anti")


def pruned(frontier: DataFrame, anchors: list[str], keep: int) -> DataFrame:
    """Items about one of the anchors, the best ``keep``."""
    text = F.lower(F.concat_ws(" ", "url", "trigger_entity"))
    about = F.exists(F.filter(F.array(*[F.lit(a) for a in anchors]), lambda a: F.length(a) > 2), lambda a: F.contains(text, F.lower(a)))
    return frontier.where(about).orderBy(F.desc("priority"), "url").limit(keep)


def run_stream(spark: SparkSession, items: DataFrame, state: str, checkpoint: str, batch: int, min_relevance: float = 0.35) -> StreamingQuery:
    """Each micro-batch is one session: enqueue what arrived, take the best, mark them visited."""

    def load(path: str, first: bool, schema: str) -> DataFrame:
        return spark.createDataFrame([], schema) if first else spark.read.schema(schema).parquet(path)

    def session(rows: DataFrame, n: int) -> None:
        frontier = load(f"{state}/frontier/{n - 1}", n == 0, ITEM)
        visited = load(f"{state}/visited", n == 0, "url string, session int").where(F.col("session") < n)
        queued = enqueue(frontier, visited, gated(rows, min_relevance)).persist()
        taken, rest = step(queued, visited, batch)
        rest.write.mode("overwrite").parquet(f"{state}/frontier/{n}")
        taken.select("url").write.mode("overwrite").parquet(f"{state}/visited/session={n}")
        queued.unpersist()

    return items.writeStream.foreachBatch(session).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
