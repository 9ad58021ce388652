"""Coverage gaps, lexical reranking and fuzzy spelling pairs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.functions import exprs as X
from quillstone.operators import spelling
from quillstone.operators import vectors as V
from quillstone.operators.components import connected_components, joined
from quillstone.operators.pairs import cells
from quillstone.providers import Embedder
from quillstone.session import cut

#: Entities of a block; two blocks are compared at once.
BLOCK = 2048


def _place(column: str):
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("unknown"))


def _share(df: DataFrame, count: str, name: str) -> DataFrame:
    """``count`` over its largest value; the maximum is one row, joined on a constant key."""
    top = df.agg(F.max(count).alias("top_")).withColumn("one_", F.lit(1))
    return df.withColumn("one_", F.lit(1)).join(top, "one_").withColumn(name, F.round(F.col(count) / F.col("top_"), 4)).drop("one_", "top_")


def density(chunks: DataFrame) -> DataFrame:
    """Chunks and files by place and quarter, and the share of the fullest cell."""
    cells = chunks.groupBy(_place("geography").alias("place"), X.quarter(F.col("date_published")).alias("quarter")).agg(F.count(F.lit(1)).alias("chunk_count"), F.count_distinct("source_filename").alias("files"))
    return _share(cells, "chunk_count", "density")


def grid(events: DataFrame) -> DataFrame:
    """Intensity of events by place and quarter."""
    cells = events.where("event_type <> 'no_event'").groupBy(_place("location").alias("place"), F.coalesce(X.quarter(F.col("date")), F.lit("unknown")).alias("quarter")).agg(F.count(F.lit(1)).alias("n"))
    return _share(cells, "n", "intensity").drop("n")


def gaps(cells: DataFrame, grid_: DataFrame, include_empty: bool = False) -> DataFrame:
    rows = cells.join(grid_, ["place", "quarter"], "full_outer" if include_empty else "left")
    return rows.withColumn("score", F.round(F.coalesce("intensity", F.lit(0.0)) - F.coalesce("density", F.lit(0.0)), 4))


def export_rows(gaps_: DataFrame) -> DataFrame:
    """Rows (place, quarter, score, reason) of the cells with more events than coverage."""
    reason = X.silence_reason(F.coalesce("intensity", F.lit(0.0)), F.coalesce("density", F.lit(0.0)))
    return gaps_.where("score > 0").select("place", "quarter", "score", reason.alias("reason"))


def silent_places(gaps_: DataFrame, k: int) -> DataFrame:
    """The ``k`` known places with the widest gap."""
    return gaps_.where("place <> 'unknown'").groupBy("place").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "place").limit(k)


def naming(rows: DataFrame, text: str, places: DataFrame) -> DataFrame:
    """Rows that name one of ``places``, once for each; the places are a stated list of one search, so it is read and becomes part of the plan."""
    names = [r["place"] for r in places.select("place").collect()]
    hits = F.filter(F.array(*[F.lit(n) for n in names]).cast("array<string>"), lambda n: F.contains(F.lower(text), F.lower(n)))
    return rows.withColumn("place", F.explode(hits))


def rerank(df: DataFrame, words: list[str], text: str, group: str, k: int) -> DataFrame:
    """The ``k`` rows of each group that hold most of the query's words."""
    score = F.size(F.filter(F.array(*[F.lit(w) for w in words]), lambda w: F.contains(F.lower(text), w)))
    rows = df.withColumn("score", score)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(F.desc("score"), "ord"))).where(F.col("rank") <= k)


def fuzzy_pairs(registry: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, ratio) of entities of one label whose texts match at least ``threshold`` of 100: all such pairs.

    Blocks of a label meet in cells. In a cell every pair is bounded by arrays, so only the result leaves it.
    """
    rows = cut(registry.select(F.col("canonical_id").alias("id"), _label(), F.lower("canonical_text").alias("t")).where("id is not null and t <> ''").distinct())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        ids = rows["id"].to_numpy()
        for a, b, ratio in spelling.near(rows["t"].tolist(), *_sides(rows), threshold):
            yield pd.DataFrame({"a": ids[a], "b": ids[b], "ratio": ratio})

    return cells(rows, "label", "id", BLOCK).groupBy("cell_g", "cell_i", "cell_j").applyInPandas(run, "a string, b string, ratio double")


def _label():
    """The label as a group of its own where it is null."""
    return F.concat_ws("\x1f", F.lit("label"), "label").alias("label")


def _sides(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order of the ids, and the rows of both blocks of a cell."""
    rank, block = pd.factorize(rows["id"], sort=True)[0], rows["block_"].to_numpy()
    left = np.flatnonzero(block == rows["cell_i"].iloc[0])
    return rank, left, left if rows["cell_i"].iloc[0] == rows["cell_j"].iloc[0] else np.flatnonzero(block == rows["cell_j"].iloc[0])


def entity_links(registry: DataFrame, embedder: Embedder, cosine: float = 0.88, fuzzy: float = 72.0) -> DataFrame:
    """Rows (a, b) that connect all entities of one label that are near in meaning or in spelling: not each near pair, but the groups are the same.

    Blocks of a label meet in cells. A cell compares all its pairs but those that are connected already, and gives one link less than the entities it connects.
    """

    def embed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                # Vectors travel as bytes, in single precision only where the model gives no more.
                m = np.asarray(embedder.embed(batch["canonical_text"].fillna("").tolist()))
                m = m if m.dtype == np.float32 else m.astype(np.float64)
                yield batch.assign(v=[x.tobytes() for x in m], wide=m.dtype == np.float64)[["id", "label", "t", "v", "wide"]]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(batches, ignore_index=True)
        rank, left, right = _sides(rows)
        ids, texts = rows["id"].to_numpy(), rows["t"].fillna("")
        m = np.array([np.frombuffer(v, np.float64 if wide else np.float32) for v, wide in zip(rows["v"], rows["wide"], strict=True)], np.float64)
        root = np.arange(len(rows))
        apart = lambda a, b: root[a] != root[b]
        for a, b in V.near(m, left, right, cosine, apart):
            root = joined(root, a, b)
        filled = texts.to_numpy() != ""
        sides = [left[filled[left]]] * 2 if left is right else [left[filled[left]], right[filled[right]]]
        for a, b, _ in spelling.near(texts.tolist(), rank, *sides, fuzzy, apart):
            root = joined(root, a, b)
        at = np.flatnonzero(root != np.arange(len(rows)))
        yield pd.DataFrame({"a": np.minimum(ids[root[at]], ids[at]), "b": np.maximum(ids[root[at]], ids[at])})

    named = registry.select(F.col("canonical_id").alias("id"), _label(), F.lower("canonical_text").alias("t"), "canonical_text").where("id is not null")
    rows = cut(named.mapInPandas(embed, "id string, label string, t string, v binary, wide boolean"))
    return cells(rows, "label", "id", BLOCK).groupBy("cell_g", "cell_i", "cell_j").applyInPandas(run, "a string, b string").distinct()


def resolved_entities(registry: DataFrame, links: DataFrame) -> DataFrame:
    """Rows (entity, canonical_text, label, names, spellings, occurrences, mean_confidence): connected groups of a registry, under their most frequent text."""
    groups = connected_components(links, "a", "b")
    rows = registry.join(groups, F.col("canonical_id") == F.col("node"), "left").withColumn("entity", F.coalesce("component", "canonical_id"))
    top = F.struct("occurrences", "canonical_id")
    return rows.groupBy("entity").agg(
        F.max_by("canonical_text", top).alias("canonical_text"), F.max_by("label", top).alias("label"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.array("canonical_text"), "aliases")))).alias("names"),
        F.count(F.lit(1)).alias("spellings"), F.sum("occurrences").alias("occurrences"), F.round(F.sum(F.col("mean_confidence") * F.col("occurrences")) / F.sum("occurrences"), 4).alias("mean_confidence"),
    )
