"""Vector search: cosine, top-k, diversity, mean vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quillstone.operators.pairs import pairs_within
from quillstone.session import cut

#: Query vectors searched at once; a larger query set takes several passes.
QUERY_BLOCK = 4096


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def unit(df: DataFrame, vector: str) -> DataFrame:
    """``df`` with the vector as unit doubles; zero vectors stay zero."""
    norm = F.sqrt(dot(F.col(vector), F.col(vector)))
    return df.withColumn(vector, F.transform(vector, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0)))


def cosine_pairs(df: DataFrame, key: str, group: str, vector: str, threshold: float) -> DataFrame:
    """Pairs a < b of one group at least ``threshold`` similar."""
    rows = unit(df.select(key, group, vector), vector)
    near = dot(F.col(f"a_{vector}"), F.col(f"b_{vector}"))
    pairs = pairs_within(rows, group, key, F.col(f"a_{key}") < F.col(f"b_{key}"))
    return pairs.select(F.col(f"a_{key}").alias("a"), F.col(f"b_{key}").alias("b"), F.round(near, 6).alias("cosine")).where(F.col("cosine") >= threshold)


def cosine_links(df: DataFrame, key: str, group: str, vector: str, threshold: float, bands: int = 24, bits: int = 8, seed: int = 5) -> DataFrame:
    """Pairs a < b of one group at least ``threshold`` similar, for groups too large for all pairs.

    Candidates share one of ``bands`` keys, each ``bits`` signs of random projections; keys in many rows are cut into blocks. Candidates are then compared exactly, so no
    pair is wrong. A pair of cosine c is met with chance 1 - (1 - (1 - acos(c) / pi) ** bits) ** bands: 0.998 at 0.88. Null and empty vectors are linked to nothing.
    """
    rows = cut(df.select(F.col(key).alias("key"), F.col(group).cast("string").alias("group"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") > 0))

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            m = np.array(batch["v"].tolist(), dtype=np.float64)
            planes = np.random.default_rng(seed).standard_normal((m.shape[1], bands * bits))
            signs = (m @ planes > 0).reshape(len(m), bands, bits) @ (1 << np.arange(bits))
            keys = [[f"{g}\x1f{i}\x1f{s}" for i, s in enumerate(row)] for g, row in zip(batch["group"], signs.tolist(), strict=True)]
            yield pd.DataFrame({"key": batch["key"], "bands": keys})

    kind = df.schema[key].dataType.simpleString()
    index = cut(rows.mapInPandas(sign, f"key {kind}, bands array<string>").select("key", F.explode("bands").alias("band")))
    pairs = pairs_within(index, "band", "key", F.col("a_key") < F.col("b_key")).select("a_key", "b_key").distinct()
    side = lambda c: rows.select(F.col("key").alias(f"{c}_key"), F.col("v").alias(f"{c}_v"))
    both = pairs.join(side("a"), "a_key").join(side("b"), "b_key")

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            a, b = (np.array(batch[f"{c}_v"].tolist(), dtype=np.float64) for c in "ab")
            norm = np.linalg.norm(a, axis=1) * np.linalg.norm(b, axis=1)
            near = np.round(np.where(norm > 0, (a * b).sum(axis=1) / np.maximum(norm, 1e-12), 0.0), 6)
            yield pd.DataFrame({"a": batch["a_key"], "b": batch["b_key"], "cosine": near})[near >= threshold]

    return both.select("a_key", "a_v", "b_key", "b_v").mapInPandas(compare, f"a {kind}, b {kind}, cosine double")


def near(m: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: float, wanted: Callable[[np.ndarray, np.ndarray], np.ndarray], tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a row of ``left`` and one of ``right`` at least ``threshold`` similar, all of them; zero vectors are near nothing. ``wanted`` may leave out pairs."""
    norm = np.linalg.norm(m, axis=1)
    unit = (m / np.maximum(norm, 1e-12)[:, None]).astype(np.float32)
    left, right = left[norm[left] > 0], right[norm[right] > 0]
    other = unit[right].T.copy()
    for k in range(0, len(left), tile):
        x, y = np.nonzero(unit[left[k : k + tile]] @ other >= threshold - 1e-4)
        x, y = left[k + x], right[y]
        for i in range(0, len(x), 32 * tile):
            a, b = x[i : i + 32 * tile], y[i : i + 32 * tile]
            on = (a != b) & wanted(a, b)
            a, b = a[on], b[on]
            on = np.round((m[a] * m[b]).sum(axis=1) / np.maximum(norm[a] * norm[b], 1e-12), 6) >= threshold
            yield a[on], b[on]


def top_k(queries: DataFrame, rows: DataFrame, key: str, vector: str, k: int, with_self: bool = False, with_vectors: bool = False) -> DataFrame:
    """Rows (query, key, cosine, rank) of the ``k`` nearest rows of every query.

    The query set goes to all tasks in blocks of ``QUERY_BLOCK``; each batch of rows keeps its own ``k`` best of each query, and only those are shuffled.
    """
    dim_type = "array<double>"
    stated = queries.select(F.col(key).alias("q"), F.col(vector).alias("v")).where("q is not null and v is not null").dropDuplicates(["q"])
    out = None
    # The stated query set comes to the driver a block at a time.
    stream, more = stated.toLocalIterator(), True
    while more:
        block = list(islice(stream, QUERY_BLOCK))
        more = len(block) == QUERY_BLOCK
        if not block:
            break
        names = [r[0] for r in block]
        matrix = np.array([r[1] for r in block], dtype=np.float64)
        matrix /= np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)
        shared = rows.sparkSession.sparkContext.broadcast((names, matrix))

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            names, matrix = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                m = np.array(batch["v"].tolist(), dtype=np.float64)
                m /= np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
                keys = batch["k"].to_numpy()
                scores = np.round(matrix @ m.T, 6)
                parts = []
                for i, q in enumerate(names):
                    s = scores[i] if with_self else np.where(keys == q, -2.0, scores[i])
                    best = np.lexsort((keys, -s))[:k]
                    best = best[s[best] > -2.0]
                    part = {"query": [q] * len(best), "key": keys[best], "cosine": s[best]}
                    if with_vectors:
                        part["vector"] = [m[j].tolist() for j in best]
                    parts.append(pd.DataFrame(part))
                yield pd.concat(parts)

        kind = rows.schema[key].dataType.simpleString()
        schema = f"query {kind}, key {kind}, cosine double" + (f", vector {dim_type}" if with_vectors else "")
        found = rows.select(F.col(key).alias("k"), F.col(vector).alias("v")).where("v is not null").mapInPandas(run, schema)
        out = found if out is None else out.unionByName(found)
    if out is None:
        kind = rows.schema[key].dataType.simpleString()
        out = rows.sparkSession.createDataFrame([], f"query {kind}, key {kind}, cosine double" + (f", vector {dim_type}" if with_vectors else ""))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "key"))
    return out.withColumn("rank", rank).where(F.col("rank") <= k)


def mmr(found: DataFrame, k: int, weight: float = 0.5) -> DataFrame:
    """Rows (query, key, pick): greedy choice of ``k`` of each query's candidates by similarity less redundancy.

    ``found`` is a result of ``top_k`` with vectors, so a group has at most its k rows.
    """

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["cosine", "key"], ascending=[False, True], ignore_index=True)
        m, near = np.array(rows["vector"].tolist()), rows["cosine"].to_numpy()
        picked: list[int] = []
        while len(picked) < min(k, len(rows)):
            spare = [i for i in range(len(rows)) if i not in picked]
            score = [round(weight * near[i] - (1 - weight) * (max(float(m[i] @ m[j]) for j in picked) if picked else 0.0), 9) for i in spare]
            picked.append(spare[int(np.argmax(score))])
        return pd.DataFrame({"query": rows["query"].iloc[picked], "key": rows["key"].iloc[picked], "pick": np.arange(1, len(picked) + 1)})

    kind = found.schema["key"].dataType.simpleString()
    return found.groupBy("query").applyInPandas(choose, f"query {kind}, key {kind}, pick int")


def mean_vector(df: DataFrame, group: str, vector: str, digits: int = 6) -> DataFrame:
    """Element-wise mean by group: rows (group, pos, mean)."""
    flat = df.select(group, F.posexplode(vector).alias("pos", "x"))
    return flat.groupBy(group, "pos").agg(F.round(F.avg(F.col("x").cast("double")), digits).alias("mean"))
