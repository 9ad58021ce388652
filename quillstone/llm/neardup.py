"""Near-duplicate records by prefix filters under several global token orders.

Records are sets of 64-bit features, hashes of runs of words. For Jaccard similarity t two sets of sizes a and b can only reach t if, under any
one global order of the features, their first n - ceil(t n) + 1 features share one. Three orders are used:

1. rare features first: features that recur within a stretch of rows are counted and come last, by their counts, the others in the order of their
   hashes. Candidates come from an equi-join on the prefix. A frequent feature is no key by itself: two sets whose first shared feature is
   frequent share a second one behind it, so pairs of frequent features are the keys. Any order of features gives the same result; the counts only decide what it costs.
2. and 3. two orders by other hashes. Their prefixes travel with the keys of small sets as 64-bit masks and must meet in the same join; the exact prefixes
   of all candidates are intersected before the sets are compared.

Sizes, the places of the shared features and parities of the sets bound the overlap in the join too; what passes is looked at by parities of four to eight bits for each feature before
whole sets are fetched. Two sets that differ in d features differ in at most d bits of their parities, also where the longer one is folded to the length of the other.

Exact copies (equal sets) are one class throughout and are expanded only in the result. Posting lists longer than a
block, and classes of many copies, are cut into blocks. Defined cases: null and empty texts, and texts with fewer
words than a run, have no features and no partners; repeated (key, text) rows count once; a key with several
different texts is compared by each of them and never with itself; ties do not arise; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.llm.hashing import mix, shingle_hashes
from quillstone.operators.components import connected_components
from quillstone.operators.pairs import pairs_within
from quillstone.session import cut

EPSILON, PAIR_LIMIT, MASKED, SKETCHED = 1e-9, 64, 64, 128
#: A feature is frequent if it is counted ``FREQUENT`` times. Of the features that recur ``RECURS`` times in a stretch of rows the ``LISTED`` most counted are put in order, which bounds the list each worker gets.
FREQUENT, LISTED, RECURS = 100, 1 << 20, 2
SEEDS = np.array([0x8CB92BA72F3D8DD7, 0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F], dtype=np.uint64)


def _flat(column: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """All features of a batch in one array, and the size of each set."""
    sizes = np.fromiter((len(x) for x in column), dtype=np.int64, count=len(column))
    values = np.concatenate([np.asarray(x, dtype=np.int64) for x in column]) if sizes.sum() else np.zeros(0, dtype=np.int64)
    return values.view(np.uint64), sizes


def _sets(texts: list, run: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each text, sorted, in one array, and the number each text has."""
    values, owner = shingle_hashes([t if isinstance(t, str) else "" for t in texts], run)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.append(True, (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])) if len(values) else np.zeros(0, dtype=bool)
    return values[new], np.bincount(owner[new], minlength=len(texts))


def classes(df: DataFrame, key: str, text: str, run: int) -> DataFrame:
    """Rows (class, key, features, sketch): records with equal sets of features have one class, of 128 bits; the sketch has the parities of the set."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            values, sizes = _sets(batch["t"].tolist(), run)
            ends = np.cumsum(sizes)
            has = np.flatnonzero(sizes)
            if not len(has):
                continue
            with np.errstate(over="ignore"):
                names = [np.add.reduceat(mix((values ^ s) * s), ends[has] - sizes[has]) for s in SEEDS[:2]]
            sketch = _sketch(values, sizes)
            yield pd.DataFrame({"class": [f"{a:016x}{b:016x}" for a, b in zip(*[n.tolist() for n in names], strict=True)], "key": batch["k"].iloc[has].tolist(), "features": [values[ends[i] - sizes[i] : ends[i]].view(np.int64) for i in has], "sketch": [sketch[i] for i in has]})

    kind = df.schema[key].dataType.simpleString()
    rows = df.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null")
    # Keys cross to Python as text: a null among numbers would turn them into floats there.
    return rows.mapInPandas(read, "class string, key string, features array<long>, sketch array<long>").withColumn("key", F.col("key").cast(kind))


def _sketch(values: np.ndarray, sizes: np.ndarray) -> list[np.ndarray]:
    """Bits for each set, each the parity of the features that fall on it; 64 times a power of two, at least four for each feature."""
    with np.errstate(over="ignore"):
        hashed = mix(values * SEEDS[1])
    width = np.left_shift(1, np.ceil(np.log2(np.maximum(sizes / 16, 1))).astype(np.int64))
    ends = np.cumsum(width)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, dtype=np.uint64)
    at = np.repeat(ends - width, sizes) + ((hashed >> np.uint64(20)).astype(np.int64) & (np.repeat(width, sizes) - 1))
    np.bitwise_xor.at(out, at, np.uint64(1) << (hashed >> np.uint64(58)))
    return [out[e - w : e].view(np.int64) for e, w in zip(ends.tolist(), width.tolist(), strict=True)]


def _apart(a: np.ndarray, b: np.ndarray) -> int:
    """Bits in which two sketches differ; the longer is folded to the length of the shorter."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    while len(b) > len(a):
        b = b[: len(b) // 2] ^ b[len(b) // 2 :]
    return int(np.bitwise_count((a ^ b).view(np.uint64)).sum())


def _prefixes(values: np.ndarray, sizes: np.ndarray, take: np.ndarray, seed: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``take`` features of each set in the order of the hashes, and the set each is of."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    with np.errstate(over="ignore"):
        hashed = mix((values ^ seed) * seed)
    order = np.lexsort((hashed, owner))
    place = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    kept = place < np.repeat(take, sizes)
    return hashed[order][kept], owner[kept]


def _mask(values: np.ndarray, sizes: np.ndarray, take: np.ndarray, seed: np.uint64) -> np.ndarray:
    """A bit for each prefix feature; all bits for the sets too large for 64 to tell anything."""
    hashed, owner = _prefixes(values, sizes, take, seed)
    out = np.zeros(len(sizes), dtype=np.uint64)
    np.bitwise_or.at(out, owner, np.uint64(1) << (hashed >> np.uint64(58)))
    out[sizes > MASKED] = np.uint64(0xFFFFFFFFFFFFFFFF)
    return out


def _need(sizes: np.ndarray, threshold: float) -> np.ndarray:
    return np.ceil(sizes * threshold - EPSILON).astype(np.int64)


def recurring_features(sets: DataFrame) -> tuple[np.ndarray, int]:
    """The most counted features in rising order of their counts, at most ``LISTED``, and the place from which on they are frequent."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            # What does not recur within a stretch of rows is not frequent; it is not sent.
            values, n = np.unique(_flat(batch["features"])[0], return_counts=True)
            keep = n >= RECURS
            if not keep.any():
                continue
            yield pd.DataFrame({"feature": values[keep].view(np.int64), "n": n[keep]})

    rows = sets.select("features").mapInPandas(count, "feature long, n long").groupBy("feature").agg(F.sum("n").alias("n"))
    found = rows.orderBy(F.desc("n"), "feature").limit(LISTED).toPandas()[::-1]
    return found["feature"].to_numpy(dtype=np.int64).view(np.uint64), int((found["n"] < FREQUENT).sum())


def entries(sets: DataFrame, threshold: float) -> DataFrame:
    """Rows (token, id, n, need, at, drawn, x, second, third): the join keys of each set under the first order."""
    listed, frequent = recurring_features(sets)
    shared = sets.sparkSession.sparkContext.broadcast((np.sort(listed), np.argsort(listed, kind="stable").astype(np.int32)))

    def keys(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, rank = shared.value
        for batch in batches:
            values, sizes = _flat(batch["features"])
            need = _need(sizes, threshold)
            take = sizes - need + 1
            with np.errstate(over="ignore"):
                bits = np.uint64(1) << (mix(values * SEEDS[2]) >> np.uint64(58))
            starts = np.cumsum(sizes) - sizes
            x = np.where(sizes <= SKETCHED, np.bitwise_xor.reduceat(bits, starts), np.uint64(0))
            second, third = (_mask(values, sizes, take, s) for s in SEEDS[:2])
            owner = np.repeat(np.arange(len(sizes)), sizes)
            at = np.searchsorted(known, values)
            hit = known[np.minimum(at, len(known) - 1)] == values if len(known) else np.zeros(len(values), dtype=bool)
            late = np.where(hit, rank[np.minimum(at, len(known) - 1)] + 1, 0) if len(known) else np.zeros(len(values), dtype=np.int64)
            order = np.lexsort((values, late, owner))
            values, late = values[order], late[order]
            place = np.arange(len(values)) - np.repeat(starts, sizes) + 1
            rare = late <= frequent
            # Alone: rare features; frequent ones of large sets, and of sets so small that one shared feature may be all.
            n, one = sizes[owner], need[owner] <= 1
            single = (place <= take[owner]) & (rare | (n > PAIR_LIMIT * threshold) | one)
            i = np.flatnonzero(single)
            token, mine, where, drawn = [values[i]], [owner[i]], [place[i]], [np.where(rare[i], 0, 1)]
            # In pairs: frequent features of the prefix that is one longer, of small sets.
            hot = np.flatnonzero(~rare & (n <= PAIR_LIMIT) & (place <= take[owner] + 1))
            if len(hot):
                of, first = np.unique(owner[hot], return_index=True)
                for a, b in zip(first, np.append(first[1:], len(hot)), strict=True):
                    u, v = np.triu_indices(b - a, 1)
                    u, v = hot[a:b][u], hot[a:b][v]
                    with np.errstate(over="ignore"):
                        token.append(mix(values[u] * SEEDS[0] + values[v]))
                    mine.append(owner[u]), where.append(place[v]), drawn.append(np.full(len(u), 2))
            mine = np.concatenate(mine)
            yield pd.DataFrame({
                "token": np.concatenate(token).view(np.int64), "id": batch["id"].to_numpy()[mine], "n": sizes[mine].astype(np.int32), "at": np.concatenate(where).astype(np.int32), "drawn": np.concatenate(drawn).astype(np.int32),
                "x": x[mine].view(np.int64), "second": second[mine].view(np.int64), "third": third[mine].view(np.int64),
            })

    return sets.select("id", "features").mapInPandas(keys, "token long, id long, n int, at int, drawn int, x long, second long, third long")


def class_links(members: DataFrame, threshold: float) -> DataFrame:
    """Rows (a, b, similarity) of classes a < b whose sets are at least ``threshold`` similar."""
    sets = cut(members.select("class", "features", "sketch", F.size("features").alias("n")).dropDuplicates(["class"]).withColumn("id", F.monotonically_increasing_id()))
    found = cut(entries(sets, threshold))
    least = F.ceil((F.col("a_n") + F.col("b_n")) * (threshold / (1 + threshold)) - EPSILON)
    reach = F.least(F.col("a_n") - F.col("a_at"), F.col("b_n") - F.col("b_at")) + F.greatest(F.col("a_drawn"), F.lit(1))
    larger, smaller = F.greatest("a_n", "b_n"), F.least("a_n", "b_n")
    differ = F.bit_count(F.col("a_x").bitwiseXOR(F.col("b_x")))
    need = lambda n: F.ceil(n * threshold - EPSILON)
    near = (
        (F.col("a_id") < F.col("b_id"))
        & (smaller >= larger * threshold - EPSILON)
        & (F.col("a_drawn") == F.col("b_drawn"))
        # A frequent feature alone serves only pairs that have no key of two.
        & ((F.col("a_drawn") != 1) | (larger > PAIR_LIMIT) | (need(larger) <= 1))
        & (reach >= least)
        & ((larger > SKETCHED) | (differ <= F.col("a_n") + F.col("b_n") - 2 * least))
        & (F.col("a_second").bitwiseAND(F.col("b_second")) != 0)
        & (F.col("a_third").bitwiseAND(F.col("b_third")) != 0)
    )
    candidates = pairs_within(found, "token", "id", near).select("a_id", "b_id").distinct()
    side = lambda c, *names: sets.select(*[F.col(x).alias(f"{c}_{x}") for x in ("id", *names)])
    seen = candidates.join(side("a", "n", "sketch"), "a_id").join(side("b", "n", "sketch"), "b_id")

    def sift(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            n = (batch["a_n"] + batch["b_n"]).to_numpy()
            may = n - 2 * np.ceil(n * (threshold / (1 + threshold)) - EPSILON)
            keep = [_apart(np.asarray(a), np.asarray(b)) <= m for a, b, m in zip(batch["a_sketch"], batch["b_sketch"], may.tolist(), strict=True)]
            yield batch.loc[keep, ["a_id", "b_id"]]

    close = cut(seen.select("a_id", "b_id", "a_n", "b_n", "a_sketch", "b_sketch").mapInPandas(sift, "a_id long, b_id long"))
    both = close.join(side("a", "class", "features"), "a_id").join(side("b", "class", "features"), "b_id")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            (va, na), (vb, nb) = _flat(batch["a_features"]), _flat(batch["b_features"])
            alive = np.ones(len(batch), dtype=bool)
            for seed in SEEDS[:2]:
                (ha, oa), (hb, ob) = (_prefixes(v, n, n - _need(n, threshold) + 1, seed) for v, n in ((va, na), (vb, nb)))
                alive &= _common(ha, oa, hb, ob, len(batch)) > 0
            shared = _common(va, np.repeat(np.arange(len(na)), na), vb, np.repeat(np.arange(len(nb)), nb), len(batch))
            similarity = shared / (na + nb - shared)
            keep = alive & (similarity >= threshold - EPSILON)
            x, y = batch["a_class"][keep].tolist(), batch["b_class"][keep].tolist()
            yield pd.DataFrame({"a": [min(p) for p in zip(x, y, strict=True)], "b": [max(p) for p in zip(x, y, strict=True)], "similarity": similarity[keep]})

    return both.select("a_class", "a_features", "b_class", "b_features").mapInPandas(verify, "a string, b string, similarity double")


def _common(a: np.ndarray, of_a: np.ndarray, b: np.ndarray, of_b: np.ndarray, rows: int) -> np.ndarray:
    """Number of equal values of a and b by row; values are distinct within a row of a side."""
    values, owner = np.concatenate([a, b]), np.concatenate([of_a, of_b])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    twice = (values[1:] == values[:-1]) & (owner[1:] == owner[:-1])
    return np.bincount(owner[1:][twice], minlength=rows)


def near_pairs(df: DataFrame, key: str, text: str, run: int, threshold: float) -> DataFrame:
    """Rows (key_a, key_b), key_a < key_b, of all records at least ``threshold`` similar in runs of ``run`` words."""
    members = cut(classes(df, key, text, run))
    links = class_links(members, threshold)
    slim = cut(members.select("class", "key").distinct())
    copies = pairs_within(slim, "class", "key", F.col("a_key") < F.col("b_key")).select(F.col("a_key").alias("key_a"), F.col("b_key").alias("key_b"))
    a, b = slim.select(F.col("class").alias("a"), F.col("key").alias("x")), slim.select(F.col("class").alias("b"), F.col("key").alias("y"))
    across = links.select("a", "b").join(a, "a").join(b, "b").where("x <> y").select(F.least("x", "y").alias("key_a"), F.greatest("x", "y").alias("key_b"))
    return copies.unionByName(across).distinct()


def near_groups(df: DataFrame, key: str, text: str, run: int, threshold: float) -> DataFrame:
    """Rows (key, class, links, group): each record's class of equal sets, its class's links to other classes, and its connected group."""
    members = cut(classes(df, key, text, run))
    links = cut(class_links(members, threshold))
    degree = links.select(F.col("a").alias("class")).unionAll(links.select(F.col("b").alias("class"))).groupBy("class").agg(F.count(F.lit(1)).alias("links"))
    groups = connected_components(links.select("a", "b"))
    rows = members.select("key", "class").distinct().join(degree, "class", "left").join(groups.withColumnRenamed("node", "class"), "class", "left")
    return rows.select("key", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "class").alias("group"))
