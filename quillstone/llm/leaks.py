"""Evaluation passages inside training texts.

The space: words of the evaluation items, TF-IDF weighted with frequencies over all documents, reduced by a randomised
singular value decomposition. Passages are runs of ``2 * HALF`` words, a new one every ``HALF``, of the items
and of every document; any ``RUN`` <= HALF + 1 consecutive words lie whole in one passage on each side. The decomposition is fitted on all item
passages and those of at most ``FIT_DOCUMENTS`` documents; every passage of every document with words enough of the
vocabulary for a run or a paraphrase is projected and searched against all item passages by cosine, in blocks.

All candidates of at least ``COSINE`` are checked: for a run of consecutive shared words (exact), and without one for the
longest common subsequence, as a share of the item passage, and the share of the answer's words that stand in the document
there, as far around the passage as the answer is long. A paraphrase has a subsequence of at least ``ORDERED``, and the two shares add up to ``TOGETHER``.

The model is bounded by the stated query set: vocabulary x ``RANK`` numbers. Documents stream through Arrow batches
once for frequencies and once for the search; only hits are shuffled. Defined cases: null or empty texts and items
match nothing; texts shorter than a passage are one short passage; repeated items and documents are reported by their keys, rows are distinct; very long texts are many
passages; an empty table on either side gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.session import cut

HALF, RUN, RANK, OVERSAMPLE, COSINE = 12, 12, 96, 16, 0.3
ORDERED, TOGETHER = 0.5, 1.0
FIT_DOCUMENTS, FIT_CHARS, PARTS, BLOCK, TABLE = 2_000, 50_000, 8, 2_048, 1 << 24
WORDS = re.compile(r"[^\W_]+")
BASE = np.uint64(0x9E3779B97F4A7C15)


def words(text: str | None) -> list[str]:
    return WORDS.findall(text.lower()) if isinstance(text, str) else []


@dataclass
class Items:
    """Passages of the stated query set as word numbers; -1 pads."""

    keys: list
    vocabulary: dict[str, int]
    passages: np.ndarray  # passages x 2 HALF
    owner: np.ndarray  # position in keys of each passage
    runs: np.ndarray  # hashes of the RUN-word runs of each passage, 0 pads
    answers: list[frozenset]
    lengths: list[int]  # words of each answer

    @classmethod
    def of(cls, rows: list[tuple[object, str | None, str | None]]) -> Items:
        vocabulary: dict[str, int] = {}
        keys, passages, owner, answers, lengths = [], [], [], [], []
        for key, *texts in rows:
            for text in texts:
                ids = [vocabulary.setdefault(w, len(vocabulary)) for w in words(text)]
                for a in range(0, max(1, len(ids) - HALF), HALF):
                    if ids[a : a + 2 * HALF]:
                        passages.append((ids[a : a + 2 * HALF] + [-1] * 2 * HALF)[: 2 * HALF])
                        owner.append(len(keys))
            answers.append(frozenset(vocabulary[w] for w in words(texts[-1])))
            lengths.append(len(words(texts[-1])))
            keys.append(key)
        table = np.array(passages, dtype=np.int32).reshape(-1, 2 * HALF)
        return cls(keys, vocabulary, table, np.array(owner, dtype=np.int32), _passage_runs(table), answers, lengths)


def run_hashes(ids: np.ndarray) -> np.ndarray:
    """Hash of the RUN words that start at each position, 0 where they are not all in the vocabulary."""
    n = len(ids)
    out = np.zeros(n, dtype=np.uint64)
    if n < RUN:
        return out
    with np.errstate(over="ignore"):
        value = np.zeros(n - RUN + 1, dtype=np.uint64)
        for k in range(RUN):
            value = value * BASE + (ids[k : n - RUN + 1 + k].astype(np.int64) + 2).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        value ^= value >> np.uint64(31)
    bad = np.concatenate([[0], np.cumsum(ids < 0)])
    out[: n - RUN + 1] = np.where(bad[RUN:] - bad[: n - RUN + 1] == 0, value | np.uint64(1), np.uint64(0))
    return out


def _passage_runs(table: np.ndarray) -> np.ndarray:
    padded = np.concatenate([table, np.full((len(table), RUN), -1, dtype=table.dtype)], axis=1)
    return run_hashes(padded.reshape(-1)).reshape(padded.shape)[:, : 2 * HALF - RUN + 1]


def batch_ids(texts: list, vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """Word numbers of all texts in one array, a text ending in at least 2 HALF times -1, and where each begins."""
    get, out, starts, at = vocabulary.get, [], [], 0
    gap = np.full(2 * HALF, -1, dtype=np.int32)
    for text in texts:
        found = words(text)
        ids = np.fromiter((get(w, -1) for w in found), dtype=np.int32, count=len(found))
        # Passages begin at multiples of HALF in the array, so each text is padded to one.
        pad = gap[: HALF - len(ids) % HALF] if len(ids) % HALF else gap[:0]
        starts.append(at)
        out += [ids, pad, gap]
        at += len(ids) + len(pad) + len(gap)
    return (np.concatenate(out) if out else gap[:0]), np.array(starts, dtype=np.int64)


def eligible(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the passages with RUN consecutive words of the vocabulary, and the hashes of all runs."""
    runs = run_hashes(ids)
    if len(ids) < 2 * HALF:
        return np.zeros(0, dtype=np.int64), runs
    found = (runs != 0).reshape(-1, HALF) if len(runs) % HALF == 0 else np.pad(runs != 0, (0, -len(runs) % HALF)).reshape(-1, HALF)
    begins = np.flatnonzero(found.any(axis=1))
    # A run that starts at the last place of one block still lies in that block's passage; none starts later.
    return begins[begins * HALF + 2 * HALF <= len(ids)] * HALF, runs


def holding(ids: np.ndarray, least: int) -> np.ndarray:
    """Starts of the passages with at least ``least`` words of the vocabulary."""
    halves = (ids >= 0).reshape(-1, HALF).sum(axis=1)
    return np.flatnonzero((halves[:-1] > 0) & (halves[:-1] + halves[1:] >= least)) * HALF


def project(ids: np.ndarray, starts: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Unit vectors of the passages in the latent space; ``axes`` has a last row of zeros for -1."""
    halves = np.unique(np.concatenate([starts, starts + HALF]))
    sums = np.zeros((len(halves), axes.shape[1]), dtype=np.float32)
    for k in range(HALF):
        sums += axes[ids[halves + k]]
    vectors = sums[np.searchsorted(halves, starts)] + sums[np.searchsorted(halves, starts + HALF)]
    return vectors / np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)


def document_frequencies(documents: DataFrame, text: str, vocabulary: dict[str, int]) -> tuple[np.ndarray, int]:
    """Documents that hold each word of the vocabulary, and the number of documents: over all rows."""
    size = len(vocabulary)
    shared = documents.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, total, rows = shared.value.get, np.zeros(size, dtype=np.int64), 0
        for batch in batches:
            for t in batch["t"]:
                ids = {get(w, -1) for w in set(words(t))}
                ids.discard(-1)
                total[list(ids)] += 1
                rows += 1
        at = np.flatnonzero(total)
        yield pd.DataFrame({"word": np.append(at, -1).astype("int32"), "n": np.append(total[at], rows)})

    rows = documents.select(F.col(f"`{text}`").alias("t")).mapInPandas(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    out, total = np.zeros(size), 0
    for word, n in rows:  # as many rows as the vocabulary has words
        if word < 0:
            total = n
        else:
            out[word] = n
    return out, total


def fit_axes(documents: DataFrame, key: str, text: str, items: Items, idf: np.ndarray) -> np.ndarray:
    """Randomised SVD: words x RANK right singular vectors, times the words' weights."""
    spark, size, width = documents.sparkSession, len(items.vocabulary), RANK + OVERSAMPLE
    rank = min(RANK, size)
    width = min(width, size)
    vocabulary = spark.sparkContext.broadcast(items.vocabulary)

    def passages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, _ = batch_ids(batch["t"].tolist(), vocabulary.value)
            starts, _ = eligible(ids)
            if len(starts):
                yield pd.DataFrame({"part": (np.arange(len(starts)) % PARTS).astype("int32"), "ids": [ids[s : s + 2 * HALF].tolist() for s in starts]})

    sample = documents.where(F.length(F.col(f"`{text}`")) <= FIT_CHARS).select(F.col(f"`{text}`").alias("t"), F.xxhash64(F.col(f"`{key}`").cast("string")).alias("h")).orderBy("h").limit(FIT_DOCUMENTS)
    fitted = sample.repartition(PARTS).mapInPandas(passages, "part int, ids array<int>")
    mine = spark.createDataFrame([(i % PARTS, row) for i, row in enumerate(items.passages.tolist())], "part int, ids array<int>")
    fitted = cut(fitted.unionByName(mine))

    def times(basis: np.ndarray) -> np.ndarray:
        """A'A basis, summed over the parts; A has a row for each passage, of unit length."""
        shared = spark.sparkContext.broadcast(basis)

        def part(rows: pd.DataFrame) -> pd.DataFrame:
            ids = np.array(rows["ids"].tolist(), dtype=np.int64)
            weight = np.append(idf, 0.0)[ids]
            weight /= np.maximum(np.sqrt((weight**2).sum(axis=1, keepdims=True)), 1e-9)
            extended = np.vstack([shared.value, np.zeros((1, shared.value.shape[1]))])
            out = np.zeros_like(extended)
            for a in range(0, len(ids), 2048):
                some, w = ids[a : a + 2048], weight[a : a + 2048]
                y = np.zeros((len(some), extended.shape[1]))
                for k in range(some.shape[1]):
                    y += w[:, k : k + 1] * extended[some[:, k]]
                order = np.argsort(some, axis=None, kind="stable")
                flat = some.reshape(-1)[order]
                first = np.flatnonzero(np.append(True, flat[1:] != flat[:-1]))
                out[flat[first]] += np.add.reduceat(w.reshape(-1)[order][:, None] * y[order // some.shape[1]], first, axis=0)
            return pd.DataFrame({"word": np.arange(len(out) - 1).astype("int32"), "row": list(out[:-1])})

        rows = fitted.groupBy("part").applyInPandas(part, "word int, row array<double>").collect()  # PARTS x vocabulary rows
        out = np.zeros_like(basis)
        for word, row in rows:
            out[word] += row
        return out

    basis = np.linalg.qr(times(np.random.default_rng(7).standard_normal((size, width))))[0]
    basis = np.linalg.qr(times(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ times(basis))
    axes = basis @ turn[:, np.argsort(-values)[:rank]]
    return np.vstack([axes * idf[:, None], np.zeros((1, rank))]).astype(np.float32)


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, bit-parallel."""
    places: dict[int, int] = {}
    for i, x in enumerate(a):
        if x >= 0:
            places[x] = places.get(x, 0) | 1 << i
    row = 0
    for y in b:
        grown = row | places.get(y, 0)
        row = grown & ~(grown - (row << 1 | 1))
    return row.bit_count()


class Subsequences:
    """Longest common subsequences of many pairs of an item passage and a document passage, where they reach ``ORDERED``."""

    def __init__(self, passages: np.ndarray, size: int) -> None:
        self.passages, self.stride, self.table = passages, size + 1, None
        self.lengths = (passages >= 0).sum(axis=1)
        self.need = np.ceil(ORDERED * self.lengths - 1e-9).astype(np.int64)
        if len(passages) * self.stride <= TABLE:  # places of each word in each passage; a larger query set is compared word by word
            table = np.zeros((len(passages), self.stride), dtype=np.uint32)
            for k in range(2 * HALF):
                table[np.arange(len(passages)), passages[:, k]] |= np.uint32(1 << k)
            table[:, -1] = 0
            self.table = table.reshape(-1)

    def _places(self, q: np.ndarray, word: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table.take(q * self.stride + np.where(word < 0, self.stride - 1, word))
        out = np.zeros(len(q), dtype=np.uint32)
        for k in range(2 * HALF):
            out |= ((self.passages[q, k] == word) & (word >= 0)).astype(np.uint32) << np.uint32(k)
        return out

    def of(self, ids: np.ndarray, starts: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the pairs that reach ``ORDERED``, and their shares."""
        at, share = [], []
        for a in range(0, len(q), 1 << 15):
            mine = np.arange(a, min(len(q), a + (1 << 15)))
            row = np.zeros(len(mine), dtype=np.uint32)
            s, p = starts[mine], q[mine]
            for k in range(2 * HALF):
                grown = row | self._places(p, ids.take(s + k))
                row = grown & ~(grown - (row << np.uint32(1) | np.uint32(1)))
                if k % 4 == 3 and k >= HALF:  # what can't reach it with all words still to come is left
                    on = np.bitwise_count(row) + (2 * HALF - 1 - k) >= self.need[p]
                    mine, row, s, p = mine[on], row[on], s[on], p[on]
            at.append(mine), share.append(np.bitwise_count(row) / np.maximum(1, self.lengths[p]))
        return (np.concatenate(at), np.concatenate(share)) if at else (np.zeros(0, dtype=np.int64), np.zeros(0))


def find_leaks(documents: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_texts: tuple[str, str]) -> DataFrame:
    """Rows (doc, item, cosine, run, subsequence, answer): run says whether RUN consecutive words are shared.

    For hits with a run the other two columns are null; the others are paraphrases. A document and item have one row, with a run if there is any, else of the passage with the largest shares.
    """
    rows = items.select(F.col(f"`{item_key}`"), *[F.col(f"`{c}`") for c in item_texts]).distinct().collect()  # the stated query set
    stated = Items.of([tuple(r) for r in rows])
    key_type, item_type = documents.schema[key].dataType.simpleString(), items.schema[item_key].dataType.simpleString()
    schema = f"doc string, item {item_type}, cosine double, run boolean, subsequence double, answer double"
    if not len(stated.passages):
        return documents.sparkSession.createDataFrame([], schema).withColumn("doc", F.col("doc").cast(key_type))
    df, total = document_frequencies(documents, text, stated.vocabulary)
    idf = np.log((total + 1.0) / (df + 0.5)).clip(0.05)
    axes = fit_axes(documents, key, text, stated, idf)
    flat = stated.passages.reshape(-1)
    vectors = project(flat, np.arange(0, len(flat), 2 * HALF), axes)
    shared = documents.sparkSession.sparkContext.broadcast((stated, axes, vectors))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stated, axes, vectors = shared.value
        subsequences = Subsequences(stated.passages, len(stated.vocabulary))
        least = max(1, int(subsequences.need.min()))
        for batch in batches:
            ids, begins = batch_ids(batch["t"].tolist(), stated.vocabulary)
            if not len(ids):
                continue
            starts, runs = holding(ids, least), run_hashes(ids)
            ends = np.append(begins[1:], len(ids))
            hits = []
            for a in range(0, len(starts), BLOCK):
                some = starts[a : a + BLOCK]
                cosine = (project(ids, some, axes) @ vectors.T).reshape(-1)
                flat = np.flatnonzero(cosine >= COSINE)
                w, q = np.divmod(flat, len(vectors))
                value = cosine[flat]
                verbatim = np.zeros(len(w), dtype=bool)
                may = np.flatnonzero((runs[some[:, None] + np.arange(HALF + 1)] != 0).any(axis=1)[w])
                for b in range(0, len(may), 200_000):
                    at = may[b : b + 200_000]
                    left, right = runs[some[w[at], None] + np.arange(HALF + 1)], stated.runs[q[at]]
                    for k in range(right.shape[1]):
                        verbatim[at] |= ((left == right[:, k : k + 1]) & (left != 0)).any(axis=1)
                rest = np.flatnonzero(~verbatim)
                at, share = subsequences.of(ids, some[w[rest]], q[rest])
                at, exact = rest[at], np.flatnonzero(verbatim)
                docs = np.searchsorted(begins, some, side="right") - 1
                answer = np.zeros(len(at))
                for i, (start, owner, doc) in enumerate(zip(some[w[at]].tolist(), stated.owner[q[at]].tolist(), docs[w[at]].tolist(), strict=True)):
                    around, words_of = stated.lengths[owner], stated.answers[owner]
                    near = ids[max(begins[doc], start - around) : min(ends[doc], start + 2 * HALF + around)]
                    answer[i] = len(words_of.intersection(near.tolist())) / max(1, len(words_of))
                kept = share + answer >= TOGETHER
                both = np.concatenate([exact, at[kept]])
                nothing = np.full(len(exact), np.nan)
                hits.append(pd.DataFrame({"at": docs[w[both]], "owner": stated.owner[q[both]], "cosine": value[both].astype("float64"), "run": verbatim[both], "subsequence": np.append(nothing, share[kept]), "answer": np.append(nothing, answer[kept])}))
            if not sum(map(len, hits)):
                continue  # an empty frame has no types to send
            found = pd.concat([h for h in hits if len(h)])
            found["shares"] = found["subsequence"] + found["answer"]
            found = found.sort_values(["at", "owner", "run", "shares", "cosine"], kind="stable").drop_duplicates(["at", "owner"], keep="last")
            shares = {c: [None if np.isnan(x) else x for x in found[c].tolist()] for c in ("subsequence", "answer")}
            yield pd.DataFrame({"doc": batch["k"].iloc[found["at"]].tolist(), "item": [stated.keys[i] for i in found["owner"]], "cosine": found["cosine"].tolist(), "run": found["run"].tolist(), **{c: pd.Series(x, dtype=object) for c, x in shares.items()}})

    found = documents.select(F.col(f"`{key}`").cast("string").alias("k"), F.col(f"`{text}`").alias("t")).mapInPandas(search, schema)
    return found.withColumn("doc", F.col("doc").cast(key_type))
