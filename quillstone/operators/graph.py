"""Knowledge graph, command network and provenance graph as node and edge tables."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators.components import joined
from quillstone.operators.ranking import first_by, last_by
from quillstone.session import cut

#: Edges up to which the exact centrality ships the adjacency to every task.
BROADCAST_EDGES = 2_000_000
#: Sources that are searched from at once (bits of a number), and levels up to which that is done for whole levels (two depths make one byte).
SOURCES, LEVELS = 64, 60
#: Sources go together while they use each edge so many times at most, and their path counts take so many bytes; a run of rows is added up so many rows at a time, for so many runs.
SHARED, BYTES, RUN, RUNS = 3, 200_000_000, 16, 256


def name_lookup(registry: DataFrame) -> DataFrame:
    """Rows (name, id, shown, type): every spelling, lower case, with the first registry row that has it."""
    names = registry.select("canonical_id", "canonical_text", "label", "occurrences", F.explode(F.array_union(F.array("canonical_text"), "aliases")).alias("n"))
    rows = names.select(F.lower("n").alias("name"), F.col("canonical_id").alias("id"), F.col("canonical_text").alias("shown"), F.col("label").alias("type"), (-F.col("occurrences")).alias("rank"))
    return first_by(rows, ["name"], ["rank", "id"]).drop("rank")


def resolved(df: DataFrame, column: str, lookup: DataFrame, prefix: str) -> DataFrame:
    """``df`` with {prefix}_id, _label and _type of the names in ``column``; names without an entry get an id of their own."""
    names = lookup.select(F.col("name").alias(f"{prefix}_key"), *[F.col(a).alias(f"{prefix}_found_{a}") for a in ("id", "shown", "type")])
    rows = df.join(names, F.lower(F.col(column)) == F.col(f"{prefix}_key"), "left")
    return rows.withColumns({
        f"{prefix}_id": F.coalesce(f"{prefix}_found_id", X.unresolved_id(F.col(column))), f"{prefix}_label": F.coalesce(f"{prefix}_found_shown", F.col(column)), f"{prefix}_type": F.coalesce(f"{prefix}_found_type", F.lit("UNKNOWN")),
    }).drop(f"{prefix}_key", f"{prefix}_found_id", f"{prefix}_found_shown", f"{prefix}_found_type")


def edges(triples: DataFrame, registry: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """Parallel edges of all triples that are sure enough; open-ended validity from the triple's date."""
    lookup = name_lookup(registry)
    rows = triples.where((F.col("confidence") >= min_confidence) & F.col("subject").isNotNull() & F.col("object").isNotNull())
    rows = resolved(resolved(rows, "subject", lookup, "source"), "object", lookup, "target")
    return rows.select("ord", "source_id", "source_label", "source_type", "target_id", "target_label", "target_type", "predicate", "confidence", "evidence", "source_chunk_id", "location", F.col("date").alias("valid_from"), F.lit(None).cast("string").alias("valid_to"), X.is_command(F.col("predicate")).alias("is_command"))


def nodes(registry: DataFrame, edges_: DataFrame) -> DataFrame:
    """Rows (id, label, type, aliases): registry entities, and the unresolved ends of edges."""
    known = registry.select(F.col("canonical_id").alias("id"), F.col("canonical_text").alias("label"), F.col("label").alias("type"), "aliases")
    ends = edges_.select("ord", F.inline(F.array(*[F.struct(F.col(f"{side}_id").alias("id"), F.col(f"{side}_label").alias("label"), F.col(f"{side}_type").alias("type")) for side in ("source", "target")])))
    loose = ends.where("type = 'UNKNOWN'").groupBy("id").agg(F.min_by("label", F.struct("ord", "label")).alias("label")).select("id", "label", F.lit("UNKNOWN").alias("type"), F.array().cast("array<string>").alias("aliases"))
    return known.unionByName(loose.join(known.select("id"), "id", "left_anti"))


def collapsed(edges_: DataFrame) -> DataFrame:
    """One edge for each pair of ends: the last."""
    return last_by(edges_, ["source_id", "target_id"], ["ord"])


def ball(edges_: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """Ids within ``hops`` undirected steps of the seeds."""
    both = edges_.select(F.col("source_id").alias("u"), F.col("target_id").alias("v")).unionByName(edges_.select(F.col("target_id").alias("u"), F.col("source_id").alias("v"))).distinct()
    reached = seeds.select("id").distinct()
    for _ in range(hops):
        reached = reached.unionByName(both.join(reached, F.col("u") == F.col("id"), "left_semi").select(F.col("v").alias("id"))).distinct()
    return reached


def seeds(nodes_: DataFrame, question: str) -> DataFrame:
    """Nodes whose label or one of whose aliases stands in the question."""
    asked = F.lit(question.lower())
    return nodes_.where(F.contains(asked, F.lower("label")) | F.exists("aliases", lambda a: F.contains(asked, F.lower(a))))


def context(edges_: DataFrame, nodes_: DataFrame, question: str, hops: int = 2, at: str | None = None) -> DataFrame:
    """Out-edges, one for each pair of ends, of the ball around the question's nodes that hold at a date."""
    links = cut(collapsed(edges_))
    near = ball(links, seeds(nodes_, question), hops)
    rows = links.join(near, F.col("source_id") == F.col("id"), "left_semi")
    return rows.where(X.valid_at(F.col("valid_from"), F.col("valid_to"), at)).select("ord", "source_label", "predicate", "target_label", "valid_from", F.substr("evidence", F.lit(1), F.lit(120)).alias("evidence"))


def prose(edges_: DataFrame, nodes_: DataFrame, ids: DataFrame, at: str | None = None) -> DataFrame:
    """Rows (id, part, ord, line): what a model reads about each of ``ids``: the node, its aliases, its relations that hold at a date, their evidence.

    A line is a row, so a node with many relations is no large value; sorted by (id, ord, part) the lines are the text.
    """
    mine = nodes_.join(ids.select("id").distinct(), "id", "left_semi")
    first = F.lit(-1).cast("string")
    head = mine.select("id", F.lit(0).alias("part"), first.alias("ord"), F.concat(F.lit("["), "type", F.lit("] "), "label").alias("line"))
    known = mine.where(F.size("aliases") > 0).select("id", F.lit(1).alias("part"), first.alias("ord"), F.concat(F.lit("  Also known as: "), F.array_join(F.slice("aliases", 1, 5), ", ")).alias("line"))
    rows = edges_.where(X.valid_at(F.col("valid_from"), F.col("valid_to"), at)).join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    since = F.when(F.col("valid_from") != "", F.concat(F.lit("valid from "), "valid_from"))
    meta = F.concat_ws(" | ", F.nullif("valid_from", F.lit("")), F.nullif("location", F.lit("")), since)
    order = F.lpad(F.col("ord").cast("string"), 20, "0")
    told = rows.select(F.col("source_id").alias("id"), F.lit(2).alias("part"), order.alias("ord"), F.concat(F.lit("  → "), F.coalesce("predicate", F.lit("?")), F.lit(" → "), "target_label", F.when(meta != "", F.concat(F.lit(" ("), meta, F.lit(")"))).otherwise(""), F.lit(" [conf="), F.format_string("%.2f", F.round(F.coalesce("confidence", F.lit(0.0)) * 100) / 100), F.lit("]")).alias("line"))
    shown = rows.where("evidence <> ''").select(F.col("source_id").alias("id"), F.lit(3).alias("part"), order.alias("ord"), F.concat(F.lit('    Evidence: "'), F.substr("evidence", F.lit(1), F.lit(120)), F.lit('"')).alias("line"))
    return head.unionByName(known).unionByName(told).unionByName(shown)


def degrees(edges_: DataFrame) -> DataFrame:
    """In- and out-degree on collapsed edges."""
    pairs = edges_.select("source_id", "target_id").distinct()
    ends = pairs.select(F.col("source_id").alias("id"), F.lit(1).alias("o"), F.lit(0).alias("i")).unionByName(pairs.select(F.col("target_id").alias("id"), F.lit(0).alias("o"), F.lit(1).alias("i")))
    return ends.groupBy("id").agg(F.sum("i").alias("in_degree"), F.sum("o").alias("out_degree"))


def _undirected(edges_: DataFrame) -> DataFrame:
    return edges_.select(F.least("source_id", "target_id").alias("a"), F.greatest("source_id", "target_id").alias("b")).where("a <> b").distinct()


def betweenness(edges_: DataFrame, digits: int = 6) -> DataFrame:
    """Rows (id, betweenness), exact, on the undirected simple graph, normalised for unordered pairs.

    Up to ``BROADCAST_EDGES`` edges every task gets the edges and runs its share of the sources; only sums per node
    are shuffled. Hanging trees are counted without a search. Beyond that, breadth-first levels are joins over blocks of sources.
    """
    links = cut(_undirected(edges_))
    ids = links.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    n = ids.count()
    scale = 1.0 / ((n - 1) * (n - 2)) if n > 2 else 0.0
    total = _dependencies(links) if links.count() <= BROADCAST_EDGES else _dependencies_by_joins(links, ids)
    return ids.join(total, "id", "left").select("id", F.round(F.coalesce("d", F.lit(0.0)) * scale, digits).alias("betweenness"))


def _dependencies(links: DataFrame) -> DataFrame:
    table = links.toArrow()  # at most BROADCAST_EDGES rows
    coded = pa.chunked_array([*table["a"].chunks, *table["b"].chunks], pa.string()).combine_chunks().dictionary_encode()
    names, ends = coded.dictionary, coded.indices.to_numpy().astype(np.int64).reshape(2, -1)
    plan = _plan(len(names), *ends)
    sc = links.sparkSession.sparkContext
    shared = sc.broadcast((names, plan))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names, plan = shared.value
        total = np.zeros(len(names))
        for batch in batches:
            for k in batch["id"]:
                plan.add(k, total)
        at = np.flatnonzero(total)
        if len(at):
            yield pd.DataFrame({"id": names.take(pa.array(at)).to_pandas(), "d": total[at]})

    tasks = max(1, min(4 * sc.defaultParallelism, plan.blocks))
    return links.sparkSession.range(0, plan.blocks, 1, tasks).mapInPandas(run, "id string, d double").groupBy("id").agg(F.sum("d").alias("d"))


def _plan(n: int, a: np.ndarray, b: np.ndarray) -> _Plan:
    """Folds the trees that hang on the rest of the graph: a folded node has one way out, so pairs through it are a product of sizes.

    What remains is worked off by connected groups, in blocks of sources. Sources and targets count as often as nodes are folded into them.
    """
    degree, other = np.bincount(np.r_[a, b], minlength=n), np.zeros(n, np.int64)
    np.bitwise_xor.at(other, a, b)
    np.bitwise_xor.at(other, b, a)
    waiting = np.flatnonzero(degree == 1).tolist()
    left, way, size, squares = degree.tolist(), other.tolist(), [1] * n, [0] * n
    while waiting:
        x = waiting.pop()
        if left[x] != 1:
            continue
        y = way[x]
        left[x], left[y], way[y] = 0, left[y] - 1, way[y] ^ x
        size[y] += size[x]
        squares[y] += size[x] * size[x]
        if left[y] == 1:
            waiting.append(y)
    weight, hung = np.array(size, np.float64), np.array(size, np.float64) - 1
    root = joined(np.arange(n), a, b)
    whole = np.bincount(root, minlength=n)[root]
    trees = hung * hung - np.array(squares, np.float64) + 2 * hung * (whole - 1 - hung)
    core = np.array(left) > 0
    order = np.flatnonzero(core)
    order = order[np.argsort(root[order], kind="stable")]
    number = np.zeros(n, np.int64)
    number[order] = np.arange(len(order))
    kept = core[a] & core[b]
    u, v = number[a[kept]], number[b[kept]]
    if len(u):
        by = np.argsort(root[order[u]], kind="stable")
        u, v = u[by], v[by]
    starts = np.flatnonzero(np.diff(root[order], prepend=-1))
    ends, edges_ = np.r_[starts, len(order)], np.r_[np.searchsorted(root[order[u]], root[order[starts]]), len(u)]
    alike = np.arange(len(order))
    for g in np.flatnonzero(np.diff(ends) > SOURCES).tolist():
        low, e = ends[g], slice(edges_[g], edges_[g + 1])
        alike[low : ends[g + 1]] = low + _Group(weight[order[low : ends[g + 1]]], u[e] - low, v[e] - low).alike()
    order, number = order[alike], np.argsort(alike)
    return _Plan(trees, order, weight[order], number[u], number[v], ends, edges_)


class _Plan:
    """Nodes ``order`` and edges (``u``, ``v``) without trees, sorted by connected group; ``starts`` and ``edges`` are where the groups begin."""

    def __init__(self, trees, order, weight, u, v, starts, edges) -> None:
        self.trees, self.order, self.weight, self.u, self.v, self.starts, self.edges = trees, order.astype(np.int32), weight, u.astype(np.int32), v.astype(np.int32), starts, edges
        sizes = np.diff(starts)
        self.first = np.r_[0, np.cumsum(-(-sizes // SOURCES))]
        self.blocks = max(1, int(self.first[-1]))
        # Neighbouring blocks go to different tasks, so that every task has a share of each group.
        self.turn = np.random.default_rng(0).permutation(self.blocks).astype(np.int32)
        self.group: tuple[int, _Group] | None = None

    def add(self, k: int, total: np.ndarray) -> None:
        """Adds to ``total`` what the sources of one block give; the first block also has the pairs of the trees."""
        k = int(self.turn[k])
        if k == 0:
            total += self.trees
        if not len(self.order):
            return
        g = int(np.searchsorted(self.first, k, "right")) - 1
        low, high = int(self.starts[g]), int(self.starts[g + 1])
        if self.group is None or self.group[0] != g:
            e = slice(int(self.edges[g]), int(self.edges[g + 1]))
            self.group = g, _Group(self.weight[low:high], self.u[e].astype(np.int64) - low, self.v[e].astype(np.int64) - low)
        at = (k - int(self.first[g])) * SOURCES
        total[self.order[low:high]] += self.group[1].dependencies(np.arange(at, min(at + SOURCES, high - low)))


class _Group:
    """A connected graph without leaves."""

    def __init__(self, weight: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
        self.n, self.weight, self.u, self.v = len(weight), weight, u, v
        both = np.r_[u, v]
        by = np.argsort(both, kind="stable")
        self.beside = np.r_[v, u][by]
        self.ptr = np.searchsorted(both[by], np.arange(self.n))
        self.degree = np.diff(np.r_[self.ptr, len(both)])
        self.room = np.empty(0)
        self.adjacent: list[list[int]] | None = None

    def alike(self) -> np.ndarray:
        """The nodes, those side by side that are as far from the nodes of most edges: their shortest paths are much the same."""
        depth = self._depth(np.argsort(-self.degree, kind="stable")[:SOURCES])
        return np.arange(self.n) if depth is None else np.lexsort(depth[::-1])

    def dependencies(self, sources: np.ndarray) -> np.ndarray:
        levels = self._levels(sources)
        if levels is not None and 8 * len(sources) * sum(len(at) for at, *_ in levels) <= BYTES:
            return self._together(sources, levels)
        if levels is not None and len(sources) > 1:
            del levels
            half = len(sources) // 2
            return self.dependencies(sources[:half]) + self.dependencies(sources[half:])
        out, depth = np.zeros(self.n), self._depth(sources)
        for j, s in enumerate(sources.tolist()):
            out += self.weight[s] * (self._long(s) if depth is None else self._flat(s, depth[j]))
        return out

    def _levels(self, sources: np.ndarray) -> list[tuple] | None:
        """By depth: the nodes that are so far from any of at most 64 sources, the bits of those sources, and (row, node beside) of the edges that some source uses to the level above and below.

        None where the graph is longer than LEVELS, or the sources have too little in common.
        """
        front = np.zeros(self.n, np.uint64)
        front[sources] = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
        seen, before, levels, left = front.copy(), np.zeros(self.n, np.uint64), [], SHARED * len(self.u)
        while len(at := np.flatnonzero(front)):
            bits, count = front[at], self.degree[at]
            row = np.repeat(np.arange(len(at), dtype=np.int32), count)
            beside = self.beside.take(np.repeat(self.ptr[at] - np.cumsum(count) + count, count) + np.arange(len(row)))
            mine = bits.take(row)
            after = np.bitwise_or.reduceat(front.take(self.beside), self.ptr) & ~seen
            up, down = (np.flatnonzero((x.take(beside) & mine) != 0) for x in (before, after))
            levels.append((at, bits, (row[up], beside[up]), (row[down], beside[down])))
            left -= len(down)
            if left < 0 or len(levels) > LEVELS + 1:
                return None
            seen |= after
            before, front = front, after
        return levels

    def _together(self, sources: np.ndarray, levels: list[tuple]) -> np.ndarray:
        """What the shortest paths from all sources add to every other node, each source by its weight; a row holds a node, a column a source.

        With d what a source adds to a node of c paths, (weight + d) / c is the node's own weight / c and the sum of the same over the nodes below.
        """
        lows = np.cumsum([0, *(len(at) for at, *_ in levels)]).tolist()
        if len(self.room) < lows[-1] * len(sources):
            self.room = np.empty(lows[-1] * len(sources) * 9 // 8)
        table = self.room[: lows[-1] * len(sources)].reshape(-1, len(sources))  # counts of paths, then what (weight + d) / c is
        rows = [table[low:high] for low, high in pairwise(lows)]
        place, share = np.zeros(self.n, np.int32), self.weight[sources]
        marks = lambda bits: np.unpackbits(bits.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little", count=len(sources)).view(bool)
        rows[0][:] = marks(levels[0][1])
        for k, (at, bits, (row, beside), _) in enumerate(levels[1:], 1):
            place[levels[k - 1][0]] = np.arange(lows[k - 1], lows[k])
            for r, total in _run_sums(table, place[beside], *_runs(row)):
                total *= marks(bits[r])
                rows[k][r] = total
        out = np.zeros(self.n)
        with np.errstate(divide="ignore", invalid="ignore"):
            for k in range(len(levels) - 1, 0, -1):
                at, _, _, (row, beside) = levels[k]
                weight, last = self.weight[at][:, None], np.ones(len(at), bool)
                last[row] = False
                ends = np.flatnonzero(last)
                for r in (ends[i : i + RUNS] for i in range(0, len(ends), RUNS)):
                    count = rows[k].take(r, 0)
                    total = weight[r] / count
                    np.copyto(total, 0.0, where=count == 0)
                    rows[k][r] = total
                starts, lengths = _runs(row)
                for run, total in _run_sums(table, place[beside], starts, lengths):
                    r = row[starts[run]]
                    count = rows[k].take(r, 0)
                    out[at[r]] += np.einsum("ij,ij,j->i", total, count, share)
                    total += weight[r] / count
                    np.copyto(total, 0.0, where=count == 0)
                    rows[k][r] = total
                place[at] = np.arange(lows[k], lows[k + 1])
        return out

    def _depth(self, sources: np.ndarray) -> np.ndarray | None:
        """The depth of each node from each of at most 64 sources, which are the bits of a number; none where the graph is longer than LEVELS."""
        seen = np.zeros(self.n, np.uint64)
        seen[sources] = np.uint64(1) << np.arange(len(sources), dtype=np.uint64)
        depth, front = np.zeros((self.n, SOURCES), np.int8), seen.copy()
        for k in range(1, LEVELS + 2):
            front = np.bitwise_or.reduceat(front[self.beside], self.ptr) & ~seen
            if not front.any():
                return np.ascontiguousarray(depth.T)
            seen |= front
            depth += np.unpackbits(front.view(np.uint8).reshape(self.n, -1), axis=1, bitorder="little").view(np.int8) * np.int8(k)
        return None

    def _flat(self, s: int, depth: np.ndarray) -> np.ndarray:
        """What the shortest paths from ``s`` add to every other node, level by level over the edges between levels."""
        at_u = depth.take(self.u)
        both = at_u + depth.take(self.v)
        parts = []
        for k in range(int(depth.max())):
            on = np.flatnonzero(both == 2 * k + 1)
            u, v = self.u.take(on), self.v.take(on)
            low = np.where(at_u.take(on) == k, u, v)
            parts.append((low, u + v - low))
        paths = np.zeros(self.n)
        paths[s] = 1.0
        for x, y in parts:
            paths += np.bincount(y, paths.take(x), self.n)
        out = np.zeros(self.n)
        for x, y in reversed(parts):
            out += paths * np.bincount(x, ((self.weight + out) / paths).take(y), self.n)
        out[s] = 0.0
        return out

    def _long(self, s: int) -> np.ndarray:
        """The same node by node, for graphs of many levels."""
        if self.adjacent is None:
            self.adjacent = [x.tolist() for x in np.split(self.beside, self.ptr[1:])]
        depth, paths, order, waiting = {s: 0}, {s: 1.0}, [], deque([s])
        while waiting:
            u = waiting.popleft()
            order.append(u)
            for v in self.adjacent[u]:
                if v not in depth:
                    depth[v], paths[v] = depth[u] + 1, 0.0
                    waiting.append(v)
                if depth[v] == depth[u] + 1:
                    paths[v] += paths[u]
        out = np.zeros(self.n)
        for v in reversed(order):
            for u in self.adjacent[v]:
                if depth[u] == depth[v] - 1:
                    out[u] += paths[u] / paths[v] * (self.weight[v] + out[v])
        out[s] = 0.0
        return out


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the runs of equal values begin, and their lengths."""
    starts = np.flatnonzero(np.diff(row, prepend=-1))
    return starts, np.diff(np.r_[starts, len(row)])


def _run_sums(rows: np.ndarray, index: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The sums of ``rows[index]`` over runs, as (numbers of runs, sums) in blocks; a block of sums is valid until the next.

    Runs of like lengths are added up beside each other; long ones in parts, then the parts.
    """
    far, near = np.flatnonzero(lengths > RUN), np.flatnonzero(lengths <= RUN)
    if len(far):
        parts = -(-lengths[far] // RUN)
        first, of = np.cumsum(parts) - parts, np.repeat(np.arange(len(far)), parts)
        part = np.arange(len(of)) - first[of]
        some = np.empty((len(of), rows.shape[1]))
        for k, total in _run_sums(rows, index, starts[far][of] + RUN * part, np.minimum(RUN, lengths[far][of] - RUN * part)):
            some[k] = total
        for k, total in _run_sums(some, np.arange(len(of)), first, parts):
            yield far[k], total
    near = near[np.argsort(-lengths[near].astype(np.int8), kind="stable")]
    totals, more = np.empty((2, RUNS, rows.shape[1]))
    for i in range(0, len(near), RUNS):
        k = near[i : i + RUNS]
        start, length, total = starts[k], lengths[k], totals[: len(k)]
        rows.take(index[start], 0, out=total, mode="clip")
        for j in range(1, int(length[0])):
            m = int(np.count_nonzero(length > j))
            total[:m] += rows.take(index[start[:m] + j], 0, out=more[:m], mode="clip")
        yield k, total


def _dependencies_by_joins(links: DataFrame, ids: DataFrame, block: int = 1000) -> DataFrame:
    """The same by joins: level by level forward for path counts, then back for dependencies, for blocks of sources."""
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    blocks = -(-ids.count() // block)
    total = None
    for k in range(blocks):
        level = ids.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == k).select(F.col("id").alias("s"), F.col("id").alias("v"), F.lit(1.0).alias("paths"), F.lit(0).alias("depth"))
        seen, levels = cut(level), [cut(level)]
        while True:
            ahead = levels[-1].join(both, F.col("v") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("paths").alias("paths"))
            ahead = cut(ahead.join(seen.select("s", "v"), ["s", "v"], "left_anti").withColumn("depth", F.lit(len(levels))))
            if ahead.isEmpty():
                break
            seen, levels = cut(seen.unionByName(ahead)), [*levels, ahead]
        after = levels[-1].select("s", "v", "paths", F.lit(0.0).alias("d"))
        parts = []
        for level in reversed(levels[:-1]):
            gain = after.select("s", F.col("v").alias("w"), ((1 + F.col("d")) / F.col("paths")).alias("g")).join(both, F.col("w") == F.col("a")).groupBy("s", F.col("b").alias("v")).agg(F.sum("g").alias("g"))
            after = cut(level.join(gain, ["s", "v"], "left").select("s", "v", "paths", (F.col("paths") * F.coalesce("g", F.lit(0.0))).alias("d")))
            parts.append(after.where("s <> v").groupBy(F.col("v").alias("id")).agg(F.sum("d").alias("d")))
        for part in parts:
            total = part if total is None else total.unionByName(part)
    if total is None:
        return ids.select("id", F.lit(0.0).alias("d")).limit(0)
    return total.groupBy("id").agg(F.sum("d").alias("d"))


def communities(edges_: DataFrame, rounds: int = 100) -> DataFrame:
    """Rows (id, community) by label propagation: each node takes the label most of its neighbours have, ties to the smallest.

    A node keeps its own vote, which stops bipartite graphs from swinging. Deterministic; labels are node ids. It ends when a round changes nothing;
    ``rounds`` without that is an error, never a partial result.
    """
    links = _undirected(edges_)
    both = cut(links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))))
    labels = cut(both.select(F.col("a").alias("id")).distinct().withColumn("community", F.col("id")))
    for _ in range(rounds):
        votes = both.join(labels, F.col("b") == F.col("id")).select(F.col("a").alias("id"), "community").unionByName(labels).groupBy("id", "community").agg(F.count(F.lit(1)).alias("n"))
        chosen = votes.groupBy("id").agg(F.min_by("community", F.struct((-F.col("n")).alias("n"), "community")).alias("community"))
        chosen = cut(chosen.join(labels.withColumnRenamed("community", "old"), "id"))
        same = chosen.where("community <> old").isEmpty()
        labels = chosen.drop("old")
        if same:
            return labels
    raise RuntimeError(f"no stable communities after {rounds} rounds")


def modularity(edges_: DataFrame, labels: DataFrame) -> float:
    links = _undirected(edges_)
    m = links.count()
    if not m:
        return 0.0
    a, b = labels.toDF("a", "ca"), labels.toDF("b", "cb")
    inside = links.join(a, "a").join(b, "b").where("ca = cb").count() / m
    degree = links.select(F.explode(F.array("a", "b")).alias("id")).join(labels, "id").groupBy("community").agg(F.count(F.lit(1)).alias("k"))
    return inside - (degree.agg(F.sum((F.col("k") / (2.0 * m)) ** 2)).first()[0] or 0.0)


def gexf(nodes_: DataFrame, edges_: DataFrame) -> DataFrame:
    """Lines (part, line) of a graph document: header, nodes, edges, footer."""
    node = nodes_.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), "id", F.lit('" label="'), X.xml_escape(F.substr("label", F.lit(1), F.lit(80))), F.lit('"/>')).alias("line"))
    edge = edges_.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), "source_id", F.lit('" target="'), "target_id", F.lit('" label="'), X.xml_escape(F.col("predicate")), F.lit('"/>')).alias("line"))
    spark = nodes_.sparkSession
    frame = spark.createDataFrame([(0, '<gexf version="1.3"><graph defaultedgetype="directed">'), (3, "</graph></gexf>")], "part int, line string")
    return frame.unionByName(node).unionByName(edge)


def provenance(candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, hits, first_seen) and edges (src, dst, type) of how documents were found."""
    node = lambda kind, label: F.concat(F.lit(f"{kind}::"), label)
    host: Column = X.domain(F.col("url"))
    kinds = [("entity", F.col("trigger_entity")), ("url", F.col("url")), ("domain", host), ("source", F.col("source"))]
    events = candidates.select("ord", F.inline(F.array(*[F.struct(F.lit(k).alias("type"), v.alias("label")) for k, v in kinds]))).where("label is not null")
    nodes_ = events.groupBy("type", "label").agg(F.count(F.lit(1)).alias("hits"), F.min("ord").alias("first_seen")).select(F.concat_ws("::", "type", "label").alias("id"), "type", "label", "hits", "first_seen")
    links = [("found", "entity", F.col("trigger_entity"), "url", F.col("url")), ("hosted", "url", F.col("url"), "domain", host), ("via", "source", F.col("source"), "url", F.col("url"))]
    edges_ = candidates.select(F.inline(F.array(*[F.struct(node(a, x).alias("src"), node(b, y).alias("dst"), F.lit(t).alias("type")) for t, a, x, b, y in links]))).where("src is not null and dst is not null").distinct()
    return nodes_, edges_


def search_log(found: DataFrame, discovered: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows (src_type, src, dst_type, dst, type) of everything a session records, repeats included.

    ``found`` (query, source, url): a query was run on a source and gave a document; ``discovered`` (url, entity): an entity was read in a document;
    ``asked`` (query, entity, url): a model's query, with the entity and the document that led to it.
    """
    edge = lambda a, x, b, y, t: F.struct(F.lit(a).alias("src_type"), F.col(x).alias("src"), F.lit(b).alias("dst_type"), F.col(y).alias("dst"), F.lit(t).alias("type"))
    rows = found.select(F.inline(F.array(edge("seed_query", "query", "source", "source", "queried"), edge("source", "source", "url", "url", "returned"), edge("seed_query", "query", "url", "url", "returned"))))
    rows = rows.unionByName(discovered.select(F.inline(F.array(edge("url", "url", "entity", "entity", "triggered_by")))))
    rows = rows.unionByName(asked.select(F.inline(F.array(edge("entity", "entity", "llm_query", "query", "triggered"), edge("url", "url", "llm_query", "query", "generated")))))
    return rows.where("src is not null and dst is not null")


def search_graph(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, type, label, hits) and distinct edges (src, dst, type) of a session's log; a hit is one end of one record."""
    ends = log.select(F.inline(F.array(F.struct(F.col("src_type").alias("type"), F.col("src").alias("label")), F.struct(F.col("dst_type").alias("type"), F.col("dst").alias("label")))))
    nodes_ = ends.groupBy("type", "label").agg(F.count(F.lit(1)).alias("hits")).select(F.concat_ws("::", "type", "label").alias("id"), "type", "label", "hits")
    return nodes_, log.select(F.concat_ws("::", "src_type", "src").alias("src"), F.concat_ws("::", "dst_type", "dst").alias("dst"), "type").distinct()
