import random
from collections import defaultdict, deque
from itertools import combinations

import numpy as np
from pyspark.sql import functions as F

from quillstone.operators import chunking, evidence, graph, ranking, store, vectors
from quillstone.operators.components import connected_components
from quillstone.operators.pairs import pairs_within


def test_components_against_union_find(spark):
    random.seed(1)
    for n, m in ((30, 20), (60, 80), (40, 39)):
        edges = [(random.randrange(n), random.randrange(n)) for _ in range(m)] if m != 39 else [(i, i + 1) for i in range(39)]
        parent = list(range(n))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        want = {x: min(y for y in range(n) if find(y) == find(x)) for a, b in edges if a != b for x in (a, b)}
        got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame([*edges, (None, 1)], "a int, b int")).collect()}
        assert got == want
    assert connected_components(spark.createDataFrame([], "a int, b int")).count() == 0


def test_blocked_pairs_are_complete_and_single(spark):
    rows = [(i, "hot" if i % 3 else "cold") for i in range(60)] + [(99, "one"), (98, None)]
    df = spark.createDataFrame(rows, "id int, k string")
    got = [(r["a_id"], r["b_id"]) for r in pairs_within(df, "k", "id", F.col("a_id") < F.col("b_id"), block=7).collect()]
    want = {p for k in ("hot", "cold") for p in combinations([i for i, x in rows if x == k], 2)}
    assert len(got) == len(want) and set(got) == want


def _edges(spark, pairs):
    rows = [(i, a, b) for i, (a, b) in enumerate(pairs)]
    return spark.createDataFrame(rows, "ord int, source_id string, target_id string").withColumn("predicate", F.lit("p"))


def _betweenness(pairs):
    adjacent = defaultdict(set)
    for a, b in pairs:
        if a != b:
            adjacent[a].add(b), adjacent[b].add(a)
    nodes, score = sorted(adjacent), defaultdict(float)

    def walks(s):
        depth, count, waiting = {s: 0}, defaultdict(int, {s: 1}), deque([s])
        while waiting:
            u = waiting.popleft()
            for v in adjacent[u]:
                if v not in depth:
                    depth[v] = depth[u] + 1
                    waiting.append(v)
                if depth[v] == depth[u] + 1:
                    count[v] += count[u]
        return depth, count

    table = {s: walks(s) for s in nodes}
    for s, t in combinations(nodes, 2):
        if t in table[s][0]:
            for v in nodes:
                if v not in (s, t) and v in table[s][0] and t in table[v][0] and table[s][0][v] + table[v][0][t] == table[s][0][t]:
                    score[v] += table[s][1][v] * table[v][1][t] / table[s][1][t]
    n = len(nodes)
    return {v: round(score[v] * 2 / ((n - 1) * (n - 2)), 6) for v in nodes}


def test_betweenness_both_ways_against_definition(spark):
    random.seed(3)
    pairs = [(f"v{random.randrange(14)}", f"v{random.randrange(14)}") for _ in range(22)] + [("x", "y"), ("y", "z")]
    want = _betweenness(pairs)
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(_edges(spark, pairs)).collect()}
    assert got == want
    limit, graph.BROADCAST_EDGES = graph.BROADCAST_EDGES, 0
    try:
        joined = {r["id"]: r["betweenness"] for r in graph.betweenness(_edges(spark, pairs)).collect()}
    finally:
        graph.BROADCAST_EDGES = limit
    assert joined == want


def test_betweenness_of_trees_groups_and_long_graphs(spark, monkeypatch):
    random.seed(5)
    pairs = [(f"{k}v{random.randrange(7 * k)}", f"{k}v{random.randrange(7 * k)}") for k in (1, 2, 3) for _ in range(9 * k)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)] + [("c0", "t"), ("t", "u"), ("t", "w"), ("p", "q")]
    want = _betweenness(pairs)
    for levels in (graph.LEVELS, 1):
        monkeypatch.setattr(graph, "LEVELS", levels)
        plan, names = _planned(pairs)
        total = np.zeros(len(names))
        for k in range(plan.blocks):
            plan.add(k, total)
        n = len(names)
        assert {x: round(d / ((n - 1) * (n - 2)), 6) for x, d in zip(names, total, strict=True)} == want
    assert {r["id"]: r["betweenness"] for r in graph.betweenness(_edges(spark, pairs)).collect()} == want


def _planned(pairs):
    names = sorted({x for p in pairs if p[0] != p[1] for x in p})
    links = sorted({tuple(sorted(names.index(x) for x in p)) for p in pairs if p[0] != p[1]})
    return graph._plan(len(names), *np.array(links).T), names


def test_betweenness_of_sources_together_and_apart(monkeypatch):
    random.seed(8)
    pairs = [(f"v{min(int(random.expovariate(0.2)), 149)}", f"v{random.randrange(150)}") for _ in range(420)] + [(f"c{i}", f"c{(i + 1) % 9}") for i in range(9)]
    want = _betweenness(pairs)
    for shared, size, run in ((graph.SHARED, graph.BYTES, graph.RUN), (10**6, 10**9, 3), (10**6, 20_000, 3), (0, 10**9, 3)):
        monkeypatch.setattr(graph, "SHARED", shared)
        monkeypatch.setattr(graph, "BYTES", size)
        monkeypatch.setattr(graph, "RUN", run)
        plan, names = _planned(pairs)
        total = np.zeros(len(names))
        for k in range(plan.blocks):
            plan.add(k, total)
        n = len(names)
        assert {x: round(d / ((n - 1) * (n - 2)), 6) for x, d in zip(names, total, strict=True)} == want


def test_betweenness_sources_share_their_work(monkeypatch):
    rng = np.random.default_rng(4)
    n, m = 20_000, 120_000
    links = np.sort(np.c_[rng.integers(0, n, m), np.minimum(rng.zipf(1.3, m), n) - 1], axis=1)
    links = np.unique(links[links[:, 0] != links[:, 1]], axis=0)
    ids, ends = np.unique(links, return_inverse=True)
    plan = graph._plan(len(ids), *ends.reshape(-1, 2).T)
    alone, flat = [], graph._Group._flat
    monkeypatch.setattr(graph._Group, "_flat", lambda self, s, depth: alone.append(s) or flat(self, s, depth))
    total = np.zeros(len(ids))
    for k in range(5):
        plan.add(k * plan.blocks // 5, total)
    assert not alone
    group = plan.group[1]
    used = [sum(len(down) for *_, (down, _) in group._levels(np.arange(at, at + graph.SOURCES))) for at in range(0, group.n - graph.SOURCES, 20 * graph.SOURCES)]
    assert max(used) < 3 * len(group.u) and sum(used) < 2 * len(used) * len(group.u)


def test_betweenness_work_does_not_grow_with_leaves(spark):
    import time

    leaves = 20_000
    pairs = [("hub", f"v{i}") for i in range(leaves)] + [("hub", "x"), ("x", "y"), ("y", "hub")]
    began = time.time()
    got = {r["id"]: r["betweenness"] for r in graph.betweenness(_edges(spark, pairs)).where("betweenness > 0").collect()}
    n = leaves + 3
    assert got == {"hub": round(1 - 2 / ((n - 1) * (n - 2)), 6)} and time.time() - began < 60


def test_key_actors_of_a_wide_table(spark, tmp_path):
    import time

    from quillstone.plans.graphs import key_actors

    source, leaves = "/root/testdata/sf0.001", 20_000
    spark.read.parquet(f"{source}/mentions.parquet").limit(0).write.parquet(f"{tmp_path}/mentions.parquet")
    row = spark.read.parquet(f"{source}/triples.parquet").limit(1).withColumn("confidence", F.lit(0.9)).drop("triple_id", "subject", "object")
    names = spark.range(leaves).select(F.col("id").alias("triple_id"), F.lit("Hub").alias("subject"), F.concat(F.lit("Leaf "), "id").alias("object"))
    row.crossJoin(names.unionByName(spark.createDataFrame([(leaves, "Leaf 0", "Tip")], names.schema))).write.parquet(f"{tmp_path}/triples.parquet")
    began, n = time.time(), leaves + 2
    got = [r["betweenness"] for r in key_actors(spark, str(tmp_path)).collect()]
    most = (leaves - 1) * (leaves - 2) / 2 + 2 * (leaves - 1)
    assert got == [round(2 * most / ((n - 1) * (n - 2)), 6), round(2 * leaves / ((n - 1) * (n - 2)), 6)] and time.time() - began < 60


def test_communities_separate_cliques(spark):
    pairs = [*combinations("abcd", 2), *combinations("wxyz", 2), ("d", "w")]
    edges = _edges(spark, pairs)
    labels = graph.communities(edges)
    got = {r["id"]: r["community"] for r in labels.collect()}
    assert len({got[x] for x in "abcd"}) == 1 and len({got[x] for x in "wxyz"}) == 1 and got["a"] != got["z"]
    assert graph.modularity(edges, labels) > 0.3


def test_two_hops_and_dates(spark):
    edges = _edges(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "y")])
    ball = {r["id"] for r in graph.ball(edges, spark.createDataFrame([("a",)], "id string"), 2).collect()}
    assert ball == {"a", "b", "c"}
    from quillstone.functions.exprs import valid_at

    rows = [("1995", None, True), ("1995-08", None, False), (None, None, True), ("", "", True), ("1990", "1991", False)]
    df = spark.createDataFrame(rows, "f string, t string, want boolean")
    assert all(r["want"] == r["got"] for r in df.withColumn("got", valid_at(F.col("f"), F.col("t"), "1995-07-11")).collect())


def test_last_edge_wins(spark):
    df = spark.createDataFrame([(1, "a", "b", "x"), (2, "a", "b", "y")], "ord int, source_id string, target_id string, predicate string")
    assert graph.collapsed(df).first()["predicate"] == "y" and ranking.first_by(df, ["source_id"], ["ord"]).first()["predicate"] == "x"


def test_recursive_chunks():
    assert chunking.split_recursive("short", 100, 20) == ["short"]
    text = "\n\n".join(". ".join("word " * random.Random(i).randint(3, 40) for _ in range(6)) for i in range(30))
    pieces = chunking.split_recursive(text, 400, 80)
    assert all(0 < len(p) <= 400 for p in pieces) and len(pieces) > 5
    at = 0
    for p in pieces:
        found = text.find(p, max(0, at - 80))
        assert 0 <= found <= at
        at = found + len(p)
    assert at >= len(text.rstrip())
    assert all(len(p) <= 50 for p in chunking.split_recursive("x" * 333, 50, 10))


def test_running_offsets(spark):
    rows = [(i, random.Random(i).randint(0, 9)) for i in range(100)]
    got = {r["i"]: r["offset"] for r in chunking.running_offsets(spark.createDataFrame(rows, "i int, n int"), "i", "n").collect()}
    assert got == {i: sum(n for _, n in rows[:i]) for i, _ in rows}


def test_upsert_is_idempotent(spark, tmp_path):
    from quillstone.sources import sinks

    rows = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    path = str(tmp_path / "t")
    sinks.upsert(spark, rows, path, ["k"])
    sinks.upsert(spark, rows, path, ["k"])
    sinks.upsert(spark, spark.createDataFrame([("b", 3), ("c", 4)], "k string, v int"), path, ["k"])
    assert {tuple(r) for r in sinks.read(spark, path).collect()} == {("a", 1), ("b", 3), ("c", 4)}
    assert {tuple(r) for r in store.upsert(rows, rows.limit(0), ["k"]).collect()} == {("a", 1), ("b", 2)}


def test_topk_and_diversity(spark):
    rng = np.random.default_rng(2)
    m = rng.standard_normal((40, 8))
    m[5] = m[4]
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "id int, v array<double>")
    top = vectors.top_k(rows.where("id % 10 = 0"), rows, "id", "v", 5, with_vectors=True)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    for q in range(0, 40, 10):
        s = unit @ unit[q]
        s[q] = -9
        want = sorted(range(40), key=lambda i: (-round(s[i], 6), i))[:5]
        assert [r["key"] for r in top.where(F.col("query") == q).orderBy("rank").collect()] == want
    picks = vectors.mmr(top, 3).orderBy("query", "pick").collect()
    assert len(picks) == 12
    assert picks[0]["key"] == top.where("query = 0 and rank = 1").first()["key"]
    small, vectors.QUERY_BLOCK = vectors.QUERY_BLOCK, 2
    try:
        again = vectors.top_k(rows.where("id % 10 = 0"), rows, "id", "v", 5)
        assert {tuple(r) for r in again.collect()} == {tuple(r) for r in top.drop("vector").collect()}
    finally:
        vectors.QUERY_BLOCK = small


def test_conflicts_leave_unknown_places_out(spark):
    df = spark.createDataFrame([(1, "siege", "X", "2001"), (2, "killing", " x ", "2001-05"), (3, "killing", None, None), (4, "siege", None, None), (5, "no_event", "X", "2001")], "ord int, event_type string, location string, date string")
    assert [tuple(r) for r in evidence.event_conflicts(df).collect()] == [(1, 2)]
    assert evidence.event_conflicts(df, with_unknown=True).count() == 2


def test_relation_pairs_are_verified(spark):
    from quillstone.operators import evidence, extraction

    events = spark.createDataFrame([(1, "siege", "Kel", "1993", "c1"), (2, "killing", "Kel", "1993", "c2")], "ord long, event_type string, location string, date string, source_chunk_id string")
    triples = spark.createDataFrame([(i, "A", f"p{i}", "B", f"c{i}") for i in range(1, 5)], "ord long, subject string, predicate string, object string, source_chunk_id string")
    texts = spark.createDataFrame([(f"c{i}", "x" * (600 if i < 3 else 0) + f" {i} men") for i in range(1, 5)], "chunk_id string, chunk_text string")
    pairs = evidence.to_verify(events, triples, 6)
    assert sorted(tuple(r) for r in pairs.collect()) == [("event", 1, 2), ("relation", 1, 2), ("relation", 1, 3), ("relation", 1, 4), ("relation", 2, 3), ("relation", 2, 4)]
    claims = {(r["kind"], r["a"], r["b"]): r for r in evidence.all_claims(pairs, events, triples, texts).collect()}
    assert len(claims) == 6 and claims["event", 1, 2]["claim_a"] == "x" * 600 + " 1 men"
    assert claims["relation", 1, 3]["claim_a"] == "[Relation predicate: 'p1']\n" + "x" * 400 and claims["relation", 1, 3]["claim_b"] == "[Relation predicate: 'p3']\n 3 men"
    assert {r["kind"] for r in extraction.verified(evidence.all_claims(pairs, events, triples, texts)).collect()} == {"event", "relation"}
