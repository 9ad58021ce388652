import random

import pytest
from pyspark.sql import functions as F

from quillstone.llm import neardup


def _truth(rows, t):
    out = set()
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            x_, y_ = set(x.split()), set(y.split())
            if a != b and x_ and y_ and len(x_ & y_) >= t * len(x_ | y_) - 1e-9:
                out.add((min(a, b), max(a, b)))
    return out


def _frame(spark, rows):
    return spark.createDataFrame(rows, "k string, t string").withColumn("class", F.lit(1)).withColumn("features", F.lit("x"))


@pytest.mark.parametrize("frequent", [neardup.FREQUENT, 6, 1])
def test_pairs_against_brute_force(spark, monkeypatch, frequent):
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    random.seed(5)
    vocabulary = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(60):
        base = random.sample(vocabulary, random.choice([1, 2, 3, 6, 12, 30]))
        for j in range(3):
            edited = [random.choice(vocabulary) if random.random() < 0.12 else w for w in base]
            rows.append((f"k{i}_{j}", " ".join(edited)))
    rows += [("dup1", rows[0][1]), ("dup2", rows[0][1]), ("same", "a b"), ("same", "a b c")]
    for t in (0.3, 0.6, 0.8, 1.0) if frequent == 6 else (0.6,):
        got = {(r[0], r[1]) for r in neardup.near_pairs(_frame(spark, rows), "k", "t", 1, t).collect()}
        assert got == _truth(rows, t), t


@pytest.mark.parametrize("frequent", [neardup.FREQUENT, 1])
def test_long_sets_and_blocks(spark, monkeypatch, frequent):
    monkeypatch.setattr(neardup, "FREQUENT", frequent)
    random.seed(6)
    base = [f"v{i}" for i in range(150)]
    rows = [(f"k{j:02}", " ".join(base if j % 2 else [random.choice(["x", "y", "z"]) if random.random() < 0.1 else w for w in base])) for j in range(30)]
    got = {(r[0], r[1]) for r in neardup.near_pairs(_frame(spark, rows), "k", "t", 1, 0.6).collect()}
    assert got == _truth(rows, 0.6)


def test_edges(spark):
    rows = [("a", None), ("b", ""), ("c", "one two"), ("d", "one two three"), ("e", "one two three"), (None, "one two three"), ("d", "one two three")]
    got = {(r[0], r[1]) for r in neardup.near_pairs(_frame(spark, rows), "k", "t", 3, 0.6).collect()}
    assert got == {("d", "e")}
    assert neardup.near_pairs(_frame(spark, rows).limit(0), "k", "t", 3, 0.6).count() == 0


def test_groups(spark):
    rows = [("a", "a b c d e f g h i j"), ("b", "a b c d e f g h i k"), ("c", "a b c d e f g h l k"), ("d", "q r s"), ("e", "q r s")]
    got = {r["key"]: r for r in neardup.near_groups(_frame(spark, rows), "k", "t", 1, 0.75).collect()}
    assert got["a"]["group"] == got["b"]["group"] == got["c"]["group"] != got["d"]["group"]
    assert got["b"]["links"] == 2 and got["a"]["links"] == 1 and got["d"]["links"] == 0 and got["d"]["class"] == got["e"]["class"]
