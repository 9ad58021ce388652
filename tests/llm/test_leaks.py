import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import leaks


def _corpus():
    random.seed(9)
    names = [f"n{i}" for i in range(400)]
    sentence = lambda: f"the {random.choice(names)} guard of {random.choice(names)} told {random.choice(names)} that {random.choice(names)} left the depot near {random.choice(names)} before dawn"
    items = [(i, sentence() + " " + sentence(), ". ".join(sentence() for _ in range(3))) for i in range(30)]
    docs = [(d, ". ".join(sentence() for _ in range(random.randint(1, 30)))) for d in range(200)]
    for d in range(200, 260):
        words = items[random.randrange(30)][random.choice([1, 2])].replace(".", "").split()
        a = random.randrange(max(1, len(words) - 14))
        docs.append((d, sentence() + ". " + " ".join(words[a : a + random.randint(9, 25)]).upper() + ", " + sentence()))
    return items, docs


def _truth(items, docs):
    w = lambda s: re.findall(r"[^\W_]+", (s or "").lower())
    grams = lambda s: {tuple(s[i : i + 12]) for i in range(len(s) - 11)}
    return {(d, i) for d, t in docs for i, q, g in items if grams(w(t)) & (grams(w(q)) | grams(w(g)))}


def test_recall_against_brute_force(spark):
    items, docs = _corpus()
    docs += [(900, None), (901, ""), (902, "short text"), (None, items[0][2]), (903, items[1][1]), (903, items[1][1]), (904, "filler " * 50_000 + items[2][1])]
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item", F.lit(1))
    i = spark.createDataFrame([*items, (98, None, ""), (99, "too short", None), items[0]], "item_id long, q string, a string")
    got = {(r["doc"], r["item"]) for r in leaks.find_leaks(d, "doc_id", "text", i, "item_id", ("q", "a")).where("run").collect()}
    assert got == _truth(items, docs)
    assert leaks.find_leaks(d.limit(0), "doc_id", "text", i, "item_id", ("q", "a")).count() == 0
    assert leaks.find_leaks(d, "doc_id", "text", i.limit(0), "item_id", ("q", "a")).count() == 0


def test_every_run_lies_in_one_passage():
    random.seed(4)
    vocabulary = {f"w{i}": i for i in range(50)}
    texts = [" ".join(random.choice(["q", *vocabulary]) if random.random() < 0.1 else random.choice(list(vocabulary)) for _ in range(n)) for n in (5, 12, 24, 25, 100, 333)]
    ids, begins = leaks.batch_ids(texts, vocabulary)
    starts, runs = leaks.eligible(ids)
    for at in np.flatnonzero(runs):
        assert any(s <= at <= s + leaks.HALF for s in starts)
    assert len(begins) == len(texts)


def test_subsequence_against_brute_force():
    def slow(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        return row[-1]

    random.seed(1)
    for _ in range(200):
        a, b = ([random.randrange(6) for _ in range(random.randrange(25))] for _ in "ab")
        assert leaks.lcs(a, b) == slow(a, b)


def test_many_subsequences_against_one_by_one():
    rng = np.random.default_rng(3)
    passages = rng.integers(0, 9, (40, 24)).astype(np.int32)
    passages[::2, 14:] = -1
    ids = rng.integers(-1, 9, 480).astype(np.int32)
    starts, q = (x.reshape(-1) for x in np.meshgrid(np.arange(0, 456, 12), np.arange(40)))
    one = [leaks.lcs([x for x in passages[j].tolist() if x >= 0], ids[s : s + 24].tolist()) / (passages[j] >= 0).sum() for s, j in zip(starts, q, strict=True)]
    want = {i: x for i, x in enumerate(one) if x >= leaks.ORDERED}
    old = leaks.TABLE
    try:
        for leaks.TABLE in (old, 0):
            at, share = leaks.Subsequences(passages, 9).of(ids, starts, q)
            assert 0 < len(want) < len(one) and dict(zip(at.tolist(), share.tolist(), strict=True)) == want
    finally:
        leaks.TABLE = old


def test_paraphrases(spark):
    items, docs = _corpus()
    ground = items[4][2].split()
    # A foreign word after every eight, a fifth of the words replaced, and words of the item in no order.
    docs += [(700, " ".join(w + (" foreignword" if k % 8 == 7 else "") for k, w in enumerate(ground))), (701, " ".join("otherword" if k % 5 == 4 else w for k, w in enumerate(ground))), (702, " ".join(sorted(ground)))]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, q string, a string")
    rows = leaks.find_leaks(d, "doc_id", "text", i, "item_id", ("q", "a")).where("doc >= 700").collect()
    got = {r["doc"]: r for r in rows if r["item"] == 4}
    assert set(got) == {700, 701} and not any(r["run"] for r in rows)
    assert all(r["subsequence"] >= leaks.ORDERED and r["answer"] > 0.6 for r in got.values())


def test_planted_paraphrases_are_found(spark):
    """Every seventh word of an answer replaced by a foreign one, some words left out and some swapped: no run of twelve is left."""
    items, docs = _corpus()
    random.seed(12)
    planted = []
    for i, _q, answer in items:
        words = answer.replace(".", "").split()
        words = [("zzz" + w if k % 7 == 3 else w) for k, w in enumerate(words) if random.random() > 0.05]
        for k in range(5, len(words) - 1, 11):
            words[k], words[k + 1] = words[k + 1], words[k]
        planted.append((1000 + i, "Some other words come first here, as they do. " + " ".join(words) + ". And then the page goes on with other things."))
    d = spark.createDataFrame([*docs, *planted], "doc_id long, text string")
    e = spark.createDataFrame(items, "item_id long, q string, a string")
    got = {(r["doc"], r["item"]) for r in leaks.find_leaks(d, "doc_id", "text", e, "item_id", ("q", "a")).where("not run").collect()}
    found = sum((1000 + i, i) in got for i, _, _ in items)
    assert found >= 0.9 * len(items), found
