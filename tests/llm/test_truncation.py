import random
import re

import numpy as np
from pyspark.sql import functions as F

from quillstone.llm import hashing as H
from quillstone.llm import truncation as T


def _sentence():
    pick = random.choice
    return f"{pick(['The', 'A'])} {pick(['guard', 'clerk', 'witness', 'driver', 'nurse'])} {pick(['left', 'saw', 'closed', 'opened', 'held'])} the {pick(['depot', 'bridge', 'school', 'market'])} near {pick(['Tovar', 'Mila', 'Ostra', 'Kel'])} after {random.randint(1, 900)} days."


def _texts():
    random.seed(8)
    whole = [" ".join(_sentence() for _ in range(random.randint(3, 20))) for _ in range(120)]
    footer = [t + "\n\n" + random.choice(["ENDS", f"Ref: AB/{random.randint(1, 99)}/7", f"Page {i} of {i}", "| total | 12 |"]) for i, t in enumerate(whole[:60])]
    cut = [t[: -random.randint(3, 30)].rstrip(".") for t in whole[60:90]]
    cut = [t for t in cut if not t.endswith(".")]
    marked = [t[:-9] + m for t, m in zip(whole[90:100], ["…", "...", " [...]", "… (more)", " ... Read more"] * 2, strict=True)]
    return whole[100:] + footer, cut + marked


def test_verdicts(spark):
    whole, cut = _texts()
    rows = list(enumerate(whole + cut)) + [(900, None), (901, ""), (902, "   "), (903, "Between <a hre"), (904, "اذهب إلى المدع�")]
    df = spark.createDataFrame([*rows, rows[0], (None, whole[0])], "id long, text string").withColumn("cut", F.lit(1)).withColumn("h", F.lit(2))
    out = T.truncated(df, "id", "text").collect()
    assert len(out) == len(rows) + 2
    got = {r["key"] for r in out if r["cut"]}
    assert got == {i for i, t in rows if t in set(cut)} | {903, 904}
    assert T.truncated(df.limit(0), "id", "text").count() == 0


def test_near_copy_that_goes_on(spark):
    random.seed(3)
    base = " ".join(_sentence() for _ in range(12))
    inside = base + " The guard of the old. m"
    rows = [(1, base + " The guard of the old. mill left the old market at noon, and the clerk of the town saw it."), (2, inside), (3, base), (4, "The nurse slept. " * 30)]
    copies = T.early_copies(spark.createDataFrame(rows, "id long, text string"), "text", F.xxhash64("text"))
    hashes = {r[0]: r[1] for r in spark.createDataFrame(rows, "id long, text string").select("id", F.xxhash64("text")).collect()}
    assert {r["h"] for r in copies.collect()} == {hashes[2]}


def test_runs_against_plain_python():
    texts = ["", "a b", "One, two three four five six!", "one TWO three four five six", "ß straße x y z w", "x " * 50]
    runs, owner = H.shingle_hashes(texts, 5)
    words = [re.findall(r"[^\W_]+", t.lower()) for t in texts]
    assert [int((owner == i).sum()) for i in range(len(texts))] == [max(0, len(w) - 4) for w in words]
    assert np.array_equal(runs[owner == 2], runs[owner == 3]) and len(set(runs[owner == 5].tolist())) == 1


def test_parts_of_a_very_long_text():
    chunk, H.CHUNK = H.CHUNK, 256
    H.powers.cache_clear()
    try:
        text = " ".join(f"w{i}" for i in range(500))
        long, _ = H.shingle_hashes([text], 5)
    finally:
        H.CHUNK = chunk
        H.powers.cache_clear()
    whole, _ = H.shingle_hashes([text], 5)
    assert np.array_equal(long, whole)


def test_bands_agree_for_near_copies():
    random.seed(2)
    text = " ".join(_sentence() for _ in range(40))
    a, b, c = T.bands([text, text[: int(len(text) * 0.9)], "nothing alike here at all in this one text"])
    assert (a == b).sum() >= 3 and not (a == c).any() and T.bands(["too short"]) == [None]


def test_source_that_is_not_the_longest_copy(spark):
    random.seed(3)
    base = " ".join(_sentence() for _ in range(12))
    inside = base + " The guard of the old. m"
    rows = [(1, base + " The guard of the old. mill left the old market at noon, and the clerk of the town saw it."), (2, inside), (3, base), (4, base + "\n\n" + "The nurse of the school held the bridge and left. " * 3)]
    df = spark.createDataFrame(rows, "id long, text string")
    hashes = {r[0]: r[1] for r in df.select("id", F.xxhash64("text")).collect()}
    assert not T.ends_early(inside, rows[3][1]) and T.ends_early(inside, rows[0][1])
    bands = T.bands
    T.bands = lambda texts: [np.zeros(1, dtype=np.int64) for _ in texts]  # one bucket holds all
    try:
        assert {r["h"] for r in T.early_copies(df, "text", F.xxhash64("text")).collect()} == {hashes[2]}
    finally:
        T.bands = bands
