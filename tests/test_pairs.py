from collections import Counter

from pyspark.sql import functions as F

from quillstone.operators.pairs import looked_up, pairs_across, pairs_within
from quillstone.operators.ranking import first_k


def _rows(spark):
    """A hot key, small ones, and rows without one."""
    return spark.createDataFrame([("hot", i) for i in range(40)] + [("b", 100), ("b", 101), ("c", 200), (None, 300), (None, 301)], "k string, m long")


def test_pairs_within_loses_and_doubles_none(spark):
    for block in (1000, 7, 1):
        got = [(r["a_m"], r["b_m"]) for r in pairs_within(_rows(spark), "k", "m", F.col("a_m") < F.col("b_m"), block).collect()]
        assert Counter(got) == Counter([(i, j) for j in range(40) for i in range(j)] + [(100, 101)]), block


def test_pairs_across(spark):
    left = spark.createDataFrame([("hot", "x"), ("hot", "y"), ("b", "z"), ("d", "w"), (None, "v")], "k string, n string")
    for block in (1000, 7):
        got = Counter((r["a_n"], r["b_m"]) for r in pairs_across(left, _rows(spark), "k", "m", F.lit(True), block).collect())
        assert got == Counter([(n, i) for n in "xy" for i in range(40)] + [("z", 100), ("z", 101)])
    assert pairs_across(left, _rows(spark).limit(0), "k", "m", F.lit(True)).count() == 0


def test_looked_up_keeps_every_row(spark):
    values = spark.createDataFrame([("hot", 1, "p"), ("c", 2, "q"), ("zz", 3, "r")], "k string, v int, w string")
    for block in (100_000, 7):
        got = Counter(tuple(r) for r in looked_up(_rows(spark), "k", "m", values, block).select("k", "m", "v", "w").collect())
        assert got == Counter([("hot", i, 1, "p") for i in range(40)] + [("b", 100, None, None), ("b", 101, None, None), ("c", 200, 2, "q"), (None, 300, None, None), (None, 301, None, None)])


def test_first_k_of_a_hot_group(spark):
    got = {(r["k_"], r["m"], r["k"]) for r in first_k(_rows(spark).withColumnRenamed("k", "k_"), "k_", "m", 3, shards=4).collect()}
    assert got == {("hot", 0, 1), ("hot", 1, 2), ("hot", 2, 3), ("b", 100, 1), ("b", 101, 2), ("c", 200, 1), (None, 300, 1), (None, 301, 2)}
