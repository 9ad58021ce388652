import math
from collections import Counter
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.llm import language as L

TEXTS = {
    "en": "The western witness searched the old depot near the river. In the account of the clerk, the family left the village without warning. It took many hours until the patrol repaired the bridge.",
    "fr": "Le gardien a vidé la mairie, tandis que le greffier a fouillé les archives. On ne sait pas pourquoi la délégation a quitté le pont après le cessez-le-feu. Une famille déplacée a reconstruit l'école du village.",
    "de": "Der Bauer zählte die Menschen und sah das alte Lagerhaus. Niemand weiß, warum eine Lehrerin den Kontrollpunkt mied. Die Patrouille durchsuchte die Brücke bei starkem Regen, während man wartete.",
    "tr": "Nöbetçi köprüyü kuşattı, tabur ise kuyuyu işgal etti. Daha sonra devriye neden yakıt deposunu terk etti, bilinmiyor. Köyünden gelen bir tanık birkaç saat sonra eski değirmeni geçti.",
    "ar": "جاء الدورية من القرية ثم راقب القافلة الخنادق خلال الليل. في وقت لاحق لا يعرف لماذا أخلى شاهد محلي المستودع. نقل حوالي عشرين شخصا إلى المدرسة.",
}


def test_forward_sums_all_segmentations():
    pieces = {"▁": 0, "▁a": 1, "a": 2, "b": 3, "ab": 4, "▁ab": 5}
    p = np.array([[0.1], [0.2], [0.15], [0.25], [0.05], [0.25]])
    words = ["▁abb", "b", "▁abq"]
    lattice = L.Lattice(pieces, words)

    def brute(s):
        return 1.0 if not s else sum(p[k][0] * brute(s[len(x) :]) for x, k in pieces.items() if s.startswith(x)) + (L.UNKNOWN * brute(s[1:]) if s[0] not in pieces else 0)

    for word, row in zip(words, lattice.forward(p), strict=True):
        assert math.isclose(row[0], math.log(brute(word)))


def test_chain_against_brute_force():
    rng = np.random.default_rng(5)
    emit, sizes = rng.normal(size=(6, 3)) * 2, np.array([2, 4])
    got = L.chain(emit, sizes)
    stay, move = math.log(L.STAY), math.log((1 - L.STAY) / 2)
    at = 0
    for n in sizes:
        want = np.zeros((n, 3))
        for path in product(range(3), repeat=int(n)):
            weight = math.exp(sum(emit[at + i, k] for i, k in enumerate(path)) + sum(stay if a == b else move for a, b in zip(path, path[1:], strict=False)))
            for i, k in enumerate(path):
                want[i, k] += weight
        assert np.allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True))
        at += n


def test_em_raises_likelihood():
    pieces = {c: i for i, c in enumerate(["▁", "a", "b", "c", "ab", "▁ab", "bc"])}
    words, counts = ["ab", "abc", "cab"], np.array([[5.0], [3.0], [1.0]])
    old = -np.inf
    for rounds in (1, 2, 4, 8):
        backoff, L.BACKOFF = L.BACKOFF, 1e-3
        lattice = L.Lattice(pieces, ["▁" + w for w in words])
        p = L.em(lattice, counts, rounds)
        L.BACKOFF = backoff
        now = float((counts[:, 0] * lattice.forward(p)[:, 0]).sum())
        assert now >= old - 1e-6
        old = now


@pytest.fixture(scope="module")
def model(spark):
    pytest.importorskip("sentencepiece")
    rows = [(f"{k}{i}", f"{t} {t} {i}", k) for k, t in TEXTS.items() for i in range(3)]
    rows = [(a, t, "en" if a == "fr2" else k) for a, t, k in rows]  # one wrong label
    return L.train(spark.createDataFrame(rows, "id string, t string, l string"), "t", "l")


def test_identify(spark, model):
    mixed = TEXTS["en"] + "\n\n" + TEXTS["fr"]
    rows = [(1, TEXTS["de"]), (2, mixed), (3, None), (4, ""), (5, "1234 !!"), (None, TEXTS["tr"]), (7, TEXTS["ar"]), (7, TEXTS["ar"]), (8, "x" * 100_000)]
    df = spark.createDataFrame(rows, "id long, t string").withColumn("language", F.lit("?"))
    out = L.identify(df, "id", "t", model).collect()
    got = {r["key"]: r for r in out}
    assert got[1]["language"] == "de" and got[1]["confidence"] > 0.9 and got[None]["language"] == "tr" and got[7]["language"] == "ar"
    assert {s["language"] for s in got[2]["segments"]} == {"en", "fr"} and mixed[got[2]["segments"][1]["start"] :].strip().startswith("Le gardien")
    assert got[3]["language"] is got[4]["language"] is got[5]["language"] is None and Counter(r["key"] for r in out)[7] == 2
    assert L.identify(df.limit(0), "id", "t", model).count() == 0


def test_made_up_words_and_headers_are_no_mixture(spark, model):
    made_up = " Enclosed skesho fikro kluda sibu choglo dubritreskus pabo hogru chushu gusu kode kete himu rodo."
    rows = [(1, TEXTS["en"] + made_up), (2, "Seite 4 von 22\n" + TEXTS["fr"]), (3, TEXTS["en"] + "\n\n" + TEXTS["tr"]), (4, "hogru;chushu;gusu;kode;kete;himu;rodo;shafu;zinu")]
    got = {r["key"]: r for r in L.identify(spark.createDataFrame(rows, "id long, t string"), "id", "t", model).collect()}
    attested = lambda k: {s["language"] for s in got[k]["segments"] if s["attested"]}
    assert attested(1) == {"en"} and attested(2) == {"fr"} and attested(3) == {"en", "tr"} and attested(4) == set()
    assert got[1]["language"] == "en" and got[2]["language"] == "fr"


def test_labels(spark):
    labels = ["en-GB", " FR ", "deu", "Turkish", "xx", None, "", "bs-Latn", "العربية"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in labels], "l string").select(L.label_language(F.col("l"))).collect()]
    assert got == ["en", "fr", "de", "tr", None, None, None, "bs", "ar"]
