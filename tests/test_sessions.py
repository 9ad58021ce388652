import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from quillstone import agents, providers
from quillstone.operators import silence
from quillstone.operators import vectors as V
from quillstone.session import cut
from quillstone.sources import connectors as C
from quillstone.sources import sinks
from quillstone.streaming import frontier as S
from quillstone.streaming import sessions as N


def test_a_crawl_goes_one_level_deeper(spark):
    frontier = spark.createDataFrame([("https://a.example/p.html", 0.9, "Tovar Guard", "s", 0), ("https://b.example/q.html", 0.8, "Tovar Guard", "s", 1), ("https://c.example/x", 0.1, "e", "s", 0)], S.ITEM)
    visits = spark.createDataFrame([("https://a.example/old.pdf", "e", 3), ("https://a.example/bad.pdf", "e", 0)], "url string, trigger_entity string, chunks long")
    html = '<a href="old.pdf">o</a><a href="tovar.pdf">n</a><a href="/plain.html">p</a><a href="mailto:x@y">m</a>'
    pages = spark.createDataFrame([("https://a.example/p.html", html, 2)], "url string, html string, chunks int")
    new, after = N.crawl(frontier, visits, pages, 2)
    assert {tuple(r) for r in new.collect()} == {("https://a.example/p.html", "Tovar Guard", 2), ("https://b.example/q.html", "Tovar Guard", 0)}
    got = {r["url"]: r for r in after.collect()}
    assert set(got) == {"https://c.example/x", "https://a.example/tovar.pdf"}
    # relevance 0.3 + 0.2 for "tovar", two of three visits of the host gave chunks, a report file, one level down
    assert got["https://a.example/tovar.pdf"]["depth"] == 1 and got["https://a.example/tovar.pdf"]["priority"] == pytest.approx(0.6 * 0.5 + 0.3 * 0.667 + 0.15 - 0.1, abs=1e-3)


def test_next_item_passes_blocked_and_busy_hosts(spark):
    rows = [("https://www.reddit.com/a", 0.9, "e", "s", 0), ("https://busy.example/a", 0.8, "e", "s", 0), ("https://free.example/a", 0.7, "e", "s", 0)]
    busy = spark.createDataFrame([("busy.example",)], "domain string")
    assert N.next_item(spark.createDataFrame(rows, S.ITEM), busy).first()["url"] == "https://free.example/a"
    assert N.next_item(spark.createDataFrame(rows[:2], S.ITEM), busy).first()["url"] == "https://busy.example/a"
    assert N.next_item(spark.createDataFrame(rows[:1], S.ITEM), busy).count() == 0


def test_reseed_and_activity(spark):
    rows = spark.createDataFrame([(3, 1, True), (3, 1, False), (9, 6, False), (9, 7, False)], "f int, s int, d boolean")
    assert [r[0] for r in rows.select(N.reseed_reason(F.col("f"), F.col("s"), F.col("d"))).collect()] == ["drift", "frontier", "interval", None]
    live = N.Activity()
    for i in range(20):
        live.onQueryProgress(SimpleNamespace(progress=SimpleNamespace(batchId=i, numInputRows=2)))
    assert len(live.lines) == 14 and live.lines[-1] == "batch 19: 2 rows"


class _Scripted:
    def complete(self, task, text):
        return json.dumps({"novel_entities": ["Mila Front", "the"], "queries": ["Tovar guard records", "recipe of Tovar"], "reasoning": "r"})


def test_agent_session(spark):
    documents = spark.createDataFrame([(i, f"t{i}", "x") for i in range(7)], "ord int, title string, excerpt string")
    got = agents.run_session(documents, ["Tovar"], spark.createDataFrame([], "query string"), _Scripted())
    assert len(got["reasonings"]) == 2 and got["novel_entities"] == ["Mila Front"] and got["queries"] == ["Tovar guard records"]


def test_answers_and_briefings():
    passages = [{"source_filename": "a.txt", "geography": "", "date_published": "2001", "text": "The guard left. The market in Mila burned."}, {"source_filename": "b.txt", "geography": None, "date_published": None, "text": "Nothing here."}]
    got = agents.answer("What burned at the market?", passages, providers.ExtractiveModel())
    assert got["answer"] == "The market in Mila burned. [Source 1]" and got["cited"] == [1] and got["confidence"] == 0.5
    assert agents.answer("q", [], providers.ExtractiveModel())["confidence"] == 0.0
    assert "Read: 4" in agents.narrate({"query": "q", "ingested": 4}, providers.ExtractiveModel()) and "Nothing has been read" in agents.narrate({"query": "q"}, providers.ExtractiveModel())


def test_chat_server_and_selection():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            answer = json.dumps({"choices": [{"message": {"content": body["messages"][1]["content"].upper()}}]}).encode()
            self.send_response(200)
            self.end_headers()
            self.wfile.write(answer)

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        model = providers.language_model("chat", f"http://127.0.0.1:{server.server_port}/v1", "m")
        assert model.complete("answer", "abc") == "ABC" and providers.language_model("chat", f"http://127.0.0.1:{server.server_port}/v1", "m") is model
    finally:
        server.shutdown()
    with pytest.raises(ValueError):
        providers.language_model("chat")


def test_reranker_falls_back():
    rows = [{"text": t} for t in ("a", "bbb", "cc")]
    by_length = SimpleNamespace(score=lambda query, texts: [len(t) for t in texts])
    broken = SimpleNamespace(score=lambda query, texts: 1 / 0)
    assert [r["text"] for r in providers.reranked("q", rows, by_length, 2)] == ["bbb", "cc"] and providers.reranked("q", rows, broken, 2) == providers.reranked("q", rows, None, 2) == rows[:2]


def test_more_parsers(spark, tmp_path):
    feeds = spark.createDataFrame([("f", json.dumps({"results": [{"title": "Tovar news", "url": "https://x.example/1", "summary": "s", "published_at": "2020-01-02T03"}, {"title": "other", "url": "https://x.example/2", "summary": "", "published_at": ""}]})), ("g", "broken")], "feed string, payload string")
    web = spark.createDataFrame([(json.dumps([{"title": "Tovar", "href": "https://x.example/3.pdf", "body": "b"}]),)], "payload string")
    ids = [("ids", json.dumps({"esearchresult": {"idlist": ["7"]}})), ("summaries", json.dumps({"result": {"7": {"title": "Tovar study", "pubdate": "2001 Jan", "source": "J"}}}))]
    got = {r["url"]: r for r in C.discovered({"json_feed": feeds, "duckduckgo": web, "pubmed": spark.createDataFrame(ids, "kind string, payload string")}, ["Tovar"]).collect()}
    assert set(got) == {"https://x.example/1", "https://x.example/3.pdf", "https://pubmed.ncbi.nlm.nih.gov/7/"}
    assert got["https://x.example/3.pdf"]["relevance_score"] == 0.8 and got["https://x.example/1"]["relevance_score"] == 0.6 and got["https://x.example/1"]["source"] == "f"
    (tmp_path / "gdelt").mkdir()
    (tmp_path / "gdelt" / "a.json").write_text("{}")
    assert [tuple(r) for r in C.stored(spark, str(tmp_path)).collect()] == [("gdelt", "a.json", "{}")]
    sinks.append_log(spark.range(1), str(tmp_path / "log"))
    sinks.append_log(spark.range(1), str(tmp_path / "log"))
    assert spark.read.json(str(tmp_path / "log")).count() == 2


def test_links_by_cosine_and_by_spelling_against_all_pairs(spark):
    from difflib import SequenceMatcher
    from itertools import combinations

    import numpy as np

    from quillstone import adapters as A

    rng = np.random.default_rng(3)
    base = rng.standard_normal((60, 24))
    rows = [(i * 5 + j, "l", (base[i] + 0.25 * rng.standard_normal(24)).tolist()) for i in range(60) for j in range(5)] + [(900, "l", []), (901, None, base[0].tolist())]
    df = spark.createDataFrame(rows, "k long, g string, v array<double>")
    got = {(r["a"], r["b"]) for r in V.cosine_links(df, "k", "g", "v", 0.88).collect()}
    unit = np.array([r[2] for r in rows[:300]])
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    near = unit @ unit.T
    want = {(i, j) for i, j in combinations(range(300), 2) if round(near[i, j], 6) >= 0.88}
    assert got <= want and len(got) >= 0.98 * len(want) > 0
    registry = A.registry(spark, "/root/testdata/sf0.001")
    texts = registry.select("canonical_id", "label", F.lower("canonical_text").alias("t")).collect()
    truth = {tuple(sorted((a[0], b[0]))) for a, b in combinations(texts, 2) if a[1] == b[1] and 100 * SequenceMatcher(None, *[x[2] for x in sorted((a, b), key=lambda r: r[0])], autojunk=False).ratio() >= 72}
    found = {(r["a"], r["b"]) for r in silence.fuzzy_pairs(registry, 72.0).collect()}
    assert found <= truth and len(found) >= 0.98 * len(truth) > 0


def test_spelling_pairs_are_all_pairs(spark, monkeypatch):
    import random
    from difflib import SequenceMatcher
    from itertools import combinations

    rng = random.Random(4)
    texts = ["UN", "UNO", "X", "x", "", "ab" * 40, "ab" * 39 + "c", "é漢" * 9, "é漢" * 8 + "漢é", "abcd", "a-b-c-d"] + ["".join(rng.choice("abcé ") for _ in range(rng.randrange(1, 14))) for _ in range(150)]
    rows = [(f"{i:04x}", "l" if i % 3 else None, t) for i, t in enumerate(dict.fromkeys(texts))] + [(None, "l", "abcd")]
    registry = spark.createDataFrame(rows, "canonical_id string, label string, canonical_text string")
    low = [(i, g, t.lower()) for i, g, t in rows if i and t]
    score = {(a[0], b[0]): 100 * SequenceMatcher(None, a[2], b[2], autojunk=False).ratio() for a, b in combinations(low, 2) if a[1] == b[1]}
    for block in (silence.BLOCK, 20):
        monkeypatch.setattr(silence, "BLOCK", block)
        for threshold in (72.0, 50.0):
            got = [(r["a"], r["b"], r["ratio"]) for r in silence.fuzzy_pairs(registry, threshold).collect()]
            assert len(got) == len(set(got)) and {x[:2]: x[2] for x in got} == {p: x for p, x in score.items() if x >= threshold}


def test_entity_links_connect_what_all_near_pairs_do(spark, monkeypatch):
    from difflib import SequenceMatcher
    from itertools import combinations

    import numpy as np

    from quillstone import adapters as A
    from quillstone.operators.components import joined
    from quillstone.providers import HashEmbedder

    registry = cut(A.registry(spark, "/root/testdata/sf0.001"))
    rows = registry.select("canonical_id", "label", "canonical_text").orderBy("canonical_id").collect()
    m = HashEmbedder().embed([r[2] for r in rows]).astype(np.float64)
    low, links = [r[2].lower() for r in rows], []
    for i, j in combinations(range(len(rows)), 2):
        if rows[i][1] == rows[j][1] and (round(m[i] @ m[j] / max(np.linalg.norm(m[i]) * np.linalg.norm(m[j]), 1e-12), 6) >= 0.88 or 100 * SequenceMatcher(None, low[i], low[j], autojunk=False).ratio() >= 72):
            links.append((i, j))
    want = joined(np.arange(len(rows)), *np.array(links).T)
    number = {r[0]: i for i, r in enumerate(rows)}
    for block in (silence.BLOCK, 25):
        monkeypatch.setattr(silence, "BLOCK", block)
        got = np.array([(number[r["a"]], number[r["b"]]) for r in silence.entity_links(registry, HashEmbedder()).collect()])
        assert (joined(np.arange(len(rows)), *got.T) == want).all()
        assert block == 25 or len(got) == len(rows) - len(np.unique(want)) < len(links)
