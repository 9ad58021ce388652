import pytest

from quillstone import cli
from quillstone.api import Engine
from quillstone.streaming import frontier, windows


@pytest.fixture(scope="module")
def engine(spark, tmp_path_factory):
    home = tmp_path_factory.mktemp("engine")
    (home / "corpus").mkdir()
    (home / "corpus" / "a.txt").write_text("On 4 May 2001 Karvessa National Guard detained the old driver near Tovar. Hussein Gedrosojit ordered the guard at the depot.\n\n" * 3)
    (home / "corpus" / "b.txt").write_text("Hussein Gedrosojit inspected the market in Mila. The Karvessa National Guard besieged the bridge of the town.\n\n" * 60)
    e = Engine(spark, str(home / "data"), "My Project!")
    e.ingest(str(home / "corpus"), geography="Tovar")
    e.extract()
    e.resolve()
    return e, home


def test_ingest_is_idempotent(engine):
    e, home = engine
    n = e.table("chunks").count()
    assert e.ingest(str(home / "corpus"), geography="Tovar").count() == n > 2


def test_search_and_graph(engine):
    e, _ = engine
    assert e.search("Who inspected the market in Mila?").first()["source_filename"] == "b.txt"
    assert e.find_entity("karvessa").count() >= 1
    assert e.graph_query("What did Hussein Gedrosojit do?").count() >= 1
    assert e.network().count() >= 2 and e.corpus_stats().count() >= 4
    assert e.context("market").count() == 1


def test_answer_cites_its_sources(engine):
    e, _ = engine
    got = e.ask("Who inspected the market in Mila?")
    assert "market in Mila" in got["answer"] and got["cited"] and 0 < got["confidence"] <= 1 and got["sources"]
    assert got["graph"].count() >= 1


def test_fetch_run(engine, spark):
    e, home = engine
    rows = [(f"https://h{i}.example/{'r.txt.pdf' if i == 1 else 'p'}{i}", f"Title {i}", "arxiv", "2020-01-0" + str(i), 0.9 if i < 4 else 0.1) for i in range(1, 6)]
    found = spark.createDataFrame(rows, "url string, title string, source string, date string, relevance_score double")
    head = lambda url: "text/html" if "/p" in url else "application/pdf"
    page = lambda url: None if "h3" in url else f"<html><script>x</script><p>Page &amp; text of {url}</p></html>"
    register = str(home / "register")
    got = e.fetch(found, head, page, lambda url: b"not a pdf", str(home / "files"), register, "Tovar").first()
    assert tuple(got) == (5, 3, 3, 1, 2)  # the page of h2; h1 is no readable file, h3 gave nothing
    assert e.table("chunks").where("source_url like '%h2%' and text like 'Page & text%'").count() == 1
    again = e.fetch(found, head, page, lambda url: b"", str(home / "files"), register).first()
    assert again["above_threshold"] == 2


def test_export_and_cli(engine, spark):
    e, home = engine
    assert set(e.export(str(home / "out"))) >= {"mentions", "triples", "corpus_stats"}
    args = cli.parser().parse_args([str(home / "data"), "My Project!", "find", "karvessa"])
    assert cli.run(spark, args).count() >= 1
    with pytest.raises(SystemExit):
        cli.parser().parse_args(["r", "p", "ingest", "folder"])


def test_frontier_stream_equals_batch(spark, tmp_path):
    rows = [(f"https://h.example/{i % 17}.pdf", (i % 10) / 10, "e", "s", 0) for i in range(40)]
    source = tmp_path / "in"
    for k in range(2):
        spark.createDataFrame(rows[k * 20 : k * 20 + 20], frontier.ITEM).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(frontier.ITEM).option("maxFilesPerTrigger", 1).parquet(str(source))
    state = str(tmp_path / "state")
    q = frontier.run_stream(spark, stream, state, str(tmp_path / "ck"), batch=4)
    q.awaitTermination(120)
    visited = spark.read.parquet(f"{state}/visited")
    left = spark.read.parquet(f"{state}/frontier/1")
    assert visited.count() == 8 == visited.select("url").distinct().count()
    assert left.count() == 17 - 8 and left.join(visited, "url").count() == 0


def test_windows_on_a_stream(spark, tmp_path):
    path = "/root/testdata/sf0.001/events.parquet"
    batch = spark.read.parquet(path)
    batch.write.parquet(str(tmp_path / "ev"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "ev"))
    q = windows.tumbling(stream.withColumn("ts", stream["ts"].cast("timestamp")), "ts", "event_type").writeStream.outputMode("complete").format("memory").queryName("w1").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = {(str(r[0]), r[1], r[2]) for r in windows.tumbling(batch, "ts", "event_type").collect()}
    assert {(str(r[0]), r[1], r[2]) for r in spark.table("w1").collect()} == want
