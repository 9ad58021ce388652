import json

from pyspark.sql import functions as F

from quillstone.providers import HashEmbedder, salvage
from quillstone.sources import connectors as C
from quillstone.sources import files, sinks


def _payload(spark, value):
    return spark.createDataFrame([(value if isinstance(value, str) else json.dumps(value),)], "payload string")


def test_openalex(spark):
    value = {"results": [{"title": "A", "open_access": {"oa_url": "https://x.example/a.pdf"}, "publication_date": "2001-02-03", "abstract_inverted_index": {"hello": [0, 2], "big": [1]}}, {"title": "no url", "open_access": {"oa_url": None}}]}
    assert [tuple(r) for r in C.openalex(_payload(spark, value)).collect()] == [("A", "https://x.example/a.pdf", "2001-02-03", "hello big hello")]
    assert C.openalex(_payload(spark, "not json")).count() == 0


def test_archive_and_arxiv(spark):
    value = {"response": {"docs": [{"identifier": "i1", "title": ["T1", "T2"], "date": "1999-01-02T00:00", "description": "d"}, {"title": "none"}]}}
    assert [tuple(r) for r in C.internetarchive(_payload(spark, value)).collect()] == [("T1", "https://archive.org/details/i1", "1999-01-02", "d")]
    atom = '<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>T</title><id>http://a/1</id><published>2020-01-02T00:00:00Z</published><summary>S</summary><link type="application/pdf" href="http://a/1.pdf"/></entry><entry><title>U</title><id>http://a/2</id><published>2020-01-03</published><summary>V</summary></entry></feed>'
    assert [r["url"] for r in C.arxiv(_payload(spark, atom)).collect()] == ["http://a/1.pdf", "http://a/2"]
    assert C.arxiv(_payload(spark, "<feed/>")).count() == 0


def test_other_services(spark):
    one = lambda f, v: [tuple(r) for r in f(_payload(spark, v)).collect()]
    assert one(C.semanticscholar, {"data": [{"title": "T", "year": 2003, "openAccessPdf": {"url": "u"}}, {"title": "x"}]}) == [("T", "u", "2003-01-01", None)]
    assert one(C.gdelt, {"articles": [{"title": "T", "url": "u", "seendate": "20220102T030405Z"}]}) == [("T", "u", "2022-01-02", None)]
    assert one(C.doaj, {"results": [{"bibjson": {"title": "T", "year": "2001", "link": [{"type": "x", "url": "a"}, {"type": "fulltext", "url": "b"}]}}]}) == [("T", "b", "2001-01-01", None)]
    assert one(C.europepmc, {"resultList": {"result": [{"title": "T", "doi": "10.1/x"}, {"title": "U", "pmid": "7"}]}})[1][1].endswith("/MED/7")
    assert one(C.worldbank, {"documents": {"D1": {"display_title": "T", "pdfurl": "p", "docdt": "2001-02-03T00:00:00Z"}}}) == [("T", "p", "2001-02-03", None)]
    assert one(C.hdx, {"result": {"results": [{"title": "T", "name": "n", "metadata_created": "2001-02-03T04", "notes": "x"}]}}) == [("T", "https://data.humdata.org/dataset/n", "2001-02-03", "x")]
    assert one(C.crossref, {"message": {"items": [{"title": ["T"], "DOI": "10.1/y", "abstract": "<p>a</p>", "published": {"date-parts": [[2001, 2, 3]]}}]}}) == [("T", "https://doi.org/10.1/y", "2001-02-03", "a")]
    assert one(C.wikipedia_links, {"query": {"pages": {"1": {"title": "P", "extlinks": [{"*": "//www.hrw.org/a"}, {"*": "http://bad.example/b"}]}}}}) == [("P", "https://www.hrw.org/a", None, None)]
    ids = _payload(spark, {"esearchresult": {"idlist": ["2", "1"]}})
    summaries = _payload(spark, {"result": {"1": {"title": "one"}, "2": {"title": "two", "pubdate": "2001 Jan"}}})
    assert [r["title"] for r in C.pubmed(ids, summaries).collect()] == ["two", "one"]


def test_feed_and_union(spark):
    rss = "<rss><channel>" + "".join(f"<item><title>Guard news {i}</title><link>http://f/{i}</link><description><![CDATA[text]]></description></item>" for i in range(15)) + "<item><title>other</title><link>http://f/z</link></item></channel></rss>"
    got = C.feed(spark.createDataFrame([("f", rss)], "feed string, payload string"), ["guard"])
    assert got.count() == 10 and got.first()["snippet"] == "text"
    both = C.discovered({"gdelt": _payload(spark, {"articles": [{"title": "Guard", "url": "u", "seendate": "20220102"}]})}, ["guard", "army"]).first()
    assert both["trigger_entity"] == "guard" and both["relevance_score"] == 0.5


def test_fetch_keeps_errors(spark):
    def fetch(url):
        if "bad" in url:
            raise ValueError("down")
        return "body"

    got = {r["url"]: (r["payload"], r["error"]) for r in C.fetched(spark.createDataFrame([("http://a/x",), ("http://bad/x",)], "url string"), fetch).collect()}
    assert got == {"http://a/x": ("body", None), "http://bad/x": (None, "down")}


def test_stored_payloads(spark, tmp_path):
    (tmp_path / "gdelt").mkdir()
    (tmp_path / "gdelt" / "a.json").write_text("{}")
    spark.dataSource.register(C.StoredPayloads)
    assert [tuple(r) for r in spark.read.format("payloads").load(str(tmp_path)).collect()] == [("gdelt", "a.json", "{}")]


def test_corpus_files_and_register(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "a.txt").write_text("plain")
    (tmp_path / "c" / "b.html").write_text("<p>one</p><script>x</script><p>two</p>")
    (tmp_path / "c" / "c.docx").write_bytes(b"broken")
    (tmp_path / "c" / "d.exe").write_text("no")
    got = {r["source_filename"]: r for r in files.load_corpus(spark, str(tmp_path / "c"), geography="X").collect()}
    assert got["a.txt"]["text"] == "plain" and got["b.html"]["text"] == "one\ntwo" and got["c.docx"]["text"] is None and got["c.docx"]["error"] and "d.exe" not in got
    (tmp_path / "s.csv").write_text("filename,source_url,date_accessed,licence,geography,notes\na,http://u,2020,x,y,\nb,,2020,x,y,\n")
    assert [r[0] for r in files.known_urls(files.register(spark, str(tmp_path / "s.csv"))).collect()] == ["http://u"]
    assert files.register(spark, str(tmp_path / "none.csv")).count() == 0


def test_salvage():
    for answer in ('{"a": 1}', '```json\n{"a": 1}\n```', '```\n{"a": 1}\n```', 'say {x} then {"a": 1} and {"b": 2}', '  {"a": 1}  '):
        assert salvage(answer) == {"a": 1}
    assert salvage("nothing") is None and salvage(None) is None and salvage("{broken") is None


def test_hash_embedding_is_stable():
    a, b = HashEmbedder().embed(["red guard", "red guard"]), HashEmbedder().embed([""])
    assert (a[0] == a[1]).all() and abs((a[0] ** 2).sum() - 1) < 1e-5 and not b.any()


def test_exports(spark, tmp_path):
    events = spark.createDataFrame([(1, "siege", 0.5, None, None, "p", "v", "c1")], "ord int, event_type string, confidence double, date string, location string, perpetrator string, victim_group string, source_chunk_id string")
    mentions = spark.createDataFrame([(1, "Tovar", "LOCATION", "c1")], "ord int, text string, label string, source_chunk_id string")
    line = json.loads(sinks.geojson(events, mentions).first()[0])
    assert line["properties"]["location"] == "Tovar" and line["geometry"] is None
    paths = sinks.export_all({"events": events, "geo": sinks.geojson(events, mentions)}, str(tmp_path))
    assert spark.read.json(paths["events"]).count() == 1 and spark.read.text(paths["geo"]).select(F.get_json_object("value", "$.type")).first()[0] == "Feature"
