"""Parsers of external payloads into discovered documents, and a data source that serves stored payloads.

A payload is one row of text as the service returned it. Parsing is Catalyst with explicit schemas; the fetch is a ``mapInPandas`` with a pluggable function, so tests and replays
need no network. A payload that does not parse gives no rows. Every parser returns (title, url, date, snippet).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstone.functions import exprs as X
from quillstone.functions import fixed

DOCUMENT = "title string, url string, date string, snippet string"


def _json(df: DataFrame, schema: str, items: str) -> DataFrame:
    return df.select(F.from_json("payload", schema).alias("j")).select(F.explode(F.col(f"j.{items}")).alias("d"))


def _rows(df: DataFrame, title: Column, url: Column, date: Column, snippet: Column) -> DataFrame:
    out = df.select(title.alias("title"), url.alias("url"), date.alias("date"), F.substr(snippet, F.lit(1), F.lit(300)).alias("snippet"))
    return out.where("url is not null and url <> ''")


def _first(c: Column) -> Column:
    """A JSON string, or the first of a JSON array of strings."""
    return F.coalesce(F.get(F.from_json(c, "array<string>"), F.lit(0)), F.regexp_replace(c, r'^\["?|"?\]$', ""))


def openalex(df: DataFrame) -> DataFrame:
    rows = _json(df, "results array<struct<title:string,doi:string,publication_date:string,open_access:struct<oa_url:string,is_oa:boolean>,abstract_inverted_index:map<string,array<int>>>>", "results")
    return _rows(rows, F.col("d.title"), F.coalesce("d.open_access.oa_url", "d.doi"), F.substr("d.publication_date", F.lit(1), F.lit(10)), X.inverted_abstract(F.col("d.abstract_inverted_index")))


def semanticscholar(df: DataFrame) -> DataFrame:
    rows = _json(df, "data array<struct<title:string,year:int,abstract:string,openAccessPdf:struct<url:string>>>", "data")
    return _rows(rows, F.col("d.title"), F.col("d.openAccessPdf.url"), F.concat(F.col("d.year").cast("string"), F.lit("-01-01")), F.col("d.abstract"))


def arxiv(df: DataFrame) -> DataFrame:
    """Atom XML; the pdf link, else the entry's id."""
    plain = df.select(F.regexp_replace("payload", r'\sxmlns(:\w+)?="[^"]*"', "").alias("payload"))
    entries = plain.select(F.explode(F.regexp_extract_all("payload", F.lit(r"(?s)(<entry>.*?</entry>)"), F.lit(1))).alias("e"))
    at = lambda path: F.xpath_string("e", F.lit(path))
    pdf = F.nullif(at("entry/link[@type='application/pdf'][1]/@href"), F.lit(""))
    return _rows(entries, F.trim(F.regexp_replace(at("entry/title"), r"\s+", " ")), F.coalesce(pdf, at("entry/id")), F.substr(at("entry/published"), F.lit(1), F.lit(10)), F.trim(at("entry/summary")))


def internetarchive(df: DataFrame) -> DataFrame:
    rows = _json(df, "response struct<docs:array<struct<identifier:string,title:string,date:string,description:string>>>", "response.docs")
    url = F.concat(F.lit("https://archive.org/details/"), "d.identifier")
    return _rows(rows, _first(F.col("d.title")), url, F.substr(_first(F.col("d.date")), F.lit(1), F.lit(10)), _first(F.col("d.description")))


def gdelt(df: DataFrame) -> DataFrame:
    rows = _json(df, "articles array<struct<title:string,url:string,seendate:string,domain:string>>", "articles")
    return _rows(rows, F.col("d.title"), F.col("d.url"), X.short_date(F.col("d.seendate")), F.col("d.domain"))


def doaj(df: DataFrame) -> DataFrame:
    rows = _json(df, "results array<struct<bibjson:struct<title:string,year:string,abstract:string,link:array<struct<type:string,url:string>>>>>", "results")
    links = F.col("d.bibjson.link")
    full = F.get(F.filter(links, lambda x: x["type"] == "fulltext"), F.lit(0))["url"]
    return _rows(rows, F.col("d.bibjson.title"), F.coalesce(full, F.get(links, F.lit(0))["url"]), X.short_date(F.col("d.bibjson.year")), F.col("d.bibjson.abstract"))


def europepmc(df: DataFrame) -> DataFrame:
    rows = _json(df, "resultList struct<result:array<struct<title:string,doi:string,pmid:string,firstPublicationDate:string,abstractText:string>>>", "resultList.result")
    url = F.when(F.col("d.doi").isNotNull(), F.concat(F.lit("https://doi.org/"), "d.doi")).otherwise(F.concat(F.lit("https://europepmc.org/article/MED/"), "d.pmid"))
    return _rows(rows, F.col("d.title"), url, F.col("d.firstPublicationDate"), F.col("d.abstractText"))


def pubmed(ids: DataFrame, summaries: DataFrame) -> DataFrame:
    """Two payloads: the id list in order, and the summaries by id."""
    order = ids.select(F.posexplode(F.from_json("payload", "esearchresult struct<idlist:array<string>>")["esearchresult"]["idlist"]).alias("pos", "id"))
    found = summaries.select(F.explode(F.from_json(F.to_json(F.from_json("payload", "result map<string,string>")["result"]), "map<string,string>")).alias("id", "s"))
    rows = order.join(found, "id").withColumn("d", F.from_json("s", "title string, pubdate string, source string")).orderBy("pos")
    return _rows(rows, F.col("d.title"), F.concat(F.lit("https://pubmed.ncbi.nlm.nih.gov/"), "id", F.lit("/")), F.substr("d.pubdate", F.lit(1), F.lit(10)), F.col("d.source"))


def worldbank(df: DataFrame) -> DataFrame:
    docs = df.select(F.explode(F.map_values(F.from_json("payload", "documents map<string,string>")["documents"])).alias("s"))
    rows = docs.select(F.from_json("s", "display_title string, pdfurl string, url string, docdt string, abstracts string").alias("d"))
    return _rows(rows, F.col("d.display_title"), F.coalesce("d.pdfurl", "d.url"), F.substr("d.docdt", F.lit(1), F.lit(10)), F.col("d.abstracts"))


def hdx(df: DataFrame) -> DataFrame:
    rows = _json(df, "result struct<results:array<struct<title:string,name:string,metadata_created:string,notes:string>>>", "result.results")
    return _rows(rows, F.col("d.title"), F.concat(F.lit("https://data.humdata.org/dataset/"), "d.name"), F.substr("d.metadata_created", F.lit(1), F.lit(10)), F.col("d.notes"))


def crossref(df: DataFrame) -> DataFrame:
    rows = _json(df, "message struct<items:array<struct<title:array<string>,DOI:string,abstract:string,published:struct<`date-parts`:array<array<int>>>>>>", "message.items")
    parts = F.get(F.col("d.published.`date-parts`"), F.lit(0))
    date = F.array_join(F.transform(parts, lambda p: F.when(p < 10, F.concat(F.lit("0"), p.cast("string"))).otherwise(p.cast("string"))), "-")
    return _rows(rows, F.get("d.title", F.lit(0)), F.concat(F.lit("https://doi.org/"), "d.DOI"), date, F.regexp_replace("d.abstract", "<[^>]+>", ""))


def wikipedia_links(df: DataFrame) -> DataFrame:
    """External links of pages, those to trusted hosts and report files."""
    pages = df.select(F.explode(F.map_values(F.from_json("payload", "query struct<pages:map<string,struct<title:string,extlinks:array<map<string,string>>>>>")["query"]["pages"])).alias("d"))
    rows = pages.select("d", F.explode("d.extlinks").alias("l")).withColumn("u", F.get(F.map_values("l"), F.lit(0)))
    url = F.when(F.startswith("u", F.lit("//")), F.concat(F.lit("https:"), "u")).otherwise(F.col("u"))
    return _rows(rows.withColumn("u", url).where(X.trusted(F.col("u")) | X.is_pdf(F.col("u"))), F.col("d.title"), F.col("u"), F.lit(None).cast("string"), F.lit(None).cast("string"))


def feed(df: DataFrame, entities: list[str], per_feed: int = 10) -> DataFrame:
    """RSS or Atom items that name an entity; ``df`` has (feed, payload). The first ``per_feed`` matches of each feed."""
    plain = df.select("feed", F.regexp_replace("payload", r'\sxmlns(:\w+)?="[^"]*"', "").alias("payload"))
    items = plain.select("feed", F.posexplode(F.regexp_extract_all("payload", F.lit(r"(?s)(<(?:item|entry)[ >].*?</(?:item|entry)>)"), F.lit(1))).alias("pos", "e"))
    tag = lambda *names: F.coalesce(*[F.nullif(F.trim(F.regexp_extract("e", rf"(?s)<{n}[^>]*>(?:<!\[CDATA\[)?(.*?)(?:\]\]>)?</{n}>", 1)), F.lit("")) for n in names])
    url = F.coalesce(tag("link"), F.nullif(F.regexp_extract("e", r'<link[^>]*href="([^"]*)"', 1), F.lit("")))
    rows = items.select("feed", "pos", tag("title").alias("title"), url.alias("url"), tag("pubDate", "published", "updated").alias("date"), tag("description", "summary").alias("snippet"))
    text = F.lower(F.concat_ws(" ", "title", "snippet"))
    rows = rows.where(F.exists(F.array(*[F.lit(e.lower()) for e in entities]), lambda e: F.contains(text, e)))
    ranked = rows.groupBy("feed").agg(F.slice(F.array_sort(F.collect_list(F.struct("pos", "title", "url", "date", "snippet"))), 1, per_feed).alias("i")).select("feed", F.inline("i"))
    return ranked.select("feed", "title", "url", "date", "snippet").where("url is not null")


def json_feed(df: DataFrame, entities: list[str], per_feed: int = 10) -> DataFrame:
    """Items of JSON feeds; ``df`` has (feed, payload). Of the first ``per_feed`` items of a feed those that name an entity."""
    item = "array<struct<title:string,url:string,summary:string,published_at:string>>"
    listed = F.from_json("payload", f"results {item}, articles {item}")
    items = df.select("feed", listed.alias("j")).select("feed", F.inline(F.slice(F.coalesce("j.results", "j.articles", F.array().cast(item)), 1, per_feed)))
    text = F.lower(F.concat_ws(" ", "title", "summary"))
    rows = items.where(F.exists(F.array(*[F.lit(e.lower()) for e in entities]), lambda e: F.contains(text, e)) & (F.col("url") != ""))
    return rows.select("feed", "title", "url", F.nullif(F.substr("published_at", F.lit(1), F.lit(10)), F.lit("")).alias("date"), F.substr("summary", F.lit(1), F.lit(300)).alias("snippet"))


def websearch(df: DataFrame) -> DataFrame:
    """Results of a web search: a JSON array of (title, href or url, body)."""
    rows = df.select(F.explode(F.from_json("payload", "array<struct<title:string,href:string,url:string,body:string>>")).alias("d"))
    url = F.coalesce(F.nullif("d.href", F.lit("")), "d.url")
    return _rows(rows, F.coalesce("d.title", url), url, F.lit(None).cast("string"), F.col("d.body"))


PARSERS: dict[str, Callable[[DataFrame], DataFrame]] = {"openalex": openalex, "semanticscholar": semanticscholar, "arxiv": arxiv, "internetarchive": internetarchive, "gdelt": gdelt, "doaj": doaj, "europepmc": europepmc, "worldbank": worldbank, "hdx": hdx, "crossref": crossref, "wikipedia": wikipedia_links, "duckduckgo": websearch}
#: Sources whose results count for more if they are report files or, for a web search, on trusted hosts.
BOOSTS = {"duckduckgo": 0.2, "wikipedia": 0.15}


def discovered(payloads: dict[str, DataFrame], entities: list[str], limit: int | None = None) -> DataFrame:
    """Union of all sources with source, trigger entity and relevance.

    ``feed`` and ``json_feed`` take frames with (feed, payload) and name each feed as the source; ``pubmed`` takes frames with (kind, payload) of kinds
    "ids" and "summaries". ``limit`` keeps the first rows of a source in the order its service gave, as its page size would.
    """
    out = None
    for source, df in payloads.items():
        if source in ("feed", "json_feed"):
            rows = (feed if source == "feed" else json_feed)(df, entities).withColumnRenamed("feed", "source")
        elif source == "pubmed":
            rows = pubmed(df.where("kind = 'ids'"), df.where("kind = 'summaries'")).withColumn("source", F.lit(source))
        else:
            rows = PARSERS[source](df).withColumn("source", F.lit(source))
        rows = (rows if limit is None else rows.limit(limit)).withColumn("trigger_entity", X.first_contained(entities, F.col("title")))
        score = X.relevance(F.col("trigger_entity"), F.concat_ws(" ", "title", "snippet") if source in ("feed", "json_feed", "duckduckgo") else F.col("title"), 0.3 if source == "gdelt" else 0.4)
        if source in BOOSTS:
            worth = X.is_pdf(F.col("url")) if source == "wikipedia" else X.is_pdf(F.col("url")) | X.trusted(F.col("url"))
            score = F.when(worth, F.round(F.least(F.lit(1.0), score + BOOSTS[source]), 3)).otherwise(score)
        rows = rows.withColumn("relevance_score", score).select("title", "url", "date", "snippet", "source", "trigger_entity", "relevance_score")
        out = rows if out is None else out.unionByName(rows)
    return out


def requests(entities: DataFrame) -> DataFrame:
    """Rows (source, entity, url): what each search interface is asked for each entity."""
    patterns = F.inline(F.array(*[F.struct(F.lit(k).alias("source"), F.lit(v).alias("pattern")) for k, v in fixed.SEARCH_URLS.items()]))
    return entities.select("entity", patterns).select("source", "entity", F.replace("pattern", F.lit("{q}"), F.url_encode("entity")).alias("url"))


def fetch_totals(found: DataFrame, above: DataFrame, fetched_: DataFrame) -> DataFrame:
    """One row of counts of a fetch run; ``fetched_`` has the chunks each document gave."""
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name)).withColumn("one_", F.lit(1))
    totals = fetched_.agg(F.count(F.lit(1)).alias("fetched"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks_added"), F.count_if(F.col("chunks") == 0).alias("skipped")).withColumn("one_", F.lit(1))
    return one(found, "candidates_found").join(one(above, "above_threshold"), "one_").join(totals, "one_").drop("one_")


def content_types(rows: DataFrame, head: Callable[[str], str | None]) -> DataFrame:
    """``rows`` (url, …) with content_type, asked with ``head``; a request that fails counts as a page."""

    @F.pandas_udf("string")
    def ask(urls: pd.Series) -> pd.Series:
        def one(url: str) -> str:
            try:
                return (head(url) or "text/html").lower()
            except Exception:  # noqa: BLE001  an unreachable header is no reason to skip the page
                return "text/html"

        return urls.map(one)

    return rows.withColumn("content_type", ask.asNondeterministic()("url"))


def downloaded(rows: DataFrame, fetch: Callable[[str], bytes], folder: str) -> DataFrame:
    """Rows (url, path, bytes, error): each (url, filename) is written to ``folder``, which all executors must share.

    A file is written under another name and then renamed, so a task that runs again leaves no half of one.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import os
        import uuid

        for batch in batches:
            out = []
            for url, name in zip(batch["url"], batch["filename"], strict=True):
                path = os.path.join(folder, name)
                try:
                    body = fetch(url)
                    os.makedirs(folder, exist_ok=True)
                    part = f"{path}.{uuid.uuid4().hex}"
                    with open(part, "wb") as f:
                        f.write(body)
                    os.replace(part, path)
                    out.append((url, path, len(body), None))
                except Exception as error:  # noqa: BLE001  one bad file must not end the task
                    out.append((url, None, 0, str(error)[:200]))
            yield pd.DataFrame(out, columns=["url", "path", "bytes", "error"])

    return rows.select("url", "filename").repartition(X.domain(F.col("url"))).mapInPandas(run, "url string, path string, bytes long, error string")


def fetched(requests: DataFrame, fetch: Callable[[str], str | None]) -> DataFrame:
    """Rows (url, payload, error) of requests (url); spread by host, so that one host is asked by few tasks at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for url in batch["url"]:
                try:
                    rows.append((url, fetch(url), None))
                except Exception as error:  # noqa: BLE001  one bad page must not end the task
                    rows.append((url, None, str(error)[:200]))
            yield pd.DataFrame(rows, columns=["url", "payload", "error"])

    return requests.repartition(X.domain(F.col("url"))).mapInPandas(run, "url string, payload string, error string")


def stored(spark: SparkSession, folder: str) -> DataFrame:
    """Rows (source, file, payload) of a folder of any file system: each file is one payload, its parent folder the source."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    path = F.split("path", "/")
    return files.select(F.get(path, F.size(path) - 2).alias("source"), F.get(path, F.size(path) - 1).alias("file"), F.col("content").cast("string").alias("payload"))


class StoredPayloads(DataSource):
    """``spark.read.format("payloads").load(folder)``: as ``stored``, for a folder that the driver and all executors see under one path."""

    @classmethod
    def name(cls) -> str:
        return "payloads"

    def schema(self) -> str:
        return "source string, file string, payload string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return _PayloadReader(self.options["path"])


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _PayloadReader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def partitions(self) -> list[_File]:
        import os

        return [_File(os.path.join(base, f)) for base, _, files in sorted(os.walk(self.path)) for f in sorted(files)]

    def read(self, partition: _File) -> Iterator[tuple]:
        import os

        with open(partition.path, encoding="utf-8", errors="replace") as f:
            yield os.path.basename(os.path.dirname(partition.path)), os.path.basename(partition.path), f.read()
