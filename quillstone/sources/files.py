"""Files as tables: corpus folders, JSON results, JSONL logs, the register."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.functions import fixed

REGISTER = "filename string, title string, source_url string, doc_type string, language string, date_published string, date_accessed string, geography string, licence string, notes string"
ENTITIES = "source_chunk_id string, entities array<struct<text:string,label:string,confidence:double,span_start:int,span_end:int>>"
RELATIONS = "source_chunk_id string, relations array<struct<subject:string,predicate:string,object:string,location:string,date:string,confidence:double,evidence:string>>"
EVENTS = "event_type string, confidence double, date string, location string, perpetrator string, victim_group string, source_chunk_id string"
LOG = "source_url string, source_title string, trigger_entity string, novel_entities array<string>, generated_queries array<string>, reasoning string, timestamp string"


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):  # noqa: ANN001
        self.hidden += tag in ("script", "style")
        if tag in ("p", "br", "div", "li", "h1", "h2", "h3", "tr"):
            self.parts.append("\n")

    def handle_endtag(self, tag):  # noqa: ANN001
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):  # noqa: ANN001
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    return re.sub(r"[ \t]*\n\s*", "\n", "".join(parser.parts)).strip()


def docx_text(content: bytes) -> str:
    import io
    import zipfile
    from xml.etree import ElementTree

    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(content)).read("word/document.xml"))
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def pdf_text(content: bytes) -> str:
    try:
        from pypdf import PdfReader
    except ImportError as error:
        raise ValueError("no PDF reader is installed") from error
    import io

    return "\n".join(page.extract_text() or "" for page in PdfReader(io.BytesIO(content)).pages)


def parse(suffix: str, content: bytes) -> str:
    """Text of a file by its suffix; unknown ones are read as text."""
    if suffix in ("html", "htm"):
        return html_text(content.decode("utf-8", "replace"))
    if suffix == "docx":
        return docx_text(content)
    if suffix == "pdf":
        return pdf_text(content)
    return content.decode("utf-8", "replace")


def load_corpus(spark: SparkSession, folder: str, doc_type: str = "report", language: str = "en", geography: str | None = None, source_url: str | None = None, date_published: str | None = None) -> DataFrame:
    """All readable files below a folder with base metadata; a file that can't be parsed has null text and an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    suffix = F.lower(F.regexp_extract(name, r"\.([^.]*)$", 1))
    rows = files.select("path", name.alias("source_filename"), suffix.alias("suffix"), "content").where(F.col("suffix").isin(list(fixed.SUFFIXES)) | (F.col("suffix") == ""))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for s, c in zip(batch["suffix"], batch["content"], strict=True):
                try:
                    texts.append(parse(s, bytes(c))), errors.append(None)
                except Exception as error:  # noqa: BLE001  one bad file must not end the load
                    texts.append(None), errors.append(str(error)[:200])
            yield batch[["path", "source_filename", "suffix"]].assign(text=texts, error=errors)

    parsed = rows.mapInPandas(run, "path string, source_filename string, suffix string, text string, error string")
    return parsed.withColumns({"doc_type": F.lit(doc_type), "language": F.lit(language), "geography": F.lit(geography).cast("string"), "source_url": F.lit(source_url).cast("string"), "date_published": F.lit(date_published).cast("string")})


def load_files(rows: DataFrame) -> DataFrame:
    """Rows (url, text) of files (url, path) in a folder that all executors see; a file that can't be parsed has null text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = []
            for path in batch["path"]:
                try:
                    with open(path, "rb") as f:
                        texts.append(parse(path.rsplit(".", 1)[-1].lower(), f.read()))
                except Exception:  # noqa: BLE001  one bad file must not end the load
                    texts.append(None)
            yield batch[["url"]].assign(text=texts)

    return rows.select("url", "path").mapInPandas(run, "url string, text string")


def register(spark: SparkSession, path: str) -> DataFrame:
    """The register in either column layout, by header; a missing file is an empty register."""
    try:
        raw = spark.read.option("header", True).csv(path)
    except Exception as error:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], REGISTER)
    names = [c.split()[0] for c in REGISTER.split(", ")]
    return raw.select(*[F.col(c) if c in raw.columns else F.lit(None).cast("string").alias(c) for c in names])


def known_urls(register_: DataFrame) -> DataFrame:
    return register_.where("source_url <> ''").select(F.col("source_url").alias("url")).distinct()


def results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A JSON file that holds one array of results."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def flat_entities(rows: DataFrame) -> DataFrame:
    return rows.select("source_chunk_id", F.inline("entities"))


def flat_relations(rows: DataFrame) -> DataFrame:
    return rows.select("source_chunk_id", F.inline("relations"))


def log_tail(spark: SparkSession, path: str, n: int) -> DataFrame:
    """The last ``n`` entries of a JSONL log by time."""
    return spark.read.schema(LOG).json(path).orderBy(F.desc("timestamp")).limit(n)
