"""Text transforms and ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.functions import exprs as X
from quillstone.operators import chunking, store
from quillstone.plans.base import Plans
from quillstone.session import cut, table

plans = Plans()
query = plans.query

_STRIDE = "(SELECT doc_id, text, unnest(range(0, greatest(length(text) - 801, 0) + 1, 3200)) AS start FROM documents WHERE text IS NOT NULL)"


@query(f"SELECT doc_id, start // 3200 AS pos, start, md5(substr(text, start + 1, 4000)) AS chunk FROM {_STRIDE}")
def chunk_fixed_stride(spark: SparkSession, d: str) -> DataFrame:
    return chunking.fixed_stride(table(spark, d, "documents"), "doc_id", "text").withColumn("chunk", F.md5("chunk"))


@query()
def chunk_recursive(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive(table(spark, d, "documents"), "doc_id", "text")


@query(f"""SELECT doc_id, start // 3200 AS pos, CAST((SELECT 0) + sum(1) OVER (ORDER BY doc_id, start) - 1 AS BIGINT) AS chunk_index FROM {_STRIDE}""")
def chunk_index_global(spark: SparkSession, d: str) -> DataFrame:
    """One running index over all documents, from counts per document."""
    pieces = chunking.fixed_stride(table(spark, d, "documents"), "doc_id", "text").select("doc_id", "pos")
    counts = cut(pieces.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")))
    offsets = chunking.running_offsets(counts, "doc_id", "n").select("doc_id", "offset")
    return pieces.join(offsets, "doc_id").select("doc_id", "pos", (F.col("offset") + F.col("pos")).alias("chunk_index"))


@query("SELECT doc_id, md5(substr(text, 1, 2000)) AS stored, length(substr(text, 1, 2000)) AS n FROM documents WHERE text IS NOT NULL")
def chunk_store_truncate(spark: SparkSession, d: str) -> DataFrame:
    stored = F.substring("text", 1, 2000)
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(stored).alias("stored"), F.length(stored).alias("n"))


@query(f"SELECT chunk_id, nullif(coalesce(source_url, ''), '') AS source_url, nullif(coalesce(geography, ''), '') AS geography, CAST(TRY_CAST(CASE WHEN regexp_full_match(date_published, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN date_published END AS DATE) AS VARCHAR) AS published FROM {A.CHUNKS}")
def meta_roundtrip(spark: SparkSession, d: str) -> DataFrame:
    """Metadata to scalars without nulls and back; bad dates become null."""
    flat = A.chunks(spark, d).select("chunk_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("source_url", "geography", "date_published")])
    date = F.when(F.col("date_published").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date("date_published", "yyyy-MM-dd"))
    return flat.select("chunk_id", F.nullif("source_url", F.lit("")).alias("source_url"), F.nullif("geography", F.lit("")).alias("geography"), date.cast("string").alias("published"))


@query("""SELECT doc_id, md5(CASE WHEN length(text) <= 2000 THEN text ELSE array_to_string(list_transform([0, 1, 2, 3, 4], lambda i: substr(text, least(i * greatest(1, (length(text) - 400) // 4), length(text) - 400) + 1, 400)), ' … ') END) AS sample
 FROM documents WHERE text IS NOT NULL""")
def text_sample(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.md5(X.sampled_text(F.col("text"))).alias("sample"))


_TEXTS = f"(SELECT c.*, chunk_text FROM {A.CHUNKS} c JOIN (SELECT chunk_id, min(chunk_text) AS chunk_text FROM ner_gold GROUP BY 1) g ON g.chunk_id = c.chunk_id)"
_SOURCE = "concat_ws(' | ', source_filename, nullif(geography, ''), nullif(date_published, ''))"


def _texts(spark: SparkSession, d: str) -> DataFrame:
    texts = A.gold(spark, d).groupBy("chunk_id").agg(F.min("chunk_text").alias("chunk_text"))
    return A.chunks(spark, d).join(texts, "chunk_id")


@query(f"""SELECT source_filename, md5(string_agg('[Source ' || rank || '] (' || {_SOURCE} || ')' || chr(10) || chunk_text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)) AS context
 FROM (SELECT *, row_number() OVER (PARTITION BY source_filename ORDER BY chunk_index, chunk_id) AS rank FROM {_TEXTS}) WHERE rank <= 3 GROUP BY source_filename""")
def context_render(spark: SparkSession, d: str) -> DataFrame:
    """The first three chunks of each file that have a text, as a model gets them; their hash."""
    rows = _texts(spark, d).withColumn("place", F.struct("chunk_index", "chunk_id"))
    return store.context_blocks(rows, "source_filename", "place", "chunk_text", 3).withColumn("context", F.md5("context"))


@query(f"""SELECT chunk_id, md5('[Passage ' || (chunk_index + 1) || '] Source: ' || source_filename || CASE WHEN m <> '' THEN ' (' || m || ')' ELSE '' END || chr(10) || substr(chunk_text, 1, 600)) AS passage
 FROM (SELECT *, concat_ws(' | ', nullif(geography, ''), nullif(date_published, '')) AS m FROM {_TEXTS})""")
def passage_render(spark: SparkSession, d: str) -> DataFrame:
    """Each chunk as a search tool shows it; its hash."""
    c = F.col
    return _texts(spark, d).select("chunk_id", F.md5(X.passage(c("chunk_index") + 1, c("source_filename"), c("geography"), c("date_published"), c("chunk_text"))).alias("passage"))


@query("SELECT item_id, 'Input: ' || question || chr(10) || 'Output: ' || ground_truth || chr(10) AS block FROM eval_items")
def few_shot_block(spark: SparkSession, d: str) -> DataFrame:
    """Examples of a prompt, one block each."""
    return table(spark, d, "eval_items").select("item_id", X.example(F.col("question"), F.col("ground_truth")).alias("block"))


@query(f"SELECT chunk_id FROM {A.CHUNKS} ORDER BY source_filename, chunk_index, chunk_id LIMIT 500")
def first_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The chunks of a run that may take 500 at most."""
    return A.chunks(spark, d).orderBy("source_filename", "chunk_index", "chunk_id").limit(500).select("chunk_id")


_PAGE = """'<p><a class="x" href="' || url || '">t</a><a href="mailto:a@b.example">m</a><a href="/about">u</a><a href="next.html">v</a><a href="#top">w</a></p>'"""


@query(rf"""SELECT ord, array_to_string([url, regexp_extract(url, '^([a-z]+://[^/?#]*)', 1) || '/about', regexp_replace(url, '[^/]*$', '') || 'next.html'], ' ') AS links FROM {A.CANDIDATES}""")
def html_links(spark: SparkSession, d: str) -> DataFrame:
    html = F.concat(F.lit('<p><a class="x" href="'), "url", F.lit('">t</a><a href="mailto:a@b.example">m</a><a href="/about">u</a><a href="next.html">v</a><a href="#top">w</a></p>'))
    return A.candidates(spark, d).select("ord", F.array_join(X.links(html, F.col("url")), " ").alias("links"))


@query(f"""SELECT source_chunk_id, kind, name, min(ord) AS place FROM (SELECT source_chunk_id, 'actor' AS kind, trim(text) AS name, row_number() OVER (PARTITION BY source_chunk_id ORDER BY ord) * 2 - 1 AS ord FROM {A.MENTIONS} WHERE label IN ('PERSON', 'ORG', 'GROUP') AND NOT contains(text, ']')
 UNION ALL SELECT source_chunk_id, 'source', source_chunk_id, row_number() OVER (PARTITION BY source_chunk_id ORDER BY ord) * 2 - 2 FROM {A.MENTIONS} WHERE label IN ('PERSON', 'ORG', 'GROUP') AND NOT contains(text, ']')) WHERE name <> '' GROUP BY ALL""")
def tool_output_parse(spark: SparkSession, d: str) -> DataFrame:
    """Tool output, a source line and an actor line for each mention, rendered and parsed back in order of appearance."""
    line = F.concat(F.lit("Source: "), "source_chunk_id", F.lit(" (x | y)\n["), "label", F.lit("] "), "text")
    rows = A.mentions(spark, d).where(F.col("label").isin("PERSON", "ORG", "GROUP") & ~F.contains("text", F.lit("]")))
    output = rows.groupBy("source_chunk_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("output"))
    return store.parsed_output(output, "source_chunk_id", "output").select("source_chunk_id", "kind", "name", F.col("place").cast("long").alias("place"))


@query("SELECT filename, lower(regexp_extract(filename, '\\.([^.]*)$', 1)) AS suffix FROM (SELECT DISTINCT filename FROM source_register) WHERE lower(regexp_extract(filename, '\\.([^.]*)$', 1)) IN ('pdf', 'html', 'htm', 'docx', 'txt', 'md')".replace("\\\\", "\\"))
def corpus_scan_filter(spark: SparkSession, d: str) -> DataFrame:
    return store.readable_files(table(spark, d, "source_register").select("filename").distinct(), "filename")


@query(f"SELECT chunk_id, CASE WHEN chunk_index % 3 = 0 THEN 'new' ELSE 'old' END AS version FROM {A.CHUNKS}")
def upsert_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = A.chunks(spark, d)
    old = rows.select("chunk_id", F.lit("old").alias("version"))
    return store.upsert(old, rows.where("chunk_index % 3 = 0").select("chunk_id", F.lit("new").alias("version")), ["chunk_id"])


@query("SELECT doc_id, coalesce(doc_type, 'report') AS doc_type, coalesce(geography, '') AS geography, 'doc_' || doc_id || '.txt' AS source_filename FROM documents")
def load_documents(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.coalesce("doc_type", F.lit("report")).alias("doc_type"), F.coalesce("geography", F.lit("")).alias("geography"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("source_filename"))


@query(f"SELECT m.ord, coalesce(g.n, 0) AS chars, CASE WHEN g.n IS NULL THEN 'missing' ELSE 'found' END AS state FROM {A.MENTIONS} m LEFT JOIN (SELECT chunk_id, max(length(chunk_text)) AS n FROM ner_gold GROUP BY 1) g ON g.chunk_id = source_chunk_id")
def chunk_lookup(spark: SparkSession, d: str) -> DataFrame:
    texts = A.gold(spark, d).groupBy("chunk_id").agg(F.max(F.length("chunk_text")).alias("n"))
    rows = A.mentions(spark, d).join(texts, F.col("source_chunk_id") == F.col("chunk_id"), "left")
    return rows.select("ord", F.coalesce("n", F.lit(0)).alias("chars"), F.when(F.col("n").isNull(), "missing").otherwise("found").alias("state"))
