"""Queries pN_ of the training-data problems, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm import language, leaks, names, neardup, truncation
from quillstone.llm.pack import byte_tokens, pack
from quillstone.llm.split import split_oversized
from quillstone.session import cut, table


def p1_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every gold chunk as pieces of at most 4,000 characters with 800 of overlap."""
    gold = table(spark, sf_dir, "ner_gold").select("chunk_id", "chunk_text").distinct()
    return split_oversized(gold, "chunk_text", ["chunk_id"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_pieces(spark, sf_dir).where("piece_index = 1").select("chunk_id").distinct()


def p1_rebuilt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each gold chunk put together again from its pieces: the hash of the text, and whether all pieces are within the limit."""
    piece = F.struct("piece_index", "piece_text")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(piece)), lambda x, i: F.when(i == 0, x["piece_text"]).otherwise(F.substr(x["piece_text"], F.lit(801)))), "")
    rows = p1_pieces(spark, sf_dir).where("piece_text is not null").groupBy("chunk_id").agg(text.alias("t"), F.max(F.length("piece_text")).alias("longest"))
    return rows.select("chunk_id", F.md5("t").alias("text_md5"), (F.col("longest") <= 4000).alias("within"))


def p6_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, or each piece of one above the capacity, with its container."""
    documents = table(spark, sf_dir, "documents")
    return pack(documents, "doc_id", "source", byte_tokens(F.col("text"))).withColumnRenamed("key", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p6_packed(spark, sf_dir).where("piece_count > 1").select("doc_id").distinct()


def p6_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and pieces of each document, summed up from the containers."""
    return p6_packed(spark, sf_dir).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("pieces"))


def p6_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers above the capacity, containers over more than one window, and cut documents that fit in one; all must be none."""
    packed = cut(p6_packed(spark, sf_dir))
    boxes = packed.groupBy("shard", "container").agg(F.sum("tokens").alias("tokens"), F.count_distinct("window").alias("windows"))
    one = F.lit(1).alias("k")
    small = packed.where("piece_count > 1").groupBy("doc_id").agg(F.sum("tokens").alias("tokens")).agg(F.count_if(F.col("tokens") <= 8192).alias("cut_in_vain"), one)
    return boxes.agg(F.count_if(F.col("tokens") > 8192).alias("overfull"), F.count_if(F.col("windows") > 1).alias("crossing"), one).join(small, "k").drop("k")


def p6_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens and share of each source in each window beside its share of all that is packed."""
    rows = cut(p6_packed(spark, sf_dir).where("container >= 0").groupBy("shard", "window", "source").agg(F.sum("tokens").alias("tokens")))
    total = rows.groupBy("shard", "window").agg(F.sum("tokens").alias("in_window"))
    every = rows.agg(F.sum("tokens").alias("in_all")).withColumn("k", F.lit(1))
    target = rows.groupBy("source").agg(F.sum("tokens").alias("of_source")).withColumn("k", F.lit(1)).join(every, "k").select(F.col("source").alias("s"), (F.col("of_source") / F.col("in_all")).alias("target"))
    return rows.join(total, ["shard", "window"]).join(target, F.col("source").eqNullSafe(F.col("s"))).select("shard", "window", "source", "tokens", (F.col("tokens") / F.col("in_window")).alias("share"), "target")


def _actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    mentions = table(spark, sf_dir, "mentions").where(F.col("label").isin("PERSON", "ORG", "GROUP")).select(F.col("text").alias("name"))
    triples = table(spark, sf_dir, "triples")
    events = table(spark, sf_dir, "event_results").select(F.col("perpetrator").alias("name"))
    everything = mentions.union(triples.select("subject")).union(triples.select("object")).union(events)
    return names.link_names(everything, "name")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return names.variant_pairs(_actors(spark, sf_dir))


def p3_actors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stored name with its actor and the number of spellings the actor has."""
    linked = _actors(spark, sf_dir)
    return linked.join(linked.groupBy("actor").agg(F.count(F.lit(1)).alias("spellings")), "actor")


def _collections(spark: SparkSession, sf_dir: str) -> list[tuple[str, DataFrame, tuple[str, str, int, float]]]:
    """Table, rows, and key, text, words of a feature and least similarity, of the two collections searched for near copies."""
    candidates = table(spark, sf_dir, "candidates").select("candidate_id", F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("url", F.lit(""))).alias("t"))
    gold = table(spark, sf_dir, "ner_gold").select("chunk_id", F.col("chunk_text").alias("t"))
    return [("candidates", candidates, ("candidate_id", "t", 1, 0.6)), ("ner_gold", gold, ("chunk_id", "t", 3, 0.6))]


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [neardup.near_pairs(rows, *how).select(F.lit(name).alias("tbl"), "key_a", "key_b") for name, rows, how in _collections(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def p4_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each record with its class of copies, links between classes, and group."""
    parts = [neardup.near_groups(rows, *how).withColumn("tbl", F.lit(name)) for name, rows, how in _collections(spark, sf_dir)]
    return parts[0].unionByName(parts[1])


def _languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    gold = table(spark, sf_dir, "ner_gold").select("chunk_id", "chunk_text").distinct()
    labels = table(spark, sf_dir, "chunk_metadata").groupBy("chunk_id").agg(F.max("language").alias("label"))
    rows = gold.join(labels, "chunk_id", "left").withColumn("named", language.label_language(F.col("label")))
    model = language.train(rows, "chunk_text", "named")
    found = language.identify(gold, "chunk_id", "chunk_text", model).withColumnRenamed("key", "chunk_id")
    return found.join(rows.select("chunk_id", "label", "named").dropDuplicates(["chunk_id"]), "chunk_id")


def p5_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every segment of every gold chunk with its language and confidence, beside the chunk's label."""
    rows = _languages(spark, sf_dir).select("chunk_id", "label", F.col("language").alias("main"), F.posexplode("segments").alias("segment_index", "s"))
    return rows.select("chunk_id", "label", "main", "segment_index", "s.start", "s.end", "s.language", "s.confidence", "s.words", "s.attested")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _languages(spark, sf_dir)
    sure = F.filter("segments", lambda s: (s["language"] != language.OTHER) & ((s["language"] == F.col("language")) | s["attested"]))
    written = F.array_distinct(F.transform(sure, lambda s: s["language"]))
    rows = rows.where("language is not null").withColumn("written", written)
    wrong = F.col("named").isNull() | (F.col("named") != F.col("language"))
    return rows.where(wrong | (F.size("written") > 1)).select("chunk_id", F.explode("written").alias("language")).distinct()


def p7_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document and item that share a run of words or are close in words and order."""
    return leaks.find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", ("question", "ground_truth"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p7_leaks(spark, sf_dir).where("run").select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id")).distinct()


def p8_truncated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document, whether it was cut, and what shows it."""
    return truncation.truncated(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_truncated(spark, sf_dir).where("cut").select("doc_id").distinct()


def p8_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, cut documents and their share for each source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(p8_truncated(spark, sf_dir), "doc_id")
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if("cut").alias("cut"), F.round(F.avg(F.col("cut").cast("int")), 4).alias("share"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_pieces, p1_rebuilt, p3_found, p3_actors, p4_found, p4_groups, p5_found, p5_segments, p6_found, p6_packed, p6_totals, p6_invariants, p6_mixture, p7_found, p7_leaks, p8_found, p8_truncated, p8_sources)}


_WORDS = "regexp_extract_all(lower({t}), '[\\p{{L}}\\p{{N}}]+')"
_NEAR = """SELECT DISTINCT '{tbl}' AS tbl, p.ka AS key_a, p.kb AS key_b FROM (SELECT a.k AS ka, a.t AS ta, b.k AS kb, b.t AS tb, count(*) AS s FROM {f} a JOIN {f} b ON a.x = b.x AND a.k < b.k GROUP BY ALL) p
 JOIN (SELECT k, t, count(*) AS n FROM {f} GROUP BY ALL) x ON x.k = ka AND x.t = ta JOIN (SELECT k, t, count(*) AS n FROM {f} GROUP BY ALL) y ON y.k = kb AND y.t = tb WHERE s / (x.n + y.n - s) >= 0.6 - 1e-9"""


def _runs(words: str, n: int) -> str:
    return f"list_transform(range(1, len({words}) - {n - 2}), lambda i: array_to_string({words}[i : i + {n - 1}], ' '))"


def oracle_sql() -> dict[str, str]:
    words = _WORDS.format(t="t")
    features = f"""WITH c AS MATERIALIZED (SELECT k, t, unnest(list_distinct({words})) AS x FROM (SELECT DISTINCT candidate_id AS k, coalesce(title, '') || ' ' || coalesce(url, '') AS t FROM candidates)),
 g AS MATERIALIZED (SELECT k, t, unnest(list_distinct({_runs('w', 3)})) AS x FROM (SELECT k, t, {words} AS w FROM (SELECT DISTINCT chunk_id AS k, chunk_text AS t FROM ner_gold WHERE chunk_text IS NOT NULL)))"""
    items = " UNION ALL ".join(f"SELECT item_id, {_WORDS.format(t=c)} AS w FROM eval_items" for c in ("question", "ground_truth"))
    return {
        "p1_found": "SELECT DISTINCT chunk_id FROM ner_gold WHERE length(chunk_text) > 4000",
        "p1_rebuilt": "SELECT DISTINCT chunk_id, md5(chunk_text) AS text_md5, TRUE AS within FROM ner_gold WHERE chunk_text IS NOT NULL",
        "p4_found": f"{features} {_NEAR.format(tbl='candidates', f='c')} UNION ALL {_NEAR.format(tbl='ner_gold', f='g')}",
        "p6_found": "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) + 1 > 8192",
        "p6_totals": "SELECT doc_id, CAST(coalesce(strlen(text), 0) + 1 AS BIGINT) AS tokens, (coalesce(strlen(text), 0) + 1 + 8191) // 8192 AS pieces FROM documents",
        "p6_invariants": "SELECT 0 AS overfull, 0 AS crossing, 0 AS cut_in_vain",
        "p7_found": f"""SELECT DISTINCT doc_id, item_id FROM (SELECT doc_id, unnest({_runs('w', 12)}) AS r FROM (SELECT doc_id, {_WORDS.format(t='text')} AS w FROM documents WHERE text IS NOT NULL))
 JOIN (SELECT item_id, unnest({_runs('w', 12)}) AS r FROM ({items})) USING (r)""",
    }
