"""Engine facade: one project's tables and the verbs over them."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import agents
from quillstone.functions import exprs as X
from quillstone.operators import chunking, evidence, extraction, graph, metrics, silence, store
from quillstone.operators import vectors as V
from quillstone.providers import Embedder, ExtractiveModel, HashEmbedder, LanguageModel
from quillstone.session import cut
from quillstone.sources import connectors, files, sinks


class Engine:
    """All tables of a project live under ``{root}/{project}``; every verb returns a DataFrame unless it says otherwise."""

    def __init__(self, spark: SparkSession, root: str, project: str, embedder: Embedder | None = None) -> None:
        self.spark, self.home = spark, f"{root}/{re.sub('[^a-z0-9]+', '_', project.lower()).strip('_')[:48]}"
        self.embedder = embedder or HashEmbedder()

    def _path(self, name: str) -> str:
        return f"{self.home}/{name}"

    def table(self, name: str) -> DataFrame:
        return sinks.read(self.spark, self._path(name))

    def save(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        return sinks.upsert(self.spark, rows, self._path(name), keys)

    # ingest
    def ingest(self, folder: str, **metadata: str) -> DataFrame:
        docs = files.load_corpus(self.spark, folder, **metadata).where("text is not null")
        pieces = chunking.recursive(docs, "path", "text").join(docs.drop("text", "error", "suffix"), "path")
        chunks = pieces.select(X.chunk_id(F.col("source_filename"), F.col("pos")).alias("chunk_id"), "source_filename", "source_url", "doc_type", "language", "date_published", "geography", F.col("pos").alias("chunk_index"), F.col("chunk").alias("text"))
        self.save("chunks", self._embedded(chunks), ["chunk_id"])
        return self.table("chunks")

    def _embedded(self, chunks: DataFrame) -> DataFrame:
        embedder = self.embedder

        @F.pandas_udf("array<float>")
        def embed(s):  # noqa: ANN001, ANN202
            import pandas as pd

            return pd.Series(list(embedder.embed(s.fillna("").tolist())))

        return chunks.withColumn("embedding", embed("text"))

    # extract
    def extract(self) -> dict[str, int]:
        """Run the three extractions once and store them; versions by table."""
        chunks = self.table("chunks").select("chunk_id", "text")
        ordered = lambda df: df.withColumn("ord", F.xxhash64(*df.columns))
        return {name: self.save(name, ordered(f(chunks, "chunk_id", "text")), ["ord"]) for name, f in (("mentions", extraction.entities), ("triples", extraction.relations), ("events", extraction.events))}

    def resolve(self, threshold: float = 72.0, cosine: float = 0.88) -> DataFrame:
        """Entities of one label joined where their names are near in meaning or in spelling."""
        exact = self.table("mentions").groupBy("label", F.lower(F.trim("text")).alias("key")).agg(F.max_by("text", F.struct(F.length("text"), "text")).alias("canonical_text"), F.collect_set("text").alias("names"), F.count(F.lit(1)).alias("occurrences"), X.mean(F.col("confidence")).alias("mean_confidence"))
        registry = cut(exact.select(X.canonical_id(F.col("label"), F.col("canonical_text")).alias("canonical_id"), "canonical_text", "label", F.array_remove("names", F.col("canonical_text")).alias("aliases"), "occurrences", "mean_confidence"))
        merged = silence.resolved_entities(registry, silence.entity_links(registry, self.embedder, cosine, threshold))
        merged = merged.select(X.canonical_id(F.col("label"), F.col("canonical_text")).alias("canonical_id"), "canonical_text", "label", F.array_sort(F.array_remove("names", F.col("canonical_text"))).alias("aliases"), "occurrences", "mean_confidence")
        self.save("registry", merged, ["canonical_id"])
        return self.table("registry")

    # graph
    def _edges(self, min_confidence: float = 0.5) -> DataFrame:
        return graph.edges(self.table("triples"), self.table("registry"), min_confidence)

    def graph_query(self, question: str, hops: int = 2, at: str | None = None) -> DataFrame:
        edges = self._edges()
        return graph.context(edges, graph.nodes(self.table("registry"), edges), question, hops, at)

    def network(self) -> DataFrame:
        edges = self._edges()
        return graph.degrees(edges).join(graph.betweenness(edges), "id").join(graph.communities(edges), "id", "left")

    def find_entity(self, name: str) -> DataFrame:
        return evidence.search_registry(self.table("registry"), name, 5)

    # retrieve
    def search(self, question: str, top_k: int = 8, top_n: int = 3, weight: float = 0.5) -> DataFrame:
        """The question's passages: nearest, made diverse, reranked by shared words."""
        vector = self.embedder.embed([question])[0].tolist()
        chunks = self.table("chunks")
        ask = self.spark.createDataFrame([("?", vector)], "chunk_id string, embedding array<float>")
        chosen = V.mmr(V.top_k(ask, chunks, "chunk_id", "embedding", 2 * top_k, with_vectors=True), top_k, weight)
        rows = chunks.join(chosen.select(F.col("key").alias("chunk_id"), F.col("pick").alias("ord")), "chunk_id").withColumn("one", F.lit(1))
        return silence.rerank(rows, sorted(set(re.findall(r"\w+", question.lower()))), "text", "one", top_n).select("chunk_id", "source_filename", "geography", "date_published", "text", "score", "rank")

    def ask(self, question: str, model: LanguageModel | None = None, top_k: int = 8, top_n: int = 3, at: str | None = None) -> dict[str, object]:
        """Answer with its sources, the share of them it cites, the passages, and the graph's facts beside them."""
        passages = self.search(question, top_k, top_n)
        rows = passages.orderBy("rank").collect()  # at most top_n
        found = agents.answer(question, [r.asDict() for r in rows], model or ExtractiveModel())
        return found | {"passages": passages, "graph": self.graph_query(question, 2, at)}

    # analyse
    def contradictions(self, threshold: float = 0.65, max_pairs: int = 100) -> DataFrame:
        pairs = evidence.to_verify(self.table("events"), self.table("triples"), max_pairs)
        texts = self.table("chunks").select("chunk_id", F.col("text").alias("chunk_text"))
        return extraction.verified(evidence.all_claims(pairs, self.table("events"), self.table("triples"), texts), threshold)

    def silence(self, reference: DataFrame, include_empty: bool = False) -> DataFrame:
        """Gaps against a reference grid (place, quarter, intensity)."""
        return silence.gaps(silence.density(self.table("chunks")), reference, include_empty).orderBy(F.desc("score"))

    def corpus_stats(self) -> DataFrame:
        kinds = F.inline(F.array(*[F.struct(F.lit(c).alias("kind"), F.coalesce(F.nullif(F.substring(c, 1, 4) if c == "date_published" else F.col(c), F.lit("")), F.lit("unknown")).alias("value")) for c in ("geography", "date_published", "doc_type", "language")]))
        return self.table("chunks").select(kinds).groupBy("kind", "value").agg(F.count(F.lit(1)).alias("chunks"))

    def evaluate(self, gold: DataFrame) -> DataFrame:
        """Macro scores against gold rows (chunk_id, label, text)."""
        return metrics.macro(metrics.per_chunk(gold, self.table("mentions").select(F.col("source_chunk_id").alias("chunk_id"), "label", "text")))

    # discover
    def discover(self, payloads: dict[str, DataFrame], entities: list[str], register_csv: str, min_relevance: float = 0.4) -> DataFrame:
        found = connectors.discovered(payloads, entities).where(F.col("relevance_score") >= min_relevance)
        fresh = found.join(files.known_urls(files.register(self.spark, register_csv)), "url", "left_anti")
        return fresh.groupBy("url").agg(F.max_by(F.struct("title", "date", "snippet", "source", "trigger_entity", "relevance_score"), "relevance_score").alias("d")).select("url", "d.*").orderBy(F.desc("relevance_score"), "url")

    # export
    def export(self, folder: str) -> dict[str, str]:
        tables = {n: self.table(n) for n in ("mentions", "triples", "events", "registry") if sinks.current(self.spark, self._path(n)) >= 0}
        if {"events", "mentions"} <= tables.keys() and "location" in tables["events"].columns:
            tables["geojson"] = sinks.geojson(tables["events"], tables["mentions"])
        if "events" in tables and "location" in tables["events"].columns:
            tables["silences"] = silence.export_rows(silence.gaps(silence.density(self.table("chunks")), silence.grid(tables["events"])))
        return sinks.export_all(tables | {"corpus_stats": self.corpus_stats()}, folder)

    # fetch
    def fetch(self, found: DataFrame, head: Callable[[str], str | None], page: Callable[[str], str | None], body: Callable[[str], bytes], corpus: str, register_csv: str, geography: str = "", min_relevance: float = 0.5, max_docs: int = 100, licence: str | None = None) -> DataFrame:
        """Fetch what was found: choose, route by content type, read pages and files, chunk, store, register; one row of totals.

        Report files are written to ``corpus`` and read from there; pages become text at once.
        """
        known = files.known_urls(files.register(self.spark, register_csv))
        above = found.where(F.col("relevance_score") >= min_relevance).join(known, "url", "left_anti")
        pick = cut(connectors.content_types(above.orderBy(F.desc("relevance_score"), "url").limit(max_docs), head).withColumn("filename", X.safe_filename(F.col("url"), F.col("title"), F.col("source"))).withColumn("route", X.route(F.col("url"), F.col("content_type"))))
        pages = connectors.fetched(pick.where("route = 'page'").select("url"), page).where("payload is not null").select("url", X.page_text(F.col("payload")).alias("text"))
        saved = connectors.downloaded(pick.where("route = 'download'"), body, corpus).where("path is not null").select("url", "path")
        read = files.load_files(saved).select("url", "text")
        texts = cut(pick.join(pages.unionByName(read), "url").where("text <> ''"))
        pieces = chunking.recursive(texts.select("url", "text"), "url", "text").join(texts.drop("text"), "url")
        chunks = pieces.select(X.chunk_id(F.col("filename"), F.col("pos")).alias("chunk_id"), F.col("filename").alias("source_filename"), F.col("url").alias("source_url"), F.lit("report").alias("doc_type"), F.lit("en").alias("language"), F.col("date").alias("date_published"), F.lit(geography).alias("geography"), F.col("pos").alias("chunk_index"), F.col("chunk").alias("text"))
        if not texts.isEmpty():
            self.save("chunks", self._embedded(chunks), ["chunk_id"])
            rows = texts.select("filename", F.col("url").alias("source_url"), F.current_date().cast("string").alias("date_accessed"), (F.lit(licence) if licence else X.licence(F.col("source"))).alias("licence"), F.lit(geography).alias("geography"), F.concat(F.lit("auto-fetched from "), "source", F.lit(" | "), F.substr("title", F.lit(1), F.lit(80))).alias("notes"))
            sinks.append_register(rows, register_csv)
        counts = pick.select("url").join(pieces.groupBy("url").agg(F.count(F.lit(1)).alias("chunks")), "url", "left").select(F.coalesce("chunks", F.lit(0)).alias("chunks"))
        return connectors.fetch_totals(found, above, counts)

    def wipe(self, *names: str) -> None:
        for name in names or ("",):
            sinks.delete(self.spark, self._path(name) if name else self.home)

    def context(self, question: str) -> DataFrame:
        rows = self.search(question).withColumn("one", F.lit(1))
        return store.context_blocks(rows, "one", "rank", "text", 10)
