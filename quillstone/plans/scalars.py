"""Scalar functions over the stored tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.functions import exprs as X
from quillstone.functions import fixed
from quillstone.plans.base import Plans

plans = Plans()
query = plans.query

_list = lambda values: "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"
DOMAIN = r"regexp_replace(regexp_extract(coalesce(url, ''), '^[a-z]+://([^/?#]*)', 1), '^www\.', '')"
TRUSTED = f"len(list_filter({_list(fixed.TRUSTED_HOSTS)}, lambda d: ends_with({DOMAIN}, d))) > 0"
PDF = r"regexp_matches(coalesce(url, ''), '(?i)\.pdf($|\?)')"
RELEVANCE = r"round(least(1.0, 0.4 + 0.2 * len(list_filter(regexp_split_to_array(lower(trim(trigger_entity)), '\s+'), lambda t: t <> '' AND contains(lower(title), t)))), 3)"
COMMAND = f"len(list_filter({_list(fixed.COMMAND_STEMS)}, lambda s: contains(lower(predicate), s))) > 0"


@query(f"SELECT ord, CAST({RELEVANCE} AS DOUBLE) AS relevance FROM {A.CANDIDATES}")
def relevance_score(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.relevance(F.col("trigger_entity"), F.col("title")).alias("relevance"))


@query(f"SELECT ord, CAST(round(least(1.0, relevance_score + CASE WHEN {TRUSTED} OR {PDF} THEN 0.2 ELSE 0 END), 3) AS DOUBLE) AS boosted FROM {A.CANDIDATES}")
def relevance_boost(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.boosted(F.col("relevance_score"), F.col("url")).alias("boosted"))


@query(f"SELECT ord, {DOMAIN} AS domain FROM {A.CANDIDATES}")
def url_domain(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.domain(F.col("url")).alias("domain"))


@query(f"SELECT ord, {TRUSTED} AS trusted FROM {A.CANDIDATES}")
def trusted_domain(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.trusted(F.col("url")).alias("trusted"))


@query(f"SELECT ord, {PDF} AS pdf FROM {A.CANDIDATES}")
def is_pdf(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.is_pdf(F.col("url")).alias("pdf"))


DOMAIN_STATS = f"(SELECT {DOMAIN} AS domain, count(*) AS attempts, count(*) FILTER (url IN (SELECT source_url FROM source_register WHERE source_url <> '')) AS hits FROM {A.CANDIDATES} GROUP BY 1)"


def domain_stats(spark: SparkSession, d: str) -> DataFrame:
    """Attempts and hits (already registered) by domain."""
    seen = A.known_urls(spark, d).withColumn("hit", F.lit(1))
    rows = A.candidates(spark, d).join(seen, "url", "left").withColumn("domain", X.domain(F.col("url")))
    return rows.groupBy("domain").agg(F.count(F.lit(1)).alias("attempts"), F.count("hit").alias("hits"))


@query(f"SELECT domain, CAST(CASE WHEN attempts = 0 THEN 0.5 ELSE round(hits / attempts, 3) END AS DOUBLE) AS score FROM {DOMAIN_STATS}")
def domain_score(spark: SparkSession, d: str) -> DataFrame:
    return domain_stats(spark, d).select("domain", X.ratio_or(F.col("hits"), F.col("attempts"), 0.5).alias("score"))


@query(f"""SELECT c.ord, CAST(round(greatest(0.0, least(1.0, 0.6 * relevance_score + 0.3 * coalesce(round(hits / attempts, 3), 0.5) + CASE WHEN {PDF} THEN 0.15 ELSE 0.0 END + CASE WHEN {TRUSTED} THEN 0.1 ELSE 0.0 END
 - 0.1 * (length(title) % 3))), 3) AS DOUBLE) AS priority FROM (SELECT *, {DOMAIN} AS host FROM {A.CANDIDATES}) c LEFT JOIN {DOMAIN_STATS} s ON host = s.domain""")
def frontier_priority(spark: SparkSession, d: str) -> DataFrame:
    stats = domain_score(spark, d)
    rows = A.candidates(spark, d).withColumn("host", X.domain(F.col("url")))
    return rows.join(stats, F.col("host") == F.col("domain"), "left").select("ord", X.frontier_priority(F.col("relevance_score"), F.col("score"), F.col("url"), F.length("title") % 3).alias("priority"))


@query(f"SELECT source, CAST(CASE WHEN count(*) = 0 THEN 1.0 ELSE round(count(*) FILTER (relevance_score >= 0.4) / count(*), 3) END AS DOUBLE) AS yield_rate FROM {A.CANDIDATES} GROUP BY source")
def template_yield(spark: SparkSession, d: str) -> DataFrame:
    rows = A.candidates(spark, d).groupBy("source").agg(F.count(F.lit(1)).alias("runs"), F.count_if(F.col("relevance_score") >= 0.4).alias("new"))
    return rows.select("source", X.ratio_or(F.col("new"), F.col("runs"), 1.0).alias("yield_rate"))


@query(f"SELECT ord, len(list_filter(string_split(trigger_entity, ' '), lambda a: length(a) > 2 AND contains(lower(title), lower(a)))) > 0 AND len(list_filter({_list(fixed.OFF_TOPIC)}, lambda b: contains(lower(title), b))) = 0 AS on_topic FROM {A.CANDIDATES}")
def query_on_topic(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.on_topic(F.col("title"), F.split("trigger_entity", " ")).alias("on_topic"))


@query(f"SELECT ord, length(trim(text)) >= 3 AND NOT list_contains({_list(fixed.STOP_WORDS)}, lower(trim(text))) AND NOT regexp_full_match(replace(trim(text), ' ', ''), '[0-9]+') AS plausible FROM {A.MENTIONS}")
def entity_plausible(spark: SparkSession, d: str) -> DataFrame:
    return A.mentions(spark, d).select("ord", X.plausible(F.col("text")).alias("plausible"))


@query(rf"SELECT ord, regexp_replace(substr(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), 1, 60), '^_+|_+$', '', 'g') || '_' || substr(sha256(url), 1, 8) || CASE WHEN source = 'gdelt' THEN '.html' ELSE '.pdf' END AS filename FROM {A.CANDIDATES}")
def safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.safe_filename(F.col("url"), F.col("title"), F.col("source")).alias("filename"))


@query(f"SELECT ord, CASE WHEN source IN ('openalex', 'semanticscholar', 'arxiv', 'internetarchive') THEN 'open-access' WHEN source = 'gdelt' THEN 'news' ELSE 'unknown' END AS licence FROM {A.CANDIDATES}")
def licence_lookup(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.licence(F.col("source")).alias("licence"))


@query(f"SELECT ord, substr(regexp_replace(regexp_replace(lower(title), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'), 1, 48) AS slug FROM {A.CANDIDATES}")
def project_slug(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.slug(F.col("title")).alias("slug"))


QUARTER = "CASE WHEN regexp_matches(date_published, '^[0-9]{4}.[0-9]{2}') THEN substr(date_published, 1, 4) || '-Q' || CAST(floor((CAST(substr(date_published, 6, 2) AS INT) - 1) / 3 + 1) AS INT) ELSE 'unknown' END"


@query(f"SELECT chunk_id, {QUARTER} AS quarter FROM {A.CHUNKS}")
def date_quarter(spark: SparkSession, d: str) -> DataFrame:
    return A.chunks(spark, d).select("chunk_id", X.quarter(F.col("date_published")).alias("quarter"))


@query(f"SELECT ord, coalesce(nullif(lower(trim(location)), ''), 'unknown') AS location_key, coalesce(nullif(substr(date, 1, 4), ''), 'unknown') AS year_key FROM {A.EVENTS}")
def contradiction_keys(spark: SparkSession, d: str) -> DataFrame:
    return A.events(spark, d).select("ord", X.location_key(F.col("location")).alias("location_key"), X.year_key(F.col("date")).alias("year_key"))


@query(f"SELECT ord, {COMMAND} AS is_command FROM {A.TRIPLES}")
def command_relation(spark: SparkSession, d: str) -> DataFrame:
    return A.triples(spark, d).select("ord", X.is_command(F.col("predicate")).alias("is_command"))


@query(f"""SELECT ord, substr(sha256(label || '::' || lower(text)), 1, 12) AS canonical_id, substr(sha256(trim(lower(text))), 1, 12) AS node_id, label || '::' || lower(trim(text)) AS export_key FROM {A.MENTIONS}""")
def stable_ids(spark: SparkSession, d: str) -> DataFrame:
    text, label = F.col("text"), F.col("label")
    return A.mentions(spark, d).select("ord", X.canonical_id(label, text).alias("canonical_id"), X.unresolved_id(text).alias("node_id"), F.concat(label, F.lit("::"), F.lower(F.trim(text))).alias("export_key"))


@query(f"SELECT chunk_id, substr(sha256(source_filename || '_' || chunk_index), 1, 16) AS made FROM {A.CHUNKS}")
def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    return A.chunks(spark, d).select("chunk_id", X.chunk_id(F.col("source_filename"), F.col("chunk_index")).alias("made"))


@query(f"SELECT ord, replace(replace(replace(replace(title, '&', '&amp;'), '\"', '&quot;'), '<', '&lt;'), '>', '&gt;') AS escaped FROM {A.CANDIDATES}")
def xml_escape(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.xml_escape(F.col("title")).alias("escaped"))


@query(f"SELECT ord, coalesce(nullif(date, ''), '2012-06') <= '2012-06' AS valid FROM {A.TRIPLES}")
def edge_valid_at(spark: SparkSession, d: str) -> DataFrame:
    return A.triples(spark, d).select("ord", X.valid_at(F.col("date"), F.lit(None).cast("string"), "2012-06").alias("valid"))


@query("SELECT doc_id, CAST(round(len(list_filter([1, 2, 3, 4], lambda i: contains(text || ' [Source ' || (doc_id % 4 + 1) || ']', '[Source ' || i || ']'))) / 4, 3) AS DOUBLE) AS confidence FROM documents WHERE text IS NOT NULL")
def citation_confidence(spark: SparkSession, d: str) -> DataFrame:
    rows = A.table(spark, d, "documents").where("text is not null")
    answer = F.concat("text", F.lit(" [Source "), (F.col("doc_id") % 4 + 1).cast("string"), F.lit("]"))
    return rows.select("doc_id", X.citation_confidence(answer, F.lit(4)).alias("confidence"))


@query(f"SELECT ord, CASE WHEN confidence > 0.7 AND round(1 - confidence, 4) < 0.3 THEN 'high-intensity event with little coverage' WHEN confidence > round(1 - confidence, 4) + 0.3 THEN 'notable gap between intensity and coverage' ELSE 'moderate gap' END AS reason FROM {A.EVENTS}")
def silence_reason(spark: SparkSession, d: str) -> DataFrame:
    return A.events(spark, d).select("ord", X.silence_reason(F.col("confidence"), F.round(1 - F.col("confidence"), 4)).alias("reason"))


@query(f"SELECT ord, CASE WHEN confidence >= 0.85 THEN 'excellent' WHEN confidence >= 0.7 THEN 'good' WHEN confidence >= 0.5 THEN 'fair' ELSE 'poor' END AS band FROM {A.TRIPLES}")
def judge_band(spark: SparkSession, d: str) -> DataFrame:
    return A.triples(spark, d).select("ord", X.judge_band(F.col("confidence")).alias("band"))


ENTITIES = ["records", "papers", "How", "testimony"]


@query(f"SELECT ord, coalesce(list_filter({_list(ENTITIES)}, lambda e: contains(lower(title), lower(e)))[1], 'records') AS trigger FROM {A.CANDIDATES}")
def trigger_entity(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.first_contained(ENTITIES, F.col("title")).alias("trigger"))


@query(f"SELECT ord, array_to_string(string_split(snippet, ' ')[1:40], ' ') AS abstract FROM {A.CANDIDATES} WHERE snippet IS NOT NULL")
def abstract_from_inverted_index(spark: SparkSession, d: str) -> DataFrame:
    """Snippets turned into an index from word to positions, and back."""
    rows = A.candidates(spark, d).where("snippet is not null").withColumn("w", F.split("snippet", " "))
    place = lambda word: F.filter(F.transform("w", lambda x, i: F.when(x == word, i)), lambda i: i.isNotNull())
    index = F.map_from_arrays(F.array_distinct("w"), F.transform(F.array_distinct("w"), place))
    return rows.select("ord", X.inverted_abstract(index).alias("abstract"))


@query(f"SELECT ord, CASE WHEN regexp_matches(date, '^[0-9]{{8}}') THEN substr(date, 1, 4) || '-' || substr(date, 5, 2) || '-' || substr(date, 7, 2) WHEN regexp_full_match(date, '[0-9]{{4}}') THEN date || '-01-01' ELSE substr(date, 1, 10) END AS iso FROM {A.CANDIDATES}")
def date_normalise(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", X.short_date(F.col("date")).alias("iso"))


@query(f"SELECT ord, substr(title, 1, 80) AS notes, substr(snippet, 1, 300) AS snippet, substr(title, 1, 120) AS evidence FROM {A.CANDIDATES}")
def field_truncation(spark: SparkSession, d: str) -> DataFrame:
    return A.candidates(spark, d).select("ord", F.substring("title", 1, 80).alias("notes"), F.substring("snippet", 1, 300).alias("snippet"), F.substring("title", 1, 120).alias("evidence"))


@query("""SELECT event_id, lpad(CAST(CAST(floor(event_id / 3600) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(CAST(floor(event_id % 3600 / 60) AS INT) AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') AS elapsed,
 repeat('#', CAST(user_id % 10 AS INT)) || repeat('.', 10 - CAST(user_id % 10 AS INT)) AS bar FROM events""")
def dashboard_scalars(spark: SparkSession, d: str) -> DataFrame:
    two = lambda c: F.lpad(c.cast("int").cast("string"), 2, "0")
    i = F.col("event_id")
    return A.table(spark, d, "events").select("event_id", F.concat_ws(":", two(F.floor(i / 3600)), two(F.floor(i % 3600 / 60)), two(i % 60)).alias("elapsed"), F.concat(F.expr("repeat('#', cast(user_id % 10 as int))"), F.expr("repeat('.', 10 - cast(user_id % 10 as int))")).alias("bar"))
