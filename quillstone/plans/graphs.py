"""Knowledge graph, command network and provenance graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone import adapters as A
from quillstone.operators import graph as G
from quillstone.operators.components import connected_components
from quillstone.plans.base import Plans
from quillstone.plans.scalars import COMMAND, DOMAIN
from quillstone.session import cut

plans = Plans()
query = plans.query

LOOKUP = f"""(SELECT name, min_by(canonical_id, struct_pack(r := -occurrences, i := canonical_id)) AS id, min_by(canonical_text, struct_pack(r := -occurrences, i := canonical_id)) AS shown, min_by(label, struct_pack(r := -occurrences, i := canonical_id)) AS type
 FROM (SELECT *, lower(unnest(list_distinct(list_concat([canonical_text], aliases)))) AS name FROM {A.REGISTRY}) GROUP BY name)"""
EDGES = f"""(SELECT t.ord, coalesce(s.id, substr(sha256(trim(lower(subject))), 1, 12)) AS source_id, coalesce(s.shown, subject) AS source_label, coalesce(s.type, 'UNKNOWN') AS source_type,
 coalesce(o.id, substr(sha256(trim(lower(object))), 1, 12)) AS target_id, coalesce(o.shown, object) AS target_label, coalesce(o.type, 'UNKNOWN') AS target_type, predicate, confidence, evidence, location, date AS valid_from, {COMMAND} AS is_command
 FROM {A.TRIPLES} t LEFT JOIN {LOOKUP} s ON s.name = lower(subject) LEFT JOIN {LOOKUP} o ON o.name = lower(object) WHERE confidence >= 0.5 AND subject IS NOT NULL AND object IS NOT NULL)"""
ENDS = f"(SELECT source_id AS id, source_label AS label, source_type AS type, ord FROM {EDGES} UNION ALL SELECT target_id, target_label, target_type, ord FROM {EDGES})"
NODES = f"""(SELECT canonical_id AS id, canonical_text AS label, label AS type, aliases FROM {A.REGISTRY} UNION ALL SELECT id, min_by(label, struct_pack(o := ord, l := label)), 'UNKNOWN', CAST([] AS VARCHAR[]) FROM {ENDS} WHERE type = 'UNKNOWN' AND id NOT IN (SELECT canonical_id FROM {A.REGISTRY}) GROUP BY id)"""
COLLAPSED = f"(SELECT source_id, target_id, max_by(predicate, ord) AS predicate, max_by(is_command, ord) AS is_command, max(ord) AS ord FROM {EDGES} GROUP BY 1, 2)"
LAST = f"(SELECT * FROM {EDGES} QUALIFY row_number() OVER (PARTITION BY source_id, target_id ORDER BY ord DESC) = 1)"
AT = "2012-06"
TOP = f"(SELECT canonical_text FROM {A.REGISTRY} WHERE label IN ('PERSON', 'ORG', 'GROUP') ORDER BY occurrences DESC, canonical_id LIMIT 1)"


SEEDED = "(contains(lower('Whom did ' || canonical_text || ' command?'), lower(label)) OR len(list_filter(aliases, lambda a: contains(lower('Whom did ' || canonical_text || ' command?'), lower(a)))) > 0)"


def _edges(spark: SparkSession, d: str) -> DataFrame:
    return G.edges(A.triples(spark, d), A.registry(spark, d))


def _graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges; the registry and the edges are planned once."""
    registry = cut(A.registry(spark, d))
    edges = cut(G.edges(A.triples(spark, d), registry))
    return G.nodes(registry, edges), edges


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return _graph(spark, d)[0]


def _question(spark: SparkSession, d: str) -> str:
    """A question about the actor mentioned most: one row."""
    top = A.registry(spark, d).where(F.col("label").isin("PERSON", "ORG", "GROUP")).orderBy(F.desc("occurrences"), "canonical_id").first()
    return f"Whom did {top[1] if top else 'nobody'} command?"


@query(f"SELECT ord, source_id, source_label, target_id, target_label FROM {EDGES}")
def registry_lookup_join(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("ord", "source_id", "source_label", "target_id", "target_label")


@query(f"SELECT id, label, type FROM {NODES}")
def kg_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("id", "label", "type")


@query(f"SELECT ord, source_id, target_id, predicate, confidence, valid_from, CAST(NULL AS VARCHAR) AS valid_to FROM {EDGES}")
def kg_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("ord", "source_id", "target_id", "predicate", "confidence", "valid_from", "valid_to")


@query(f"SELECT source_id, target_id, predicate, ord FROM {COLLAPSED}")
def kg_collapse(spark: SparkSession, d: str) -> DataFrame:
    return G.collapsed(_edges(spark, d)).select("source_id", "target_id", "predicate", "ord")


@query(f"SELECT id, label FROM {NODES}, {TOP} WHERE {SEEDED}")
def kg_seed_match(spark: SparkSession, d: str) -> DataFrame:
    return G.seeds(_nodes(spark, d), _question(spark, d)).select("id", "label")


@query(f"""WITH e AS MATERIALIZED (SELECT * FROM {LAST}), n AS MATERIALIZED (SELECT * FROM {NODES}), seed AS (SELECT id FROM n, {TOP} WHERE {SEEDED}),
 link AS (SELECT source_id AS u, target_id AS v FROM e UNION SELECT target_id, source_id FROM e), one AS (SELECT id FROM seed UNION SELECT v FROM link JOIN seed ON u = id), two AS (SELECT id FROM one UNION SELECT v FROM link JOIN one ON u = id)
 SELECT ord, source_label, predicate, target_label, valid_from, substr(evidence, 1, 120) AS evidence FROM e WHERE source_id IN (SELECT id FROM two) AND coalesce(nullif(valid_from, ''), '{AT}') <= '{AT}'""")
def kg_two_hop_at_date(spark: SparkSession, d: str) -> DataFrame:
    """What held at a date within two steps of the actor in question."""
    nodes, edges = _graph(spark, d)
    return G.context(edges, nodes, _question(spark, d), 2, AT)


_DATED = f"""(SELECT source_id AS id, ord, target_label, coalesce(predicate, '?') AS predicate, confidence, evidence, concat_ws(' | ', nullif(valid_from, ''), nullif(location, ''), CASE WHEN valid_from <> '' THEN 'valid from ' || valid_from END) AS meta FROM {LAST} WHERE coalesce(nullif(valid_from, ''), '{AT}') <= '{AT}')"""


@query(f"""SELECT id, 0 AS part, '-1' AS ord, '[' || type || '] ' || label AS line FROM {NODES} UNION ALL SELECT id, 1, '-1', '  Also known as: ' || array_to_string(aliases[1:5], ', ') FROM {NODES} WHERE len(aliases) > 0
 UNION ALL SELECT id, 2, lpad(CAST(ord AS VARCHAR), 20, '0'), '  → ' || predicate || ' → ' || target_label || CASE WHEN meta <> '' THEN ' (' || meta || ')' ELSE '' END || ' [conf=' || printf('%.2f', round(confidence * 100) / 100) || ']' FROM {_DATED}
 UNION ALL SELECT id, 3, lpad(CAST(ord AS VARCHAR), 20, '0'), '    Evidence: "' || substr(evidence, 1, 120) || '"' FROM {_DATED} WHERE evidence <> ''""")
def kg_prose(spark: SparkSession, d: str) -> DataFrame:
    """The graph at a date in lines for a model, for every node."""
    nodes, edges = _graph(spark, d)
    return G.prose(G.collapsed(edges), nodes, nodes, AT)


@query(f"SELECT id, count(*) FILTER (way = 'in') AS in_degree, count(*) FILTER (way = 'out') AS out_degree FROM (SELECT source_id AS id, 'out' AS way FROM {COLLAPSED} UNION ALL SELECT target_id, 'in' FROM {COLLAPSED}) GROUP BY id")
def network_degrees(spark: SparkSession, d: str) -> DataFrame:
    return G.degrees(_edges(spark, d))


@query(f"SELECT ord, source_label, target_label, predicate, is_command, substr(evidence, 1, 200) AS evidence FROM {EDGES}")
def network_edges(spark: SparkSession, d: str) -> DataFrame:
    return _edges(spark, d).select("ord", "source_label", "target_label", "predicate", "is_command", F.substr("evidence", F.lit(1), F.lit(200)).alias("evidence"))


@query(f"SELECT (SELECT count(DISTINCT id) FROM {ENDS}) AS nodes, (SELECT count(*) FROM {COLLAPSED}) AS edges, (SELECT count(*) FROM {EDGES} WHERE is_command) AS command_edges")
def network_totals(spark: SparkSession, d: str) -> DataFrame:
    return _totals(_edges(spark, d))


def _totals(rows: DataFrame) -> DataFrame:
    ends = rows.select(F.explode(F.array("source_id", "target_id")).alias("id")).agg(F.count_distinct("id").alias("nodes"))
    rest = rows.agg(F.count_distinct("source_id", "target_id").alias("edges"), F.count_if("is_command").alias("command_edges"))
    return ends.withColumn("k", F.lit(1)).join(rest.withColumn("k", F.lit(1)), "k").drop("k")


@query(f"SELECT source_id, target_id, predicate FROM {COLLAPSED} WHERE is_command")
def command_chain(spark: SparkSession, d: str) -> DataFrame:
    return G.collapsed(_edges(spark, d)).where("is_command").select("source_id", "target_id", "predicate")


@query()
def betweenness(spark: SparkSession, d: str) -> DataFrame:
    return G.betweenness(_edges(spark, d))


@query()
def key_actors(spark: SparkSession, d: str) -> DataFrame:
    """The ten most central actors, those with no centrality left out."""
    return G.betweenness(_edges(spark, d)).orderBy(F.desc("betweenness"), "id").limit(10).where("betweenness > 0")


@query()
def communities(spark: SparkSession, d: str) -> DataFrame:
    return G.communities(_edges(spark, d))


SPARSE = f"(SELECT DISTINCT least(source_id, target_id) AS a, greatest(source_id, target_id) AS b FROM {EDGES} WHERE source_id <> target_id AND predicate IN ('was part of', 'commanded'))"


@query(f"""WITH RECURSIVE e AS MATERIALIZED (SELECT a, b FROM {SPARSE} UNION SELECT b, a FROM {SPARSE}), r AS (SELECT DISTINCT a AS node, a AS reached FROM e UNION SELECT node, b FROM r JOIN e ON reached = a)
 SELECT node, min(reached) AS component FROM r GROUP BY node""")
def resolve_components(spark: SparkSession, d: str) -> DataFrame:
    """Connected groups of actors by membership and command."""
    rows = _edges(spark, d).where(F.col("predicate").isin("was part of", "commanded"))
    return connected_components(rows, "source_id", "target_id")


_PROV_NODES = f"""(SELECT type, label, count(*) AS hits, min(ord) AS first_seen FROM (SELECT ord, 'entity' AS type, trigger_entity AS label FROM {A.CANDIDATES} UNION ALL SELECT ord, 'url', url FROM {A.CANDIDATES} UNION ALL SELECT ord, 'domain', {DOMAIN} FROM {A.CANDIDATES}
 UNION ALL SELECT ord, 'source', source FROM {A.CANDIDATES}) WHERE label IS NOT NULL GROUP BY 1, 2)"""
_PROV_EDGES = f"""(SELECT DISTINCT 'entity::' || trigger_entity AS src, 'url::' || url AS dst, 'found' AS type FROM {A.CANDIDATES} WHERE trigger_entity IS NOT NULL UNION ALL SELECT DISTINCT 'url::' || url, 'domain::' || {DOMAIN}, 'hosted' FROM {A.CANDIDATES}
 UNION ALL SELECT DISTINCT 'source::' || source, 'url::' || url, 'via' FROM {A.CANDIDATES})"""


@query(f"SELECT type || '::' || label AS id, hits, first_seen FROM {_PROV_NODES}")
def prov_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.provenance(A.candidates(spark, d))[0].select("id", "hits", "first_seen")


@query(f"SELECT src, dst, type FROM {_PROV_EDGES}")
def prov_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.provenance(A.candidates(spark, d))[1]


@query(f"SELECT 'node' AS kind, type, count(*) AS n FROM {_PROV_NODES} GROUP BY type UNION ALL SELECT 'edge', type, count(*) FROM {_PROV_EDGES} GROUP BY type")
def prov_stats(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = G.provenance(A.candidates(spark, d))
    count = lambda df, kind: df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "type", "n")
    return count(nodes, "node").unionByName(count(edges, "edge"))


@query(f"SELECT type || '::' || label AS id, hits FROM {_PROV_NODES} ORDER BY hits DESC, id LIMIT 10")
def prov_top_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.provenance(A.candidates(spark, d))[0].orderBy(F.desc("hits"), "id").limit(10).select("id", "hits")


@query(f"SELECT dst AS id, count(*) AS parents, min(src) AS first_parent FROM {_PROV_EDGES} WHERE starts_with(dst, 'url::') GROUP BY dst")
def prov_parents(spark: SparkSession, d: str) -> DataFrame:
    edges = G.provenance(A.candidates(spark, d))[1].where("startswith(dst, 'url::')")
    return edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("parents"), F.min("src").alias("first_parent"))


_ESCAPED = lambda c: f"replace(replace(replace(replace({c}, '&', '&amp;'), chr(34), '&quot;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT 0 AS part, '<gexf version="1.3"><graph defaultedgetype="directed">' AS line UNION ALL SELECT 1, '<node id="' || id || '" label="' || {_ESCAPED('substr(label, 1, 80)')} || '"/>' FROM {NODES}
 UNION ALL SELECT 2, '<edge source="' || source_id || '" target="' || target_id || '" label="' || {_ESCAPED('predicate')} || '"/>' FROM {COLLAPSED} UNION ALL SELECT 3, '</graph></gexf>'""")
def gexf_export(spark: SparkSession, d: str) -> DataFrame:
    nodes, edges = _graph(spark, d)
    return G.gexf(nodes, G.collapsed(edges))


@query(f"SELECT id, coalesce(label, id) AS label, coalesce(nullif(type, 'UNKNOWN'), 'url') AS type, FALSE AS ingested FROM {NODES}")
def graph_feed_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d).select("id", F.coalesce("label", "id").alias("label"), F.coalesce(F.nullif("type", F.lit("UNKNOWN")), F.lit("url")).alias("type"), F.lit(False).alias("ingested"))


@query(f"SELECT source_id AS source, target_id AS target, predicate AS type FROM {COLLAPSED}")
def graph_feed_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.collapsed(_edges(spark, d)).select(F.col("source_id").alias("source"), F.col("target_id").alias("target"), F.col("predicate").alias("type"))


_FILE_ACTORS = f"(SELECT DISTINCT c.source_url AS url, m.text AS entity FROM {A.MENTIONS} m JOIN {A.CHUNKS} c ON c.chunk_id = m.source_chunk_id WHERE m.label IN ('PERSON', 'ORG', 'GROUP') AND c.source_url <> '')"
_LOG = f"""(SELECT 'seed_query' AS src_type, trigger_entity AS src, 'source' AS dst_type, source AS dst, 'queried' AS type FROM {A.CANDIDATES} UNION ALL SELECT 'source', source, 'url', url, 'returned' FROM {A.CANDIDATES}
 UNION ALL SELECT 'seed_query', trigger_entity, 'url', url, 'returned' FROM {A.CANDIDATES} UNION ALL SELECT 'url', url, 'entity', entity, 'triggered_by' FROM {_FILE_ACTORS}
 UNION ALL SELECT 'entity', trigger_entity, 'llm_query', 'search ' || lower(trigger_entity), 'triggered' FROM {A.CANDIDATES} WHERE source = 'manual' UNION ALL SELECT 'url', url, 'llm_query', 'search ' || lower(trigger_entity), 'generated' FROM {A.CANDIDATES} WHERE source = 'manual')"""


def _log(spark: SparkSession, d: str) -> DataFrame:
    candidates = A.candidates(spark, d)
    files = A.chunks(spark, d).where("source_url <> ''").select("chunk_id", F.col("source_url").alias("url"))
    actors = A.mentions(spark, d).where(F.col("label").isin("PERSON", "ORG", "GROUP")).join(files, F.col("source_chunk_id") == F.col("chunk_id")).select("url", F.col("text").alias("entity")).distinct()
    asked = candidates.where("source = 'manual'").select(F.concat(F.lit("search "), F.lower("trigger_entity")).alias("query"), F.col("trigger_entity").alias("entity"), "url")
    return G.search_log(candidates.select(F.col("trigger_entity").alias("query"), "source", "url"), actors, asked)


@query(f"SELECT type || '::' || label AS id, count(*) AS hits FROM (SELECT src_type AS type, src AS label FROM {_LOG} WHERE src IS NOT NULL AND dst IS NOT NULL UNION ALL SELECT dst_type, dst FROM {_LOG} WHERE src IS NOT NULL AND dst IS NOT NULL) GROUP BY 1")
def search_graph_nodes(spark: SparkSession, d: str) -> DataFrame:
    return G.search_graph(_log(spark, d))[0].select("id", "hits")


@query(f"SELECT DISTINCT src_type || '::' || src AS src, dst_type || '::' || dst AS dst, type FROM {_LOG} WHERE src IS NOT NULL AND dst IS NOT NULL")
def search_graph_edges(spark: SparkSession, d: str) -> DataFrame:
    return G.search_graph(_log(spark, d))[1]


@query(f"SELECT DISTINCT dst_type || '::' || dst AS id, src_type || '::' || src AS parent, type FROM {_LOG} WHERE dst_type = 'url' AND src IS NOT NULL AND dst IS NOT NULL")
def search_graph_parents(spark: SparkSession, d: str) -> DataFrame:
    """What led to each document: its direct parents."""
    return G.search_graph(_log(spark, d))[1].where("startswith(dst, 'url::')").select(F.col("dst").alias("id"), F.col("src").alias("parent"), "type")
