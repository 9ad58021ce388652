"""Joins over extracted evidence: located events, registry search, contradiction candidates and their claims."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstone.functions import exprs as X
from quillstone.operators.pairs import pairs_within


def located_events(events: DataFrame, mentions: DataFrame) -> DataFrame:
    """Events with their own location or the first place mentioned in their chunk."""
    first = mentions.where("label = 'LOCATION'").groupBy(F.col("source_chunk_id").alias("chunk")).agg(F.min_by("text", "ord").alias("place"))
    rows = events.where("event_type <> 'no_event'").join(first, F.col("source_chunk_id") == F.col("chunk"), "left")
    return rows.withColumn("location", F.coalesce(F.nullif("location", F.lit("")), F.col("place"))).drop("chunk", "place")


def search_registry(registry: DataFrame, name: str, k: int) -> DataFrame:
    hit = F.contains(F.lower("canonical_text"), F.lit(name.lower())) | F.exists("aliases", lambda a: F.contains(F.lower(a), F.lit(name.lower())))
    return registry.where(hit).orderBy(F.desc("occurrences"), "canonical_id").limit(k)


def event_conflicts(events: DataFrame, with_unknown: bool = False) -> DataFrame:
    """Pairs of events of different type at one place in one year.

    Events without a place all share the key "unknown"; they are paired only on request, since that is no evidence of
    one event and grows with the square of the data.
    """
    rows = events.where("event_type <> 'no_event'").select("ord", "event_type", X.location_key(F.col("location")).alias("place"), X.year_key(F.col("date")).alias("year"))
    if not with_unknown:
        rows = rows.where("place <> 'unknown'")
    keyed = rows.select("ord", "event_type", F.concat_ws("\x1f", "place", "year").alias("key"))
    pairs = pairs_within(keyed, "key", "ord", (F.col("a_ord") < F.col("b_ord")) & (F.col("a_event_type") != F.col("b_event_type")))
    return pairs.select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def relation_conflicts(triples: DataFrame) -> DataFrame:
    """Pairs of triples on one subject and object with different predicates from different chunks."""
    rows = triples.where("subject is not null and object is not null").select("ord", "predicate", "source_chunk_id", F.concat_ws("\x1f", F.lower("subject"), F.lower("object")).alias("key"))
    where = (F.col("a_ord") < F.col("b_ord")) & (F.col("a_predicate") != F.col("b_predicate")) & (F.col("a_source_chunk_id") != F.col("b_source_chunk_id"))
    return pairs_within(rows, "key", "ord", where).select(F.col("a_ord").alias("a"), F.col("b_ord").alias("b"))


def assessed(events: DataFrame, triples: DataFrame, max_pairs: int) -> DataFrame:
    """The pairs a verifier is asked about: half the budget for each kind, in order of generation."""
    half = max_pairs // 2
    first = event_conflicts(events).orderBy("a", "b").limit(half).select(F.lit("event").alias("kind"), "a", "b")
    return first.unionByName(relation_conflicts(triples).orderBy("a", "b").limit(max_pairs - half).select(F.lit("relation").alias("kind"), "a", "b"))


def to_verify(events: DataFrame, triples: DataFrame, max_pairs: int) -> DataFrame:
    """The pairs a verification run takes: at most half the budget of events, and relations for all that is left of it."""
    first = event_conflicts(events).orderBy("a", "b").limit(max_pairs // 2).select(F.lit("event").alias("kind"), "a", "b")
    # Fewer than max_pairs of either kind are numbered, so one task holds them.
    number = F.row_number().over(Window.orderBy("a", "b"))
    rest = relation_conflicts(triples).orderBy("a", "b").limit(max_pairs).select(F.lit("relation").alias("kind"), "a", "b", number.alias("n"))
    used = first.agg(F.count(F.lit(1)).alias("used"))
    return first.unionByName(rest.crossJoin(used).where(F.col("n") <= max_pairs - F.col("used")).select("kind", "a", "b"))


def claims(pairs: DataFrame, events: DataFrame, texts: DataFrame, length: int = 500) -> DataFrame:
    """Pairs with the beginning of both chunks' texts."""
    text = texts.groupBy("chunk_id").agg(F.min("chunk_text").alias("chunk_text"))
    chunk = events.select(F.col("ord"), "source_chunk_id").join(text, F.col("source_chunk_id") == F.col("chunk_id"), "left").select("ord", F.coalesce(F.substr("chunk_text", F.lit(1), F.lit(length)), F.lit("not available")).alias("claim"))
    a, b = (chunk.select(F.col("ord").alias(c), F.col("claim").alias(f"claim_{c}")) for c in "ab")
    return pairs.join(a, "a").join(b, "b").select("kind", "a", "b", "claim_a", "claim_b")


def all_claims(pairs: DataFrame, events: DataFrame, triples: DataFrame, texts: DataFrame) -> DataFrame:
    """What the verifier is asked: for events 800 characters of both chunks, for relations the predicate before 400."""
    of_events = claims(pairs.where("kind = 'event'"), events, texts, 800)
    of_relations = claims(pairs.where("kind = 'relation'"), triples, texts, 400)
    for c in "ab":
        predicate = triples.select(F.col("ord").alias(c), F.coalesce("predicate", F.lit("")).alias("predicate"))
        of_relations = of_relations.join(predicate, c).withColumn(f"claim_{c}", F.concat(F.lit("[Relation predicate: '"), "predicate", F.lit("']\n"), f"claim_{c}")).drop("predicate")
    return of_events.unionByName(of_relations)
