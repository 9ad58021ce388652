"""Queries of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.plans.base import Plans
from quillstone.session import table
from quillstone.timestamps import fitted_orders, parsed

plans = Plans()


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct dated record of the four tables as (kind, name, tbl, row_key, value, zone_name, day_order).

    Each value is brought down to its place and group first, so that the parse plan exists once; the
    defaults table is fixed at 33 rows. A chunk's geography is looked up by a join on the chunk's key.
    """
    chunks = table(spark, sf_dir, "chunk_metadata").select("chunk_id", "date_published", "geography")
    place = chunks.groupBy("chunk_id").agg(F.max("geography").alias("geography"))

    def of_chunk(name: str, key: str) -> DataFrame:
        rows = table(spark, sf_dir, name).where("date is not null").select(F.col(key).cast("string").alias("row_key"), F.col("date").alias("value"), "source_chunk_id").distinct()
        return rows.join(place, rows["source_chunk_id"] == place["chunk_id"], "left").select(F.lit(name).alias("tbl"), "row_key", "value", F.lit("geography").alias("kind"), F.col("geography").alias("name"))

    candidates = table(spark, sf_dir, "candidates").where("date is not null").select(F.lit("candidates").alias("tbl"), F.col("candidate_id").alias("row_key"), F.col("date").alias("value"), F.lit("source").alias("kind"), F.col("source").alias("name")).distinct()
    published = chunks.where("date_published is not null").select(F.lit("chunk_metadata").alias("tbl"), F.col("chunk_id").alias("row_key"), F.col("date_published").alias("value"), F.lit("geography").alias("kind"), F.col("geography").alias("name")).distinct()
    rows = candidates.unionByName(published).unionByName(of_chunk("triples", "triple_id")).unionByName(of_chunk("event_results", "result_id"))
    defaults = table(spark, sf_dir, "zone_defaults").select(F.col("applies_to").alias("kind"), F.col("applies_value").alias("name"), "zone_name", "day_order").dropDuplicates(["kind", "name"])
    return rows.join(defaults, ["kind", "name"], "left")


def _group() -> Column:
    return F.concat_ws(":", "kind", "name")


@plans.query()
def p2_normalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct dated record: value, normal form, precision, posterior, ambiguous, other_day."""
    # Without a row of defaults the declared reading is UTC and day first.
    return parsed(_dated(spark, sf_dir), "value", F.coalesce("zone_name", F.lit("UTC")), F.coalesce("day_order", F.lit("dmy")), _group()).drop("kind", "zone_name", "day_order")


@plans.query()
def p2_undeclared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records read without any declared order: the mixture of each source alone decides, and what it can't decide is marked."""
    return parsed(_dated(spark, sf_dir), "value", F.coalesce("zone_name", F.lit("UTC")), F.lit(None).cast("string"), _group()).drop("kind", "zone_name", "day_order")


@plans.query()
def p2_unsourced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same records read as if neither order nor source were known: one mixture for each table, so that dates valid both ways stay ambiguous and keep both days."""
    return parsed(_dated(spark, sf_dir), "value", F.coalesce("zone_name", F.lit("UTC")), F.lit(None).cast("string"), F.col("tbl")).drop("kind", "zone_name", "day_order")


@plans.query()
def p2_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each source's fitted weight of day-first dates, without the declared order, which stands beside it."""
    rows = _dated(spark, sf_dir)
    declared = rows.groupBy(_group().alias("s")).agg(F.max("day_order").alias("day_order"))
    fitted = fitted_orders(rows, "value", F.lit(None).cast("string"), _group()).drop("declared")
    return fitted.join(declared, F.col("source").eqNullSafe(F.col("s"))).drop("s")


@plans.query()
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = p2_normalised(spark, sf_dir)
    return rows.where("normal_form is not null and normal_form <> value").select("tbl", "row_key", "normal_form").distinct()
