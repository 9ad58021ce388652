"""Sinks: keyed upserts, the register, GeoJSON, graph files, result files, snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.operators import evidence, store


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def upsert(spark: SparkSession, rows: DataFrame, path: str, keys: Sequence[str]) -> int:
    """Merge rows into a versioned table and return the new version; earlier versions stay readable until they are vacuumed."""
    version = current(spark, path)
    merged = rows.dropDuplicates(list(keys)) if version < 0 else store.upsert(read(spark, path), rows, keys)
    merged.write.mode("overwrite").parquet(f"{path}/v={version + 1}")
    spark.createDataFrame([(version + 1,)], "version int").coalesce(1).write.mode("append").parquet(f"{path}/_log")
    return version + 1


def current(spark: SparkSession, path: str) -> int:
    return spark.read.parquet(f"{path}/_log").agg(F.max("version")).first()[0] if _exists(spark, f"{path}/_log") else -1


def read(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/v={current(spark, path)}")


def append_register(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").option("header", True).csv(path)


def geojson(events: DataFrame, mentions: DataFrame) -> DataFrame:
    """One feature a line; the geometry is null, as there is no geocoder."""
    rows = evidence.located_events(events, mentions)
    properties = F.struct("event_type", "date", "location", "perpetrator", "victim_group", "confidence", "source_chunk_id")
    return rows.select(F.to_json(F.struct(F.lit("Feature").alias("type"), F.lit(None).cast("string").alias("geometry"), properties.alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def export_all(tables: dict[str, DataFrame], folder: str) -> dict[str, str]:
    """Each table as JSON lines; name to path."""
    paths = {}
    for name, df in tables.items():
        paths[name] = f"{folder}/{name}"
        (df.write.mode("overwrite").text(paths[name]) if df.columns == ["value"] else df.write.mode("overwrite").json(paths[name]))
    return paths


def node_link(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Node-link JSON, one object a line."""
    node = nodes.select(F.to_json(F.struct(F.lit("node").alias("kind"), *nodes.columns)).alias("value"))
    return node.unionByName(edges.select(F.to_json(F.struct(F.lit("link").alias("kind"), *edges.columns)).alias("value")))


def append_log(rows: DataFrame, path: str) -> None:
    """Add rows to a JSONL log; earlier files of it are not touched."""
    rows.write.mode("append").json(path)
