"""Session helpers: reading tables, and cutting lineage in the folder the cluster shares."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use ``spark.checkpoint.dir`` of the session. Where it is unset, a temporary folder serves a local master (tests); on a cluster it is an error."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quillstone-")
    sc.setCheckpointDir(folder)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` in reliable storage, so that lost executors cost a re-read, not the lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores until no column of ``df`` has that name (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def fence(df: DataFrame) -> DataFrame:
    """The same rows; filters above are not rewritten into the expressions below.

    Without it a filter on the last of several columns that build on each other is pushed to the scan with every one of
    them written out in full, and the plan grows exponentially.
    """
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def spared(df: DataFrame, made: list[str]) -> dict[str, str]:
    """Names for the columns of ``df`` beside new columns ``made``: a column that clashes gets ``_in`` appended."""
    taken, out = {c.lower() for c in made}, {}
    for c in df.columns:
        name = c
        while name.lower() in taken:
            name += "_in"
        taken.add(name.lower())
        out[c] = name
    return out
