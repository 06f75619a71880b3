"""Tables written once to the folder that all executors share.

A staged table cuts the lineage: a lost executor costs the tasks that were running on it, not what
earlier jobs have computed, and what depends on how rows were dealt (partition numbers) stays as it is.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; in local mode without one, a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _own:
        _own["dir"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own["dir"]


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessera-staged/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
