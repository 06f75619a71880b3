"""Intermediate tables in the folder that all executors share, names that are free in a table, and the end of both."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.functions.staging import shared_dir, staged

__all__ = ["drop_staged", "free", "shared_dir", "staged"]


def free(df: DataFrame, name: str) -> str:
    """``_tessera_name``, with more underscores in front where the table has such a column."""
    name = f"_tessera_{name}"
    while name.lower() in map(str.lower, df.columns):
        name = f"_{name}"
    return name


def drop_staged(spark: SparkSession) -> None:
    """Delete every staged table of this application; results that still read them become invalid."""
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/tessera-staged")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
