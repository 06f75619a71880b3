"""Tables that grow from run to run: a bucketed store of hashes, counts by runs, and rows written back by partitions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.staging import staged

BUCKETS, PARTS = 256, 256
PART = "part"
#: of tables that hold texts and the bytes they came from, which are there twice while folders are replaced
CODEC = "zstd"


# Documents by hash


def append_store(rows: DataFrame, table: str, buckets: int = BUCKETS, path: str | None = None) -> None:
    """Add documents (id, sha256, ...) to a table whose files are buckets of the hash, so that a join by hash reads each bucket where it is.

    ``path`` is where a table that is not there yet gets its files; else the warehouse has them.
    """
    writer = rows.repartition(buckets, "sha256").write.format("parquet").mode("append").bucketBy(buckets, "sha256").sortBy("sha256")
    (writer.option("path", path) if path else writer).saveAsTable(table)


def known_ids(new: DataFrame, store: DataFrame, buckets: int | None = None) -> DataFrame:
    """sha256 and known_id of those new hashes that the store has: if it has that many buckets they stay, and the new hashes go to them."""
    asked = new.select("sha256").distinct()
    asked = asked.repartition(buckets, "sha256") if buckets else asked
    return store.select("sha256", "id").join(asked.hint("shuffle_hash"), "sha256", "left_semi").groupBy("sha256").agg(F.min("id").alias("known_id"))


# Counts by hash


def add_counts(new: DataFrame, path: str, run: int) -> None:
    """The number of new documents of each hash, as that run's share; a repeated run replaces its own."""
    counts = new.where("sha256 is not null").groupBy("sha256").agg(F.count("*").alias("n"))
    counts.write.mode("overwrite").parquet(f"{path}/run={run}")


def hash_counts(spark: SparkSession, path: str) -> DataFrame:
    """sha256 and hash_count over all runs; no document is read."""
    return spark.read.schema("sha256 string, n bigint, run int").parquet(path).groupBy("sha256").agg(F.sum("n").alias("hash_count"))


def merge_runs(spark: SparkSession, path: str, fresh: str, run: int) -> None:
    """The sums of all runs as one run of a fresh path; the old one stays as it is, for whoever reads it, until the caller drops it."""
    hash_counts(spark, path).withColumnRenamed("hash_count", "n").write.mode("errorifexists").parquet(f"{fresh}/run={run}")


# Rows by key


def _part(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def write_table(rows: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """A new table whose rows are partitioned by their key's hash; a key's rows are in one folder, a large folder's in several files."""
    rows.withColumn(PART, _part(key, parts)).hint("rebalance", PART).write.option("compression", CODEC).partitionBy(PART).parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    return stored_rows(spark, path).drop(PART)


def stored_rows(spark: SparkSession, path: str) -> DataFrame:
    """A table's rows with the number of their folder."""
    return spark.read.parquet(path)


def replace_rows(keys: DataFrame, new: DataFrame, path: str, key: str, parts: int = PARTS) -> None:
    """All rows of the keys go, the new ones come; only the folders of those keys are read and written.

    The rows of the folders are staged first, so a run that fails on the way leaves the table as it was or finishes
    when it is repeated. A folder whose last rows go is deleted.
    """
    spark = new.sparkSession
    asked = keys.select(key).distinct().withColumn(PART, _part(key, parts))
    touched = parts_of(asked)
    if not touched:
        return
    stored = stored_rows(spark, path).where(F.col(PART).isin(touched))
    came = new.join(asked.select(key), key, "left_semi").withColumn(PART, _part(key, parts))
    rows = staged(stored.join(asked.select(key), key, "left_anti").unionByName(came.select(*stored.columns)), "written-back")
    left = set(parts_of(rows))
    rows.hint("rebalance", PART).write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)
    _delete(spark, [f"{path}/{PART}={p}" for p in touched if p not in left])


def update_rows(spark: SparkSession, path: str, change: Callable[[DataFrame], DataFrame], touched: list[int]) -> None:
    """``change`` gives the table's rows their next values, a row for a row and with the key as it is; only the touched folders are read and written.

    Rows stay in their folders, so nothing is shuffled or staged: each task writes what it has read to the same
    folders, which are put in place at the job's commit. A run that fails before leaves the table as it was.
    """
    if not touched:
        return
    stored = stored_rows(spark, path).where(F.col(PART).isin(touched))
    rows = change(stored).select(*stored.columns)
    rows.write.mode("overwrite").option("compression", CODEC).option("partitionOverwriteMode", "dynamic").partitionBy(PART).parquet(path)


def parts_of(rows: DataFrame) -> list[int]:
    """The folders of a table's rows; at most as many as there are parts."""
    return [r[PART] for r in rows.select(PART).distinct().collect()]


def exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return False
    return True


def _delete(spark: SparkSession, paths: Iterable[str]) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        folder = jvm.org.apache.hadoop.fs.Path(p)
        folder.getFileSystem(conf).delete(folder, True)
