"""Content identity: hash, insert if absent, document rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.staging import staged
from tessera.sources.tables import known_ids

MOST_ROWS = 1_000_000


def content_hash(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def insert_if_absent(rows: DataFrame, store: DataFrame | None = None, buckets: int | None = None) -> DataFrame:
    """Rows (id, sha256, …) with document_id and created.

    The first row of a hash, by id, is created unless the store (id, sha256) has it; every
    other row gets the existing document's id. The first of a hash is a min, with partial
    sums before the shuffle, so that a hash with many rows is no large group. A store of as many ``buckets`` (``tables.append_store``) is not
    shuffled: the rows' hashes go to its buckets.
    """
    first = rows.groupBy("sha256").agg(F.min("id").alias("first_id"))
    if store is not None:
        first = first.join(known_ids(rows, store, buckets), "sha256", "left")
    else:
        first = first.withColumn("known_id", F.lit(None).cast("bigint"))
    out = rows.join(first, "sha256")
    created = F.col("known_id").isNull() & (F.col("id") == F.col("first_id"))
    return out.withColumns({"document_id": F.coalesce("known_id", "first_id"), "created": created}).drop("first_id", "known_id")


def document_rows(created: DataFrame) -> DataFrame:
    """Rows of new documents in their first states."""
    states = {"collection_status": "collected", "parse_status": "pending", "final_review_status": "collected", "knowledge_index_status": "not_indexed"}
    return created.where("created").withColumns({k: F.lit(v) for k, v in states.items()}).drop("created", "document_id")


def summary(rows: DataFrame) -> DataFrame:
    """created, duplicates, failed."""
    failed = F.col("error").isNotNull()
    return rows.agg(
        F.count_if(~failed & F.col("created")).alias("created"), F.count_if(~failed & ~F.col("created")).alias("duplicates"), F.count_if(failed).alias("failed")
    )


def transitions(events: DataFrame, key: tuple[str, ...] = ("record_id",), most_rows: int = MOST_ROWS) -> DataFrame:
    """Rows of a record (``key``) in order of ``seq``, to_status -> with from_status, the record's state before.

    ``current`` (if there) is the state before the first row. The rows of a record with up to ``most_rows`` meet in
    one task. Records with more, of which there are at most as many as the table has
    multiples of that, are sorted by range over all tasks; a range looks back within itself, and its first
    row gets the last state of the record's range before, of which there is a row each.
    """
    own, first = F.struct(*key).alias("_key"), F.col("current") if "current" in events.columns else F.lit(None).cast("string")
    counts = events.groupBy(own).agg(F.count("*").alias("_n"))
    if (counts.agg(F.max("_n")).first()[0] or 0) <= most_rows:
        before = F.lag("to_status").over(Window.partitionBy(*key).orderBy("seq"))
        return events.withColumn("from_status", F.coalesce(before, first))
    large = staged(counts.where(F.col("_n") > most_rows).select("_key"), "large-records")
    keyed = events.withColumn("_key", own)
    few, many = keyed.join(large, "_key", "left_anti"), keyed.join(large, "_key", "left_semi")
    before = F.lag("to_status").over(Window.partitionBy("_key").orderBy("seq"))
    return few.withColumn("from_status", F.coalesce(before, first)).unionByName(_by_ranges(many, first)).drop("_key")


def _by_ranges(events: DataFrame, first: Column) -> DataFrame:
    """The same with a record's rows (_key) over many tasks: a range of the sorted rows is a part."""
    parts = staged(events.repartitionByRange("_key", "seq").withColumn("_part", F.spark_partition_id()), "ranges")
    within = Window.partitionBy("_key", "_part").orderBy("seq")
    ends = parts.groupBy("_key", "_part").agg(F.max_by("to_status", "seq").alias("_end"))
    ends = ends.withColumn("_end", F.lag("_end").over(Window.partitionBy("_key").orderBy("_part")))
    rows = parts.withColumns({"_before": F.lag("to_status").over(within), "_nth": F.row_number().over(within)}).join(ends, ["_key", "_part"], "left")
    before = F.when(F.col("_nth") == 1, F.col("_end")).otherwise(F.col("_before"))
    return rows.withColumn("from_status", F.coalesce(before, first)).drop("_part", "_before", "_nth", "_end")


def history(rows: DataFrame, reason: str, as_of: str, to_status: str = "to_status", from_status: str = "final_review_status") -> DataFrame:
    """A log row for each document (id, data_type) with a next state, also where it is the old one; ``as_of`` is the caller's clock."""
    moved = rows.where(F.col(to_status).isNotNull())
    return moved.select(
        F.col("data_type").alias("record_type"),
        F.col("id").alias("record_id"),
        F.col(from_status).alias("from_status"),
        F.col(to_status).alias("to_status"),
        F.lit(reason).alias("reason"),
        F.lit(as_of).cast("timestamp").alias("changed_at"),
    )


def collection_history(created: DataFrame, as_of: str) -> DataFrame:
    """The first log rows of new documents; their state is set before it is logged, so from and to are one."""
    return history(created, "collection completed", as_of, "final_review_status")
