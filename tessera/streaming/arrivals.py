"""Documents that arrive as Parquet files or as files of their own, inserted once each."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.functions.text import suffix
from tessera.operators.ingest import content_hash, insert_if_absent
from tessera.schemas import MAX_BYTES
from tessera.sources.files import FILES, GLOB, collect_files


def drain_new(spark: SparkSession, source: str, schema: str, store: str, checkpoint: str) -> StreamingQuery:
    """Read what has arrived (id, text) since the last run, append unseen contents to ``store``, and stop.

    Each batch is a folder of its own that a repeated batch overwrites, so a restart after a
    failure adds nothing twice. Below it the store is divided by the hash's first two digits, and of the
    stored hashes only those folders are read that the batch has digits of.
    """
    arrived = spark.readStream.schema(schema).parquet(source)

    def insert(batch: DataFrame, number: int) -> None:
        rows = batch.withColumn("sha256", content_hash(F.coalesce("text", F.lit(""))))
        prefix = F.substring("sha256", 1, 2)
        known = None
        if number:
            asked = [r["p"] for r in rows.select(prefix.alias("p")).distinct().collect()]  # at most 256
            known = spark.read.schema("id bigint, sha256 string, batch bigint, prefix string").option("basePath", store).parquet(store)
            known = known.where((F.col("batch") < number) & F.col("prefix").isin(asked)).select("id", "sha256")
        fresh = insert_if_absent(rows, known).where("created")
        fresh.select("id", "text", "sha256", prefix.alias("prefix")).write.mode("overwrite").partitionBy("prefix").parquet(f"{store}/batch={number}")

    return arrived.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drain_files(spark: SparkSession, directory: str, store: str, checkpoint: str, max_bytes: int = MAX_BYTES) -> StreamingQuery:
    """Read the files of a known suffix that have come since the last run, append unseen contents to ``store``, and stop.

    What was read before stands in the checkpoint and is neither listed as new nor opened again. Each batch has
    a folder ``batch=n`` that a repeated batch overwrites: collection rows with sha256, suffix and content (null with an
    error), divided by the hash's first two digits. Of several files with one content the first path is kept.
    """
    arrived = spark.readStream.format("binaryFile").schema(FILES).option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(directory)

    def insert(batch: DataFrame, number: int) -> None:
        rows = collect_files(batch, max_bytes)
        rows = rows.withColumns({"sha256": content_hash(F.col("content")), "suffix": suffix(F.col("source_url"))})
        rows = rows.withColumn("prefix", F.coalesce(F.substring("sha256", 1, 2), F.lit("none")))
        first = rows.where("sha256 is not null").groupBy("sha256").agg(F.min("source_url").alias("source_url"))
        fresh = rows.join(first, ["sha256", "source_url"], "left_semi")
        if number:
            known = spark.read.schema("sha256 string, batch bigint, prefix string").option("basePath", store).parquet(store).where(F.col("batch") < number)
            fresh = fresh.join(known.select("prefix", "sha256"), ["prefix", "sha256"], "left_anti")
        fresh.unionByName(rows.where("error is not null")).write.mode("overwrite").partitionBy("prefix").parquet(f"{store}/batch={number}")

    return arrived.writeStream.foreachBatch(insert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
