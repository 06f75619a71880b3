"""Shards by a two-pass external shuffle, in DataFrame functions only.

Which shard: rendezvous hashing. Each shard draws a seeded hash with the doc_id and
the largest wins, so that doc_id and the number of shards decide, and a further
shard only takes rows into itself (law ``key``).

First pass: every record is scattered by a seeded hash of its record number into one
of its shard's buckets and written to the shared folder. A shard has as many buckets of
about ``bucket_bytes`` as its measured bytes need, so a shard with a third of all rows has buckets like any
other; the record number makes them even whatever the texts or keys repeat.
Second pass: each bucket is a partition of its own, read as one array, put into record order
and shuffled by Spark's ``shuffle`` (Fisher-Yates), whose generator is seeded with the seed and the
partition's number, that is the bucket's. So the slots of a scattered table do not depend on the plan
or on repeated tasks. The sizes of the buckets before it, sent to the same partition as one more row,
give its first slot. There are at most ``most_buckets`` partitions; beyond that buckets grow.

Defined cases: a null text has size 8 and CRC 0 and stays null. Null doc_ids share a
shard. Repeated rows are records of their own, in the same shard. Empty tables give
an empty result. Extra columns are carried; names this module adds start with
``_tessera_`` but for those in its result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tessera.llm.staging import staged

SHARDS, SEED = 24, 20240229
BUCKET_BYTES, MOST_BUCKETS = 32 << 20, 100_000
LAW = "key"


def shard_of(doc_id: Column, n: int, seed: int = SEED) -> Column:
    """0 .. n - 1, by rendezvous hashing."""
    draws = F.array(*[F.xxhash64(doc_id, F.lit(s), F.lit(seed)) for s in range(n)])
    return (F.array_position(draws, F.array_max(draws)) - 1).cast("int")


def grown_shard_of(doc_id: Column, n: int, seed: int = SEED) -> Column:
    """Where the row is among n + 1 shards: where it was, or the new one."""
    return shard_of(doc_id, n + 1, seed)


def stored_size(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("bigint")


def shards(docs: DataFrame, n: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES, most_buckets: int = MOST_BUCKETS) -> DataFrame:
    """The documents, whole, as one struct column ``record``, with shard and slot (from 0, without gaps)."""
    shard = shard_of(docs["doc_id"], n, seed)
    sizes = docs.select(shard.alias("shard"), stored_size(docs["text"]).alias("size")).groupBy("shard").agg(F.sum("size").alias("size")).collect()  # a row per shard
    size = {r["shard"]: r["size"] for r in sizes}
    bucket_bytes = max(bucket_bytes, -(-sum(size.values()) // max(1, most_buckets - n)))
    each = [max(1, -(-size.get(k, 0) // bucket_bytes)) for k in range(n)]
    begins = [sum(each[:k]) for k in range(n)]
    number = F.monotonically_increasing_id()
    of_shard = lambda values: F.get(F.array(*map(F.lit, values)), F.col("shard"))
    scattered = docs.select(shard.alias("shard"), number.alias("number"), F.struct(*[docs[c] for c in docs.columns]).alias("record"))
    bucket = of_shard(begins) + F.pmod(F.xxhash64(F.lit(seed), "number"), of_shard(each))
    scattered = staged(scattered.select("shard", bucket.cast("int").alias("bucket"), "number", "record"), "scattered")
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    first = scattered.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    first = first.select("bucket", F.struct("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("slot")).alias("first"))
    told = scattered.select("bucket", F.struct("number", "record").alias("held")).unionByName(first, allowMissingColumns=True)
    held = told.repartitionById(sum(each), F.col("bucket")).groupBy("bucket").agg(F.collect_list("held").alias("held"), F.max("first").alias("first"))
    in_order = F.array_sort("held", lambda a, b: F.signum(a["number"] - b["number"]).cast("int"))
    placed = held.select("first", F.posexplode(F.shuffle(in_order, seed)).alias("place", "held"))
    return placed.select(F.col("first.shard").alias("shard"), (F.col("first.slot") + F.col("place")).alias("slot"), F.col("held.record").alias("record"))


def write_shards(placed: DataFrame, path: str) -> None:
    """One Parquet folder per shard, rows in the order of their slots."""
    placed.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


def digest(placed: DataFrame, n: int = SHARDS, seed: int = SEED) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, read from the placed records."""
    doc_id, text = F.col("record.doc_id"), F.col("record.text")
    return placed.select(
        doc_id.alias("doc_id"),
        stored_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast(T.BinaryType())).alias("text_crc32"),
        F.lit(LAW).alias("law"),
        "shard",
        F.col("slot").cast("bigint").alias("slot"),
        grown_shard_of(doc_id, n, seed).alias("grown_shard"),
    )
