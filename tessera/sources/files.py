"""Directory scans, raw storage and review files."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.functions.text import suffix
from tessera.schemas import CONTENT_TYPES, MAX_BYTES, OCTETS, SAMPLE, SUFFIXES, TYPE_SUFFIXES

#: Files by the endings that are known, in any case
GLOB = "*{" + ",".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in s) for s in SUFFIXES) + "}"

FILES = "path string, modificationTime timestamp, length bigint, content binary"


def scan_directory(spark: SparkSession, directory: str) -> DataFrame:
    """Files below a directory with a known suffix; others are not opened. ``in_order`` has their order."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", GLOB).load(directory)


def in_order(files: DataFrame) -> DataFrame:
    """path and length in the order of the path's parts; no content is read."""
    return files.select("path", "length").orderBy(F.split("path", "/"))


def collect_files(files: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """A collection row per file; one over the limit is not read and has an error, the others go on."""
    fits = files.where(F.col("length") <= max_bytes).select("path", "content", F.lit(None).cast("string").alias("error"))
    over = files.where(F.col("length") > max_bytes).select("path", F.lit(None).cast("binary").alias("content"), F.lit(f"File exceeds {max_bytes} bytes").alias("error"))
    kinds = F.create_map(*[F.lit(x) for pair in CONTENT_TYPES.items() for x in pair])
    return fits.union(over).select(
        F.col("path").alias("source_url"),
        F.col("path").alias("final_url"),
        F.coalesce(F.element_at(kinds, suffix(F.col("path"))), F.lit(OCTETS)).alias("content_type"),
        F.lit(None).cast("int").alias("http_status"),
        F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("title"),
        F.lit(True).alias("local_source"),
        "content",
        "error",
    )


def storage_suffix(content_type: Column, url: Column) -> Column:
    """By the content type before ``;`` (not trimmed), else the raw url's known ending, else .bin."""
    kinds = F.create_map(*[F.lit(x) for pair in TYPE_SUFFIXES.items() for x in pair])
    known = F.element_at(kinds, F.lower(F.substring_index(content_type, ";", 1)))
    ending = suffix(url)
    return F.coalesce(known, F.when(ending.isin(*SUFFIXES), ending), F.lit(".bin"))


def write_raw(rows: DataFrame, path: str) -> None:
    """Content-addressed bytes: one row per sha256, under the hash's first two digits; what is there already is not written again."""
    once = rows.select("sha256", "suffix", "content", F.substring("sha256", 1, 2).alias("prefix"))
    try:
        known = rows.sparkSession.read.schema("sha256 string, prefix string").parquet(path)
        once = once.join(known, ["prefix", "sha256"], "left_anti")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    once.dropDuplicates(["sha256"]).select("sha256", "suffix", "content", "prefix").write.mode("append").partitionBy("prefix").parquet(path)


def read_decisions(spark: SparkSession, path: str) -> DataFrame:
    """file, line_no (from 1 in each file, blank lines counted) and line of review files of any size.

    A file's splits are read each in its own task. A line's number is its place in its split and the lines
    of the splits before, of which there is a row each.
    """
    place = {"file": F.col("_metadata.file_path"), "block": F.col("_metadata.file_block_start"), "at": F.monotonically_increasing_id()}
    rows = spark.read.text(path).select(F.col("value").alias("line"), *[c.alias(n) for n, c in place.items()])
    splits = rows.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    earlier = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    return rows.join(splits, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line_no"), "line")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation samples; absent evidence is an empty map."""
    rows = spark.read.schema(SAMPLE).json(path)
    empty = F.create_map().cast("map<string,string>")
    return rows.withColumn("expected_evidence", F.coalesce("expected_evidence", empty)).withColumn("final_review_status", F.coalesce("final_review_status", F.lit("pending_review")))


def write_review_lines(rows: DataFrame, path: str) -> None:
    """One JSON object per line with its nulls."""
    rows.write.option("ignoreNullFields", "false").json(path)


def flat(rows: DataFrame) -> DataFrame:
    """Nested columns as JSON text, for a table of plain cells."""
    nested = ("array", "map", "struct")
    return rows.select(*[F.to_json(c).alias(c) if kind.startswith(nested) else F.col(c) for c, kind in rows.dtypes])
