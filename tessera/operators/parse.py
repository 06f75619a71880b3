"""Pending documents parsed by format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.staging import staged
from tessera.functions.text import or_missing, suffix, with_entry
from tessera.operators.html import decoded_text, html_parsed
from tessera.operators.ingest import history
from tessera.sources.tables import PART, PARTS, parts_of, read_table, replace_rows, stored_rows, update_rows


def parse_pending(docs: DataFrame) -> DataFrame:
    """Documents (id, raw_file_path, source_title, content bytes, parse_status) that are pending.

    Adds title, plain_text, pages and error; an error leaves the document pending. PDF and
    DOCX documents come as rows of pages and paragraphs (``assemble``), so here they
    are unsupported like any unknown ending.
    """
    return _parsed(docs.where("parse_status = 'pending'"), F.col("content"))


def _parsed(docs: DataFrame, content: Column) -> DataFrame:
    ending = suffix(docs["raw_file_path"])
    stem = F.regexp_extract("raw_file_path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    text = decoded_text(content)
    is_html, is_text = ending.isin(".html", ".htm"), ending == ".txt"
    out = docs.withColumns({"_text": text, "_stem": stem})
    out = out.withColumn("_html", html_parsed(F.when(is_html, F.col("_text"))))  # other rows give the parser nothing to do
    plain = F.when(is_html, F.col("_html.text")).when(is_text, F.col("_text"))
    title = F.when(is_html, F.coalesce("_html.title", "_stem")).when(is_text, F.col("_stem"))
    wrong = F.when(~is_html & ~is_text, F.concat(F.lit("Unsupported document type: "), ending)).when(F.col("_text").isNull(), "content is not valid UTF-8")
    out = out.withColumns({"plain_text": plain, "title": F.coalesce(or_missing(F.col("source_title")), title), "error": wrong})
    pages = F.array(F.struct(F.lit(1).alias("page_number"), F.col("plain_text").alias("text")))
    return out.withColumn("pages", F.when(F.col("error").isNull(), pages)).drop("_text", "_stem", "_html")


def parsed_state(parsed: DataFrame) -> DataFrame:
    """The document's next state: its text, title, state and what the parser says, merged into ``metadata``; an empty text is parsed too.

    ``metadata`` maps names to JSON text; other names stay. An error leaves the document as it is.
    """
    fine = F.col("error").isNull()
    none = F.create_map().cast("map<string,string>")
    old = F.coalesce("metadata", none) if "metadata" in parsed.columns else none
    said = F.to_json(F.struct(none.alias("metadata"), F.array().cast("array<string>").alias("warnings")))
    metadata = with_entry(parsed, "parsing", said)
    raw = F.col("raw_text") if "raw_text" in parsed.columns else F.lit(None).cast("string")
    return parsed.withColumns(
        {
            "raw_text": F.when(fine, F.col("plain_text")).otherwise(raw),
            "source_title": F.when(fine, F.col("title")).otherwise(F.col("source_title")),
            "metadata": F.when(fine, metadata).otherwise(old),
            "parse_status": F.when(fine, "parsed").otherwise(F.col("parse_status")),
            "to_status": F.when(fine, "parsed"),
        }
    )


def write_parsed(parsed: DataFrame, path: str, as_of: str, parts: int = PARTS) -> DataFrame:
    """Put the next state of what ``parse_pending`` has parsed into the stored table of documents that it read (``tables.write_table`` by id); the log rows, at ``as_of``.

    Documents with an error stay as they are; only folders with a parsed one are written.
    """
    spark = parsed.sparkSession
    columns = read_table(spark, path).columns
    moved = staged(parsed_state(parsed).where("to_status is not null").select(*columns, "to_status"), "parsed")
    replace_rows(moved, moved.withColumn("final_review_status", F.col("to_status")).select(*columns), path, "id", parts)
    return history(moved, "parsed", as_of)


def parse_stored(spark: SparkSession, path: str, as_of: str) -> DataFrame:
    """Parse what is pending in a stored table of documents (``tables.write_table`` by id) where it stands; the log rows, at ``as_of``.

    The result is that of ``write_parsed`` for all of ``parse_pending``, but no row leaves its folder.
    """
    moved = parsed_state(parse_pending(stored_rows(spark, path))).where("to_status is not null")
    kept = staged(moved.select("id", "data_type", "final_review_status", "to_status", PART), "parsed")  # the log, as the states before it go
    update_rows(spark, path, _next_state, parts_of(kept))
    return history(kept, "parsed", as_of)


def _next_state(docs: DataFrame) -> DataFrame:
    """All documents, what is pending and without an error in its next state, the others as they are."""
    pending = F.coalesce(F.col("parse_status") == "pending", F.lit(False))
    kept = docs.withColumn("_metadata", F.col("metadata")) if "metadata" in docs.columns else docs
    seen = _parsed(kept, F.when(pending, F.col("content")))  # the content of other documents is not looked at
    made = parsed_state(seen.withColumn("error", F.when(pending, F.col("error")).otherwise("not pending")))
    made = made.withColumn("final_review_status", F.coalesce("to_status", "final_review_status"))
    if "metadata" in docs.columns:
        made = made.withColumn("metadata", F.when(F.col("to_status").isNotNull(), F.col("metadata")).otherwise(F.col("_metadata")))
    return made.select(*docs.columns)


def report(parsed: DataFrame) -> DataFrame:
    return parsed.agg(F.count_if(F.col("error").isNull()).alias("parsed"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def errors(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("id", F.concat_ws(": ", F.col("id").cast("string"), "error").alias("message"))
