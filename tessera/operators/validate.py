"""Deterministic rules as column expressions, and the state they lead to.

A rule gets a document row and returns an issue or null. The record of the document, if
it has one, is the struct column ``record``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import or_missing, with_entry
from tessera.schemas import AUTOMATIC, ISSUE

#: Fixed values, as are the rules' names, codes and messages below
REQUIRED = ("raw_text", "sha256", "raw_file_path")
DATES = ("published_at", "effective_date", "expiry_date", "decision_date")


def issue(failed: Column, validator: str, code: str, message: str, field: str | None = None) -> Column:
    made = F.struct(F.lit(validator).alias("validator"), F.lit(code).alias("code"), F.lit(message).alias("message"), F.lit(field).cast("string").alias("field"))
    return F.when(F.coalesce(failed, F.lit(False)), made).cast(ISSUE)


def required(strict: bool = False) -> list[Column]:
    return [issue(or_missing(F.col(c)).isNull(), "RequiredFieldValidator", "required", f"{c} is required", c) for c in REQUIRED]


def source_url(strict: bool = False) -> list[Column]:
    url = F.coalesce("source_url", F.lit(""))
    fine = F.coalesce("local_source", F.lit(False)) | url.startswith("file://") | url.rlike("(?i)^https?://[^/?#]+")
    return [issue(~fine, "SourceUrlValidator", "invalid_source", "Public data requires a valid HTTP(S) URL or explicit local source", "source_url")]


def bad_date(name: str) -> Column:
    """For a raw string column: there, but not a date."""
    return issue(F.col(name).isNotNull() & F.expr(f"try_cast(`{name}` AS date)").isNull(), "DateValidator", "invalid_date", f"{name} is invalid", name)


def dates(strict: bool = False) -> list[Column]:
    """Typed records hold nothing but dates; raw ones are checked by ``bad_date`` when they are read."""
    return []


def duplicate_hash(strict: bool = False) -> list[Column]:
    return [issue(F.col("hash_count") > 1, "HashDuplicateValidator", "duplicate_hash", "Duplicate SHA-256 detected", "sha256")]


def source_quote(strict: bool = False) -> list[Column]:
    quote, text = F.coalesce("record.source_quote", F.lit("")), F.coalesce("raw_text", F.lit(""))
    has = F.col("record").isNotNull()
    return [
        issue(has & (quote == ""), "SourceQuoteValidator", "missing_quote", "Key extraction requires source_quote"),
        issue(has & (quote != "") & (text != "") & ~F.contains(text, quote), "SourceQuoteValidator", "quote_not_found", "source_quote is not present in immutable raw text"),
    ]


def authenticity(strict: bool = False) -> list[Column]:
    """A record has no authenticity of its own, so a document with one passes, unless ``strict``."""
    wrong = (F.col("authenticity_type") == "constructed_for_evaluation") & (F.col("data_type") != "evaluation_sample")
    if not strict:
        wrong &= F.col("record").isNull()
    return [issue(wrong, "AuthenticityValidator", "constructed_wrong_type", "constructed_for_evaluation is restricted to evaluation_sample", "authenticity_type")]


def original_wording(strict: bool = False) -> list[Column]:
    wrong = (F.col("data_type") == "penalty") & ~F.coalesce("record.disclosed", F.lit(False)) & (F.coalesce("record.wording", F.lit("")) != "")
    return [issue(F.col("record").isNotNull() & wrong, "OriginalWordingValidator", "fabricated_wording", "original_sales_wording must be empty when the source did not disclose it", "original_sales_wording")]


#: The registry: name -> rule, in the order in which issues are listed.
RULES: dict[str, Callable[[bool], list[Column]]] = {
    "required": required,
    "source_url": source_url,
    "date": dates,
    "duplicate_hash": duplicate_hash,
    "source_quote": source_quote,
    "authenticity": authenticity,
    "original_wording": original_wording,
}


#: Rules that need the hash counts
LATE = ("duplicate_hash",)


def first_records(records: DataFrame) -> DataFrame:
    """Of each (document_id, data_type) the record with the least id, as one struct."""
    rest = F.struct(*[c for c in records.columns if c not in ("document_id", "data_type")])
    return records.groupBy("document_id", "data_type").agg(F.min_by(rest, "id").alias("record"))


def with_record(docs: DataFrame, records: DataFrame) -> DataFrame:
    one = first_records(records)
    return docs.join(one, (docs["id"] == one["document_id"]) & (docs["data_type"] == one["data_type"]), "left").select(*[docs[c] for c in docs.columns], "record")


def with_hash_count(docs: DataFrame, counts: DataFrame | None = None) -> DataFrame:
    """How many of all documents have the same hash: partial sums, then a join, so that no hash is one large group.

    ``counts`` (sha256, hash_count) are those that ``tables.add_counts`` has kept from run to run, these documents among
    them; then no document but these is read.
    """
    return docs.join(_counts(docs) if counts is None else counts, "sha256", "left")


def _counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("sha256").agg(F.count("*").alias("hash_count"))


def with_issues(docs: DataFrame, records: DataFrame, strict: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Every document with its ordered issues.

    The rules that look at texts are done beside the record, so that whoever asks for no text has none shuffled for the
    hash counts.
    """
    issues = [(f"_issue_{name}_{i}", name, x) for name, rule in RULES.items() for i, x in enumerate(rule(strict))]
    early = {n: x for n, name, x in issues if name not in LATE}
    rows = with_hash_count(with_record(docs, records).withColumns(early), _counts(docs) if counts is None else counts)
    found = F.array(*[x if name in LATE else F.col(n) for n, name, x in issues])
    return rows.withColumn("issues", F.filter(found, lambda x: x.isNotNull())).drop(*early)


def validate(docs: DataFrame, records: DataFrame, strict: bool = False, counts: DataFrame | None = None) -> DataFrame:
    """Parsed documents with issues, valid and the state that follows, and the outcome as JSON in ``metadata``; approval is left to people."""
    parsed = with_issues(docs, records, strict, counts).where("final_review_status = 'parsed'")
    valid = F.size("issues") == 0
    return parsed.withColumns(
        {"valid": valid, "to_status": F.when(valid, "pending_review").otherwise("auto_validation_failed"), "metadata": with_entry(parsed, AUTOMATIC, report_json(F.col("issues")))}
    )


def report_json(issues: Column) -> Column:
    """What a reviewer is told, as JSON: whether the document is valid, and its issues with all their fields."""
    return F.to_json(F.struct((F.size(issues) == 0).alias("valid"), issues.alias("issues")), {"ignoreNullFields": "false"})


def summary(validated: DataFrame) -> DataFrame:
    return validated.agg(F.count_if("valid").alias("passed"), F.count_if(~F.col("valid")).alias("failed"))
