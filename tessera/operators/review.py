"""Rows for reviewers, and their decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.text import strip
from tessera.operators.ingest import transitions
from tessera.schemas import APPROVED, AUTOMATIC, DECIDABLE, QUOTES, SUMMARY_CHARS

KEYS = ("evidence_quality", "final_status", "record_id", "record_type", "reviewer")
#: Names to values of any JSON type, null among them
_FIELDS = T.MapType(T.StringType(), T.VariantType())
_TEXTS = T.MapType(T.StringType(), T.StringType())
#: A line's place among all files of an import
_ORDER = ("file", "line_no")
PROTECTED, SAMPLE_PROTECTED = ("id", "document_id", "source_quote"), ("id", "authenticity_type", "created_at")


def is_approved(status: Column) -> Column:
    return status.isin(*APPROVED)


def pending(docs: DataFrame, data_type: str) -> DataFrame:
    """What an export takes; it changes no state, so the next one takes it again."""
    return docs.where((F.col("final_review_status") == "pending_review") & (F.col("data_type") == data_type))


def document_rows(docs: DataFrame) -> DataFrame:
    """A reviewer's row of each document; its quotes and validation stand as JSON in ``metadata``."""
    have = set(docs.columns)
    told = lambda name: F.element_at("metadata", F.lit(name)) if "metadata" in have else F.lit(None).cast("string")
    or_null = lambda c, kind: F.col(c) if c in have else F.lit(None).cast(kind)
    return docs.select(
        F.col("id").alias("record_id"),
        F.col("data_type").alias("record_type"),
        or_null("source_url", "string").alias("source_url"),
        or_null("source_title", "string").alias("source_title"),
        or_null("publisher", "string").alias("publisher"),
        or_null("published_at", "date").alias("published_at"),
        F.substring(F.coalesce("raw_text", F.lit("")), 1, SUMMARY_CHARS).alias("raw_text_summary"),
        F.coalesce(F.to_json(or_null("corrected_fields", _FIELDS)), F.lit("{}")).alias("parsed_fields"),
        F.coalesce(F.from_json(told(QUOTES), "array<string>"), F.array().cast("array<string>")).alias("source_quotes"),
        F.coalesce(told(AUTOMATIC), F.lit("{}")).alias("automatic_validation"),
        F.col("final_review_status").alias("current_status"),
    )


def sample_rows(samples: DataFrame) -> DataFrame:
    """A reviewer's row of each evaluation sample."""
    fields = F.struct("sample_category", "risk_labels", "expected_evidence", "construction_basis", "split")
    none = F.lit(None)
    return samples.select(
        F.col("id").alias("record_id"),
        F.lit("evaluation_sample").alias("record_type"),
        none.cast("string").alias("source_url"),
        F.lit("人工构造评测样本").alias("source_title"),
        none.cast("string").alias("publisher"),
        none.cast("date").alias("published_at"),
        F.substring("sample_text", 1, SUMMARY_CHARS).alias("raw_text_summary"),
        F.to_json(fields).alias("parsed_fields"),
        F.array().cast("array<string>").alias("source_quotes"),
        F.lit('{"valid":true,"issues":[]}').alias("automatic_validation"),
        F.col("final_review_status").alias("current_status"),
    )


def batch(rows: DataFrame, batch_id: int, data_type: str, as_of: str, path: str) -> DataFrame:
    """The record of an export: its name is type and second, ``as_of`` (yyyyMMddHHmmss) is the caller's."""
    return rows.agg(F.count("*").cast("int").alias("record_count")).select(
        F.lit(batch_id).cast("bigint").alias("id"), F.lit(f"{data_type}-{as_of}").alias("batch_name"), F.lit(data_type).alias("data_type"), "record_count", F.lit(path).alias("export_path"), F.lit("exported").alias("status")
    )


def parse_decisions(decision_lines: DataFrame) -> DataFrame:
    """line_no, line, file (empty if there is none) -> typed columns and the first error of each line that is not blank.

    Keys must be there, not non-null. Integers and integer strings are record ids. Corrections
    and field reviews keep the types of their values.
    """
    if "file" not in decision_lines.columns:
        decision_lines = decision_lines.withColumn("file", F.lit(""))
    d = decision_lines.where(strip(F.col("line")) != "")
    value = F.try_parse_json("line")
    d = d.withColumns({"is_object": F.coalesce(F.schema_of_variant(value).startswith("OBJECT"), F.lit(False)), "is_json": value.isNotNull(), "keys": F.from_json("line", _TEXTS), "given": F.try_variant_get(value, "$.corrections", "variant")})
    d = d.withColumn("keys", F.when(F.col("is_object"), F.coalesce("keys", F.create_map().cast(_TEXTS))))
    get = lambda k: F.element_at("keys", k)
    corrections = F.to_json("given")
    empty = F.coalesce(corrections, F.lit("null")).isin("{}", "[]", "null", "false", "0", "0.0", '""')
    none = F.create_map().cast(_FIELDS)
    missing = F.filter(F.array(*[F.when(~F.map_contains_key("keys", k), F.lit(k)) for k in KEYS]), lambda x: x.isNotNull())
    record_id = F.when(get("record_id").rlike(r"\A\s*[+-]?[0-9]+\s*\z"), F.expr("try_cast(trim(element_at(keys, 'record_id')) AS bigint)"))
    status, quality = F.coalesce(get("final_status"), F.lit("None")), F.coalesce(get("evidence_quality"), F.lit("None"))
    checks = [
        (~F.col("is_json"), F.lit("invalid JSON")),
        (~F.col("is_object"), F.lit("payload must be an object")),
        (F.size(missing) > 0, F.concat(F.lit("Missing fields: "), F.array_join(missing, ", "))),
        (record_id.isNull(), F.lit("record_id must be an integer")),
        (~status.isin(*DECIDABLE), F.concat(F.lit("Illegal final_status: "), status)),
        (~quality.isin("A", "B", "C", "D"), F.lit("evidence_quality must be A, B, C, or D")),
        ((status == "approved_with_revision") & empty, F.lit("approved_with_revision requires corrections")),
        (~empty & ~F.startswith(corrections, F.lit("{")), F.lit("corrections must be an object")),
    ]
    made = {
        "error": F.coalesce(*[F.when(bad, message) for bad, message in checks]),
        "record_id": record_id,
        "record_type": get("record_type"),
        "final_status": status,
        "evidence_quality": quality,
        "reviewer": F.coalesce(get("reviewer"), F.lit("None")),
        "review_comment": get("review_comment"),
        "field_reviews": F.coalesce(F.from_json(get("field_reviews"), _FIELDS), none),
        "corrections": F.when(empty, none).otherwise(F.from_json(corrections, _FIELDS)),
    }
    return d.withColumns(made).drop("is_object", "is_json", "keys", "given")


def _as_fields(docs: DataFrame) -> Column:
    """The documents' earlier corrections; values that are plain strings are JSON strings."""
    if "corrected_fields" not in docs.columns:
        return F.lit(None).cast(_FIELDS)
    old = docs["corrected_fields"]
    return old if docs.schema["corrected_fields"].dataType == _FIELDS else F.transform_values(old, lambda k, v: F.coalesce(v.cast("variant"), F.parse_json(F.lit("null"))))


def match_decisions(decisions: DataFrame, docs: DataFrame, samples: DataFrame | None = None) -> DataFrame:
    """The decisions, with an error where id and type name no document (or sample); adds current_status and current_fields (earlier corrections)."""
    known = docs.select(F.col("id").alias("_id"), F.col("data_type").alias("_type"), F.col("final_review_status").alias("current_status"), _as_fields(docs).alias("current_fields"))
    if samples is not None:
        known = known.union(samples.select("id", F.lit("evaluation_sample"), "final_review_status", F.lit(None).cast(_FIELDS)))
    out = decisions.join(known, (decisions["record_id"] == known["_id"]) & (decisions["record_type"] == known["_type"]), "left")
    what = F.when(F.col("record_type") == "evaluation_sample", "an evaluation sample").otherwise("a document")
    unknown = F.when(F.col("_id").isNull(), F.concat(F.lit("record_id and record_type do not identify "), what))
    return out.withColumn("error", F.coalesce("error", unknown)).drop("_id", "_type")


def import_summary(matched: DataFrame) -> DataFrame:
    return matched.agg(F.count_if(F.col("error").isNull()).alias("imported"), F.count_if(F.col("error").isNotNull()).alias("failed"))


def import_errors(matched: DataFrame) -> DataFrame:
    return matched.where("error is not null").select("file", "line_no", F.concat(F.lit("line "), F.col("line_no").cast("string"), F.lit(": "), "error").alias("message"))


def merged(matched: DataFrame) -> DataFrame:
    """Per decided record: corrections merged in order of file and line over its earlier ones (a later line wins a key), last state, number of decisions.

    A key's last value is a ``max_by`` with partial sums, so a record with very many decisions is no large group.
    Values go through the sums as JSON, null among them, and are typed values again in the result.
    """
    fine, order = matched.where("error is null"), F.struct(*_ORDER)
    per_key = fine.select("record_type", "record_id", *_ORDER, F.explode("corrections").alias("k", "v")).withColumn("v", F.to_json("v"))
    per_key = per_key.groupBy("record_type", "record_id", "k").agg(F.max_by("v", order).alias("v"))
    fields = per_key.groupBy("record_type", "record_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v")))).alias("corrected_fields"))
    fields = fields.withColumn("corrected_fields", F.transform_values("corrected_fields", lambda k, v: F.parse_json(v)))
    last = fine.groupBy("record_type", "record_id").agg(
        F.max_by("final_status", order).alias("final_status"), F.count("*").alias("n_decisions"), F.max_by("current_fields", order).alias("current_fields")
    )
    none = F.create_map().cast(_FIELDS)
    new, old = F.coalesce("corrected_fields", none), F.coalesce("current_fields", none)
    whole = F.map_concat(F.map_filter(old, lambda k, v: ~F.map_contains_key(new, k)), new)
    made = last.join(fields, ["record_type", "record_id"], "left").withColumns({"new_fields": new, "corrected_fields": whole})
    return made.select("record_type", "record_id", "corrected_fields", "new_fields", "final_status", "n_decisions")


def correct_records(records: DataFrame, decided: DataFrame, protected: tuple[str, ...] = PROTECTED) -> DataFrame:
    """The first record of each corrected document's own type with its new values; unknown and protected keys are ignored."""
    named = decided.where("record_type <> 'evaluation_sample'").select(F.col("record_id").alias("document_id"), F.col("record_type").alias("data_type"), "new_fields")
    first = records.groupBy("document_id", "data_type").agg(F.min("id").alias("first_id")).join(named, ["document_id", "data_type"])
    first = first.select(F.col("document_id").alias("_document"), F.col("data_type").alias("_type"), "first_id", "new_fields")
    same = (records["document_id"] == first["_document"]) & (records["data_type"] == first["_type"]) & (records["id"] == first["first_id"])
    out = records.join(first, same, "left")
    kept = {*protected, "data_type"}
    return out.select(*[records[c] if c in kept else _corrected(records[c], c, kind).alias(c) for c, kind in records.dtypes])


def _corrected(old: Column, name: str, kind: str) -> Column:
    """The new value in the column's type, null if that is what it is; one that is of no such type changes nothing."""
    value = F.element_at("new_fields", F.lit(name))
    there = F.coalesce(F.map_contains_key("new_fields", name), F.lit(False))
    return F.when(there & (value.isNull() | F.is_variant_null(value)), F.lit(None).cast(kind)).otherwise(F.coalesce(F.try_variant_get(value, "$", kind), old))


def correct_samples(samples: DataFrame, decided: DataFrame) -> DataFrame:
    """Samples with their corrections, then the decided state; from_status is read after the corrections."""
    d = decided.where("record_type = 'evaluation_sample'").select(F.col("record_id").alias("id"), "new_fields", "final_status")
    out = samples.join(d, "id", "left")
    out = out.withColumns({c: _corrected(F.col(c), c, kind) for c, kind in samples.dtypes if c not in SAMPLE_PROTECTED})
    return out.withColumns({"from_status": F.when(F.col("final_status").isNotNull(), F.col("final_review_status")), "final_review_status": F.coalesce("final_status", "final_review_status")}).select(*samples.columns, "from_status")


def decision_log(matched: DataFrame) -> DataFrame:
    """A row per imported decision."""
    return matched.where("error is null").select("file", "line_no", "record_type", "record_id", F.col("final_status").alias("decision"), "field_reviews", "corrections", "evidence_quality", "review_comment", "reviewer")


def decision_history(matched: DataFrame) -> DataFrame:
    """A transition per imported decision; any state can be decided. A sample's state before is read after its corrections, which may set it."""
    fine = matched.where("error is null").select("record_type", "record_id", *_ORDER, "corrections", F.struct(*_ORDER).alias("seq"), F.col("current_status").alias("current"), F.col("final_status").alias("to_status"))
    moved = transitions(fine, ("record_type", "record_id"))
    set_to = F.try_variant_get(F.element_at("corrections", "final_review_status"), "$", "string")
    set_now = (F.col("record_type") == "evaluation_sample") & F.map_contains_key("corrections", "final_review_status")
    before = F.when(set_now, set_to).otherwise(F.col("from_status"))
    return moved.select("record_type", "record_id", *_ORDER, before.alias("from_status"), "to_status", F.lit("human review").alias("reason"))
