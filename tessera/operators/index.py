"""The gate to the trusted index, reads of records, and seeding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.staging import staged
from tessera.operators.ingest import history
from tessera.operators.review import is_approved
from tessera.schemas import UNTRUSTED
from tessera.sources.tables import PART, PARTS, parts_of, stored_rows, update_rows


def eligible(strict: bool = False) -> Column:
    """Approved, not indexed, and not of an untrusted kind; ``strict``: of verified public origin only."""
    origin = F.col("authenticity_type")
    trusted = origin == "verified_public" if strict else ~origin.isin(*UNTRUSTED)
    return is_approved(F.col("final_review_status")) & trusted & (F.col("knowledge_index_status") != "indexed")


def mark_indexed(docs: DataFrame, as_of: str, strict: bool = False) -> DataFrame:
    """All documents, the eligible ones marked; a second run marks none."""
    now = F.coalesce(eligible(strict), F.lit(False))
    return docs.withColumns(
        {
            "from_status": F.when(now, F.col("final_review_status")),
            "indexed_at": F.when(now, F.lit(as_of).cast("timestamp")).otherwise(F.col("indexed_at")),
            "final_review_status": F.when(now, "indexed").otherwise(F.col("final_review_status")),
            "knowledge_index_status": F.when(now, "indexed").otherwise(F.col("knowledge_index_status")),
        }
    )


def write_indexed(spark: SparkSession, path: str, as_of: str, strict: bool = False, parts: int = PARTS) -> DataFrame:
    """Mark the eligible documents of a stored table (``tables.write_table`` by id) in their folders; the log rows of the marked ones.

    A run that is repeated marks none and logs none.
    """
    marked = mark_indexed(stored_rows(spark, path), as_of, strict).where("from_status is not null")
    kept = staged(marked.select("id", "data_type", "from_status", "final_review_status", PART), "indexed")  # the log, as the states before it go
    update_rows(spark, path, lambda docs: mark_indexed(docs, as_of, strict), parts_of(kept))
    return index_history(kept, as_of)


def index_history(marked: DataFrame, as_of: str) -> DataFrame:
    """The log rows of what ``mark_indexed`` has marked."""
    return history(marked.where("from_status is not null"), "trusted index marker", as_of, "final_review_status", "from_status")


def indexed_count(docs: DataFrame, strict: bool = False) -> DataFrame:
    return docs.agg(F.count_if(F.coalesce(eligible(strict), F.lit(False))).alias("indexed"))


def list_records(docs: DataFrame, status: str | None = None, data_type: str | None = None) -> DataFrame:
    """In order of id; an empty filter is none."""
    if status:
        docs = docs.where(F.col("final_review_status") == status)
    if data_type:
        docs = docs.where(F.col("data_type") == data_type)
    return docs.orderBy("id")


def get_record(docs: DataFrame, data_type: str, record_id: int) -> DataFrame:
    """The row that both id and type name, or none."""
    return docs.where((F.col("id") == record_id) & (F.col("data_type") == data_type))


def record_view(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """What a reader of a record gets; ``with_text`` adds the text and the metadata."""
    kinds = dict(docs.dtypes)
    given = lambda c: F.coalesce(c, F.create_map().cast(kinds[c])) if c in kinds else F.create_map().cast("map<string,string>")
    view = ["id", "data_type", "source_url", "source_title", "authenticity_type", "final_review_status", "knowledge_index_status", given("corrected_fields").alias("corrected_fields")]
    return docs.select(*view, *(["raw_text", given("metadata").alias("metadata")] if with_text else []))


def insert_absent_records(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Existing records and those new ones whose document has none."""
    return existing.unionByName(new.join(existing.select("document_id").distinct(), "document_id", "left_anti").select(*new.columns))


def fill_if_empty(table: DataFrame, rows: DataFrame) -> DataFrame:
    return rows if table.isEmpty() else table
