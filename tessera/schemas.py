"""Domains and types of the reviewed-corpus tables (fixed values)."""

from __future__ import annotations

DATA_TYPES = ("regulation", "penalty", "product_document", "evaluation_sample")
AUTHENTICITY = ("verified_public", "constructed_for_evaluation", "demo_only", "pending_verification")
STATUSES = (
    "collected",
    "parsed",
    "auto_validation_failed",
    "pending_review",
    "approved",
    "approved_with_revision",
    "rejected",
    "pending_source_verification",
    "rejected_hallucination",
    "rejected_duplicate",
    "rejected_outdated",
    "requires_expert_review",
    "indexed",
)
APPROVED = ("approved", "approved_with_revision")
#: what a reviewer may decide: all but the states that only the pipeline sets
DECIDABLE = tuple(s for s in STATUSES if s not in ("collected", "parsed", "pending_review", "auto_validation_failed", "indexed"))
UNTRUSTED = ("demo_only", "pending_verification")
SUFFIXES = (".pdf", ".docx", ".html", ".htm", ".txt")
CONTENT_TYPES = {
    ".pdf": "application/pdf",
    ".docx": "application/vnd.openxmlformats-officedocument.wordprocessingml.document",
    ".html": "text/html",
    ".htm": "text/html",
    ".txt": "text/plain",
}
TYPE_SUFFIXES = {
    "application/pdf": ".pdf",
    "application/vnd.openxmlformats-officedocument.wordprocessingml.document": ".docx",
    "text/html": ".html",
    "text/plain": ".txt",
}
OCTETS = "application/octet-stream"
MAX_BYTES = 50 * 1024 * 1024
AUTOMATIC, QUOTES = "automatic_validation", "source_quotes"  # names in a document's metadata
CHUNK_CHARS, SUMMARY_CHARS = 1200, 500
ISSUE = "struct<validator:string,code:string,message:string,field:string>"
SAMPLE = (
    "id bigint, sample_text string, sample_category string, risk_labels array<string>, expected_evidence map<string,string>, "
    "construction_basis string, authenticity_type string, split string, final_review_status string"
)
