"""Crawled pages and registered sources, checked row by row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import with_entry
from tessera.schemas import DATA_TYPES, MAX_BYTES, OCTETS


def crawl_rows(pages: DataFrame, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Fetched pages (url, http_status, content_type, html; final_url and last_modified, if they came) with what is missing filled in and an error or null.

    The address that was asked for stays beside the one that answered. What the server says of the last change stands as JSON in ``metadata``.
    """
    given = lambda c: F.col(c) if c in pages.columns else F.lit(None).cast("string")
    headers = F.to_json(F.struct(given("last_modified").alias("last-modified")), {"ignoreNullFields": "false"})
    error = F.coalesce(
        F.when(~F.coalesce(F.col("url").rlike(r"\Ahttps?://"), F.lit(False)), "Only public HTTP(S) URLs are supported"),
        F.when(~F.coalesce(F.col("http_status").between(200, 299), F.lit(False)), F.concat(F.lit("HTTP status "), F.coalesce(F.col("http_status").cast("string"), F.lit("missing")))),
        F.when(F.octet_length("html") > max_bytes, "Download exceeds configured size limit"),
    )
    filled = {"content_type": F.coalesce("content_type", F.lit(OCTETS)), "final_url": F.coalesce(given("final_url"), "url"), "metadata": with_entry(pages, "response_headers", headers)}
    return pages.withColumns(filled | {"error": error})


def source_error(strict: bool = True) -> Column:
    """What is wrong with a source's row; ``strict`` as for the service, else as on the command line."""
    name, url, rate = F.col("name"), F.col("base_url"), F.col("rate_limit_seconds")
    checks = [(~F.coalesce(rate >= 0, F.lit(False)), "rate_limit_seconds must not be negative")]
    if strict:
        checks = [
            (~F.coalesce(F.length(name).between(1, 255), F.lit(False)), "name must have 1 to 255 characters"),
            (F.coalesce(F.length("publisher") > 255, F.lit(False)), "publisher must have at most 255 characters"),
            (url.isNotNull() & ~url.rlike("(?i)^https?://[^/?#]+"), "base_url must be an HTTP(S) URL"),
            (~F.coalesce(F.col("source_type").isin(*DATA_TYPES), F.lit(False)), "source_type is unknown"),
            *checks,
            (rate > 3600, "rate_limit_seconds must be at most 3600"),
        ]
    else:
        checks.insert(0, (url.isNull(), "base_url is required"))
    return F.coalesce(*[F.when(bad, F.lit(message)) for bad, message in checks])


def register(sources: DataFrame, strict: bool = True) -> DataFrame:
    """Rows with enabled filled in and an error or null; those without an error are to be appended."""
    return sources.withColumns({"enabled": F.coalesce("enabled", F.lit(True)), "error": source_error(strict)})


def list_sources(sources: DataFrame) -> DataFrame:
    columns = ["id", "name", "base_url", "publisher", "source_type", "enabled", "rate_limit_seconds"]
    return sources.select(*columns).orderBy("id")
