"""Documents from rows of pages or paragraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions.text import strip


def from_pages(pages: DataFrame) -> DataFrame:
    """doc, page_number, text, image_count -> plain_text, pages, requires_ocr, warnings.

    Empty pages stay in pages but not in the text. A document with images and next to no
    text is taken for a scan.
    """
    made = pages.groupBy("doc").agg(
        F.array_sort(F.collect_list(F.struct("page_number", strip(F.coalesce("text", F.lit(""))).alias("text")))).alias("pages"),
        F.max(F.coalesce("image_count", F.lit(0)) > 0).alias("has_image"),
    )
    plain = F.array_join(F.filter(F.col("pages.text"), lambda t: t != ""), "\n\n")
    made = made.withColumn("plain_text", plain)
    scanned = F.col("has_image") & (F.length(strip(F.col("plain_text"))) < F.greatest(F.lit(20), 10 * F.size("pages")))
    warned = F.when(scanned, F.array(F.lit("suspected_scanned_pdf"))).otherwise(F.array().cast("array<string>"))
    return made.select("doc", "plain_text", "pages", scanned.alias("requires_ocr"), warned.alias("warnings"))


def from_paragraphs(paragraphs: DataFrame) -> DataFrame:
    """doc, idx, style, text, stem -> title, headings (original idx, text), plain_text, warnings."""
    kept = paragraphs.withColumn("text", strip(F.coalesce("text", F.lit("")))).where("text <> ''")
    style = F.coalesce("style", F.lit(""))
    titled = (style == "Title") | style.startswith("标题")
    heading = style.startswith("Heading") | style.startswith("标题")
    made = kept.groupBy("doc").agg(
        F.min_by(F.when(titled, F.col("text")), F.when(titled, F.col("idx"))).alias("found"),
        F.first("stem").alias("stem"),
        F.array_sort(F.collect_list(F.when(heading, F.struct("idx", "text")))).alias("headings"),
        F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("all"),
    )
    return made.select(
        "doc",
        F.coalesce("found", "stem").alias("title"),
        "headings",
        F.array_join(F.col("all.text"), "\n").alias("plain_text"),
        F.array(F.lit("docx_page_numbers_unavailable")).alias("warnings"),
    )
