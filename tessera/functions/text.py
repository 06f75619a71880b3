"""Text expressions with Unicode white space and line ends, which ``trim`` does not know."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The characters that count as white space, and the line ends.
SPACE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
#: The named character references that the queries' SQL decodes, & last; the operators decode all.
REFERENCES = (("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&quot;", '"'), ("&apos;", "'"), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"))


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"\A[{SPACE}]+|[{SPACE}]+\z", "")


def lines(text: Column) -> Column:
    """Stripped lines that are not blank."""
    return F.filter(F.transform(F.split(text, LINE_END), strip), lambda x: x != "")


def or_missing(text: Column) -> Column:
    """An empty string counts as missing."""
    return F.nullif(text, F.lit(""))


def suffix(path: Column) -> Column:
    """Lower-case ``.ext`` of a path's last part, else an empty string; a leading dot is no suffix."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def with_entry(rows: DataFrame, name: str, value: Column) -> Column:
    """The rows' ``metadata`` (names to JSON text; may be missing) with an entry set; other names stay."""
    none = F.create_map().cast("map<string,string>")
    old = F.coalesce("metadata", none) if "metadata" in rows.columns else none
    return F.map_concat(F.map_filter(old, lambda k, v: k != name), F.create_map(F.lit(name), value))
