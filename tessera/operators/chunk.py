"""Greedy chunks of lines and their offsets, within a document's row: no shuffle.

A batch of rows is worked in Arrow UDFs, one linear pass over each text: prefix sums of the
lines' lengths tell where a chunk ends, and a chunk is looked for from the end of the one before it, not far at first.
Where one is not near as it stands (its lines were stripped, or blank ones are between them), one more pass over the text finds the places of all
chunks that are left.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.grams import Places
from tessera.schemas import CHUNK_CHARS

_SPANS = "array<struct<start:int,end:int,exact:boolean>>"
_MADE = "array<struct<page_number:int,text:string,start:int,end:int,exact:boolean>>"
STRETCH = 256
_ARROW_SPAN = [("start", pa.int32()), ("end", pa.int32()), ("exact", pa.bool_())]


def packed(text: str, most: int) -> list[str]:
    """The chunks of one text; ``splitlines`` and ``strip`` know Unicode's line ends and white space."""
    rows = [s for x in text.splitlines() if (s := x.strip())]
    sums = list(accumulate((len(x) + 1 for x in rows), initial=0))
    out: list[str] = []
    i = 0
    while i < len(rows):
        if len(rows[i]) > most:
            out += [rows[i][k : k + most] for k in range(0, len(rows[i]), most)]
            i += 1
        else:
            end = bisect_right(sums, sums[i] + most + 1) - 1
            out.append("\n".join(rows[i:end]))
            i = end
    return out


def spans(pieces: list[str], plain: str) -> list[tuple[int, int, bool]]:
    """start, end and exact of each chunk."""
    out, ends, places = [], 0, None
    for i, piece in enumerate(pieces):
        near = ends + 4 * len(piece) + 64
        found = plain.find(piece, ends, near)
        if found < 0 and near < len(plain):
            places = places or Places(pieces[i:], plain, ends)
            found = places.next(piece, ends)
        begins = max(found, ends)
        ends = begins + len(piece)
        out.append((begins, ends, found >= 0))
    return out


def chunk_texts(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Lines packed with line feeds up to ``most`` code points; a longer line is cut into chunks of its own."""

    def run(texts: pa.Array) -> pa.Array:
        return pa.array((packed(x.as_py() or "", most) for x in texts), pa.list_(pa.string()), size=len(texts))

    return F.arrow_udf(run, T.ArrayType(T.StringType()))(text)


def _offsets(chunks: pa.Array, plain: pa.Array) -> pa.Array:
    names = [n for n, _ in _ARROW_SPAN]
    rows = ([dict(zip(names, s, strict=True)) for s in spans(c.as_py() or [], p.as_py() or "")] for c, p in zip(chunks, plain, strict=True))
    return pa.array(rows, pa.list_(pa.struct(_ARROW_SPAN)), size=len(plain))


def chunk_offsets(chunks: Column, plain: Column) -> Column:
    """start, end and exact of each chunk: the first match from the previous end on, else that end."""
    return F.arrow_udf(_offsets, _SPANS)(chunks, plain)


def _made(most: int):
    kind = pa.list_(pa.struct([("page_number", pa.int32()), ("text", pa.string()), *_ARROW_SPAN]))

    def one(of: list[dict], text: str | None) -> list[dict]:
        pieces = [(p["page_number"], c) for p in of for c in packed(p["text"] or "", most)]
        at = spans([c for _, c in pieces], text or "")
        return [{"page_number": n, "text": c, "start": s, "end": e, "exact": x} for (n, c), (s, e, x) in zip(pieces, at, strict=True)]

    def some(pages: pa.Array, plain: pa.Array, same: pa.Array) -> pa.Array:
        rows = zip((p.as_py() or [] for p in pages), plain, same, strict=True)
        return pa.array([one(of, of[0]["text"] if s.as_py() else t.as_py()) for of, t, s in rows], kind)

    def run(pages: pa.Array, plain: pa.Array, same: pa.Array) -> pa.Array:
        """A batch in stretches of rows, so that only one stretch's texts are Python's at once; its memory goes back."""
        cut = lambda i: (x.slice(i, STRETCH) for x in (pages, plain, same))
        made = [some(*cut(i)) for i in range(0, len(pages), STRETCH)]
        out = pa.concat_arrays(made) if made else pa.array([], kind)
        del made
        pa.default_memory_pool().release_unused()
        return out

    return run


def chunks(docs: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """document_id, plain_text, pages (page_number, text) -> a row per chunk, numbered over all pages."""
    pages = F.transform("pages", lambda p: F.struct(p["page_number"].cast("int").alias("page_number"), p["text"].alias("text")))
    # a text that is its document's only page goes to Python once
    same = (F.size("pages") == 1) & F.get("pages", F.lit(0))["text"].eqNullSafe(F.col("plain_text"))
    made = F.arrow_udf(_made(most), _MADE)(pages, F.when(~same, F.col("plain_text")), same)
    made = docs.select("document_id", F.posexplode(made).alias("chunk_index", "chunk"))
    return made.select(
        "document_id",
        F.col("chunk.page_number").alias("page_number"),
        "chunk_index",
        F.col("chunk.text").alias("text"),
        F.col("chunk.start").alias("start_offset"),
        F.col("chunk.end").alias("end_offset"),
        F.col("chunk.exact").alias("exact"),
    )


def replace_chunks(existing: DataFrame, parsed: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of parsed documents (document_id) go, the new ones come."""
    return existing.join(parsed.select("document_id").distinct(), "document_id", "left_anti").unionByName(new)
