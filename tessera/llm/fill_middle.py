r"""Fill-in-middle transformation by in-place block rotation.

A text is cut at two of its line ends into prefix, middle and suffix. Its UTF-8 bytes
go into a bytearray with the sentinels inserted where the parts begin,
``<P>prefix<M>middle<S>suffix``, and one exchange of neighbouring segments in place makes
the form:

- psm, ``<P>prefix<S>suffix<M>middle``: the last two segments change places;
- spm, ``<S>suffix<P>prefix<M>middle``: the last segment goes before the first two.

An exchange is a rotation by three reversals: each segment, then both together; a
reversal swaps pieces of ``PIECE`` bytes from both ends, so that beside the text's own bytes no
more is held. ``restore`` finds the sentinels, undoes the rotation by the same three reversals
and takes the sentinels out. Texts that hold a sentinel stay plain, so in an output
each occurs once: none can form across a border, as each begins with ``<``, ends with ``>``
and has neither in between.

Where a text is cut, and its form, are four draws from the SHA-256 of the seed and the document's
id: the same in every run and on every executor. Nothing is shuffled.

Defined cases: null and empty texts are plain and have no lines. A null doc_id draws as an
empty one. Repeated rows are each transformed alike; rows of one doc_id with other
texts share their draws. Texts of any length are done whole. An empty table gives no rows.
Extra columns stay, whatever their names, but for those that ``transform`` makes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.staging import free
from tessera.llm.words import release

SEED, RATE, SPM = 7, 100, 50
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PIECE = 1 << 16
MADE = "struct<n:bigint,form:string,prefix_chars:bigint,middle_chars:bigint,output:string>"
_ARROW = pa.struct([("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()), ("middle_chars", pa.int64()), ("output", pa.string())])


def reverse(data: bytearray, start: int, end: int) -> None:
    """Reverse bytes start to end in place, by pieces from both ends."""
    view = np.frombuffer(data, np.uint8)
    while end - start > 1:
        k = min(PIECE, (end - start) // 2)
        left = view[start : start + k].copy()
        view[start : start + k] = view[end - k : end][::-1]
        view[end - k : end] = left[::-1]
        start, end = start + k, end - k


def rotate(data: bytearray, start: int, middle: int, end: int) -> None:
    """Let bytes start:middle and middle:end change places."""
    reverse(data, start, middle)
    reverse(data, middle, end)
    reverse(data, start, end)


def line_ends(data: bytes) -> np.ndarray:
    """Where the text's lines end; text after the last line feed is a line too."""
    ends = np.flatnonzero(np.frombuffer(data, np.uint8) == 0x0A) + 1
    return ends if not data or data.endswith(b"\n") else np.append(ends, len(data))


def chars(data: bytes | bytearray | memoryview) -> int:
    """Code points of UTF-8 bytes."""
    return int(np.count_nonzero(np.frombuffer(data, np.uint8) & 0xC0 != 0x80))


def arranged(text: bytes, first: int, second: int, form: str) -> bytearray:
    """The text's bytes with sentinels in the order of the form; the prefix ends at ``first``, the middle at ``second``."""
    data = bytearray(text)
    data[second:second] = SUFFIX
    data[first:first] = MIDDLE
    data[0:0] = PREFIX
    middle, suffix = first + len(PREFIX), second + len(PREFIX) + len(MIDDLE)
    rotate(data, middle if form == "psm" else 0, suffix, len(data))
    return data


def rebuilt(output: bytes, form: str) -> bytearray:
    """The text that ``arranged`` was given, from its output and form alone."""
    data = bytearray(output)
    middle = data.index(MIDDLE)
    if form == "psm":
        start = data.index(SUFFIX)
        rotate(data, start, middle, len(data))
    else:
        rotate(data, 0, data.index(PREFIX), len(data))
    for sentinel in (SUFFIX, MIDDLE, PREFIX):  # from the last one, so that less is moved
        at = data.index(sentinel)
        del data[at : at + len(sentinel)]
    return data


def _one(text: str | None, draws: list[int], rate: int, spm: int) -> tuple:
    data = (text or "").encode()
    ends = line_ends(data)
    n = len(ends)
    if not data or any(s in data for s in (PREFIX, SUFFIX, MIDDLE)) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text or ""
    cuts = sorted(int(ends[u - 1]) if u else 0 for u in (draws[0] % (n + 1), draws[1] % (n + 1)))
    form = "spm" if draws[3] % 100 < spm else "psm"
    out = arranged(data, *cuts, form)
    view = memoryview(data)
    return n, form, chars(view[: cuts[0]]), chars(view[cuts[0] : cuts[1]]), out.decode()


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm: int = SPM) -> DataFrame:
    """The documents with n (lines), form (plain, psm, spm), prefix_chars, middle_chars and output.

    ``rate`` of 100 texts are transformed, ``spm`` of 100 of these in form spm.
    """

    def run(texts: pa.Array, draws: pa.Array) -> pa.Array:
        rows = (_one(t.as_py(), d.as_py(), rate, spm) for t, d in zip(texts, draws, strict=True))
        out = pa.array((dict(zip([f.name for f in _ARROW], r, strict=True)) for r in rows), _ARROW, size=len(texts))
        release()
        return out

    drawn = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    group = lambda i: F.conv(F.substring(drawn, 8 * i + 1, 8), 16, 10).cast("bigint")
    names, made = {f.name for f in _ARROW}, free(docs, "made")
    kept = [F.col(f"`{c.replace('`', '``')}`") for c in docs.columns if c.lower() not in names]
    out = docs.select(*kept, F.arrow_udf(run, MADE)("text", F.array(*map(group, range(4)))).alias(made))
    return out.select(*kept, f"{made}.*")


def _restored(output: pa.Array, form: pa.Array) -> pa.Array:
    rows = (t.as_py() if f.as_py() == "plain" else rebuilt(t.as_py().encode(), f.as_py()).decode() for t, f in zip(output, form, strict=True))
    out = pa.array(rows, pa.string(), size=len(output))
    release()
    return out


def restore(output: Column, form: Column) -> Column:
    """The text that an output and its form stand for; of null and empty texts the empty one."""
    return F.arrow_udf(_restored, T.StringType())(output, form)


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, and the SHA-256 of the output and of the text rebuilt from it."""
    made = transform(docs.select("doc_id", "text"))
    out = F.col("output")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(out, 256).alias("output_sha256"), F.sha2(restore(out, F.col("form")), 256).alias("restored_sha256"))
