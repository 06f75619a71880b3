"""Benchmark decontamination by a prefix-filtered containment join.

A window is 13 consecutive words of a benchmark item; an item of fewer words is
one window. A document contains a window if its words follow each other there, so
every shingle of the window must occur, and one shingle is prefix enough: the one
that is rarest in the corpus. The steps:

1. Count the benchmark's shingles (five words; shorter for shorter windows) over all
   documents: sums per task, then one shuffle of at most a row per shingle and task.
2. Give each window its rarest shingle, with the shingle's place in the window.
3. In each document, look up those prefix shingles only. A hit at a word gives the
   place where the window would begin; the length and positional bounds drop what
   does not fit into the document; the window's words are then compared one by one.

A benchmark of at most ``most_bytes`` of text goes to all tasks as tables of windows. A larger one
is joined by shuffle on the prefix shingles (``mark_large``): documents are read twice, once to count
shingles in a fixed number of buckets (any order of shingles gives the same result, rarity makes it
cheap), once to send each word whose shingle may be a prefix, with the words around it, to the windows
with that prefix. What goes to all tasks there is a bitmap of the prefixes of 32 MB at most, whatever the
benchmark. Verified windows are gathered by document row.

Defined cases: a null text, or one without words, has no words and is not
contaminated; such items have no windows. Items with a null id hit words but are
in no list of items. Items with equal ids are one item; equal windows of several
items count for each. Repeated documents are judged each for itself. Empty tables
give an empty result or documents without hits. Extra columns are not read by
``contamination`` and kept by ``decontaminate``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.batches import whole_groups
from tessera.llm.staging import free, staged
from tessera.llm.words import U64, roll, texts, words_of

WINDOW, SHINGLE = 13, 5
MOST_BYTES = 2 << 20
#: Of the large join: buckets of shingle counts, bits of the prefixes' bitmap, words before and from a shingle on
COUNT_BUCKETS, MOST_BITS = 1 << 18, 28
BEFORE, AFTER = WINDOW - SHINGLE, WINDOW
CANDIDATES_AT_ONCE = 200_000
_MARKS = T.StructType(
    [T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.LongType())), T.StructField("items", T.ArrayType(T.StringType()))]
)


class Windows:
    """The distinct windows of some items, by length, and who they belong to."""

    def __init__(self, items: list[tuple[int | None, str | None]]):
        self.names = sorted({str(i) for i, _ in items if i is not None})
        number = {name: n for n, name in enumerate(self.names)}
        found: dict[int, tuple[list, list]] = {}
        for t in texts(pa.array([x for _, x in items], pa.string())):
            w = words_of(t)
            for i, (a, b) in enumerate(zip(w.bounds, w.bounds[1:], strict=False)):
                if b > a:
                    length = min(WINDOW, int(b - a))
                    rows = np.lib.stride_tricks.sliding_window_view(w.hashes[a:b], length)
                    name = items[t.first + i][0]
                    words, owners = found.setdefault(length, ([], []))
                    words.append(rows)
                    owners.append(np.full(len(rows), -1 if name is None else number[str(name)]))
        self.words: dict[int, np.ndarray] = {}
        self.owners: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for length, (words, owners) in found.items():
            distinct, which = np.unique(np.concatenate(words), axis=0, return_inverse=True)
            pairs = np.unique(np.stack([which.ravel(), np.concatenate(owners)], 1), axis=0)
            self.words[length] = distinct
            self.owners[length] = (np.searchsorted(pairs[:, 0], np.arange(len(distinct) + 1)), pairs[:, 1])

    def shingles(self, length: int) -> np.ndarray:
        """A row of shingle hashes per window, in the order of their places."""
        words = self.words[length]
        k = min(SHINGLE, length)
        places = length - k + 1
        at = (np.arange(len(words))[:, None] * length + np.arange(places)).ravel()
        return roll(words.ravel(), at, k).reshape(-1, places)

    def vocabulary(self) -> dict[int, np.ndarray]:
        """By shingle length, the sorted distinct shingles."""
        out: dict[int, list] = {}
        for length in self.words:
            out.setdefault(min(SHINGLE, length), []).append(self.shingles(length).ravel())
        return {k: np.unique(np.concatenate(v)) for k, v in out.items()}


class Prefixes:
    """Of each window the rarest shingle and its place, sorted by shingle."""

    def __init__(self, windows: Windows, counts: dict[int, int]):
        self.windows = windows
        self.tables: dict[int, tuple] = {}
        for k in {min(SHINGLE, length) for length in windows.words}:
            shingle, length_of, number, place = [], [], [], []
            for length in windows.words:
                if min(SHINGLE, length) == k:
                    rows = windows.shingles(length)
                    values, which = np.unique(rows, return_inverse=True)
                    n = np.array([counts.get(int(v.astype(np.int64)), 0) for v in values], np.int64)[which.reshape(rows.shape)]
                    best = n.argmin(1)
                    met = n[np.arange(len(rows)), best] > 0  # a shingle that no document has rules the window out
                    shingle.append(rows[np.arange(len(rows)), best][met])
                    length_of.append(np.full(met.sum(), length))
                    number.append(np.flatnonzero(met))
                    place.append(best[met])
            parts = [np.concatenate(x) for x in (shingle, length_of, number, place)]
            order = np.argsort(parts[0], kind="stable")
            self.tables[k] = tuple(x[order] for x in parts)


class _Filter:
    """A bitmap that lets few values through that are not in a sorted table."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.bits = np.zeros(1 << 20, bool)
        self.bits[(table >> U64(44)).astype(np.int64)] = True

    def find(self, values: np.ndarray) -> np.ndarray:
        """Indices of the values that the table has."""
        maybe = np.flatnonzero(self.bits[(values >> U64(44)).astype(np.int64)])
        if not len(self.table):
            return maybe[:0]
        at = np.minimum(np.searchsorted(self.table, values[maybe]), len(self.table) - 1)
        return maybe[self.table[at] == values[maybe]]


def counted(vocabulary: dict[int, np.ndarray]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> shingle, n: how often the task's documents have each shingle of the vocabulary."""
        filters = {k: _Filter(v) for k, v in vocabulary.items()}
        n = {k: np.zeros(len(v), np.int64) for k, v in vocabulary.items()}
        for batch in batches:
            for t in texts(batch.column(0)):
                w = words_of(t)
                for k, f in filters.items():
                    _, values = w.shingles(k)
                    found = np.searchsorted(f.table, values[f.find(values)])
                    n[k] += np.bincount(found, minlength=len(f.table))
        for k, f in filters.items():
            some = np.flatnonzero(n[k])
            yield pa.RecordBatch.from_arrays([pa.array(f.table[some].astype(np.int64)), pa.array(n[k][some])], ["shingle", "n"])

    return run


def _occurrences(w, prefixes: Prefixes, filters: dict[int, _Filter]) -> Iterator[tuple[np.ndarray, int, np.ndarray]]:
    """Verified occurrences: the first words, the windows' length and numbers."""
    for k, (shingle, length_of, number, place) in prefixes.tables.items():
        at, values = w.shingles(k)
        some = filters[k].find(values)
        at, values = at[some], values[some]
        low, high = np.searchsorted(shingle, values), np.searchsorted(shingle, values, "right")
        ends = np.cumsum(high - low)
        cut = 0
        while cut < len(at):
            base = ends[cut - 1] if cut else 0
            to = max(cut + 1, int(np.searchsorted(ends, base + CANDIDATES_AT_ONCE, "right")))
            each = (high - low)[cut:to]
            row = np.repeat(low[cut:to], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            start = np.repeat(at[cut:to], each) - place[row]
            doc = np.repeat(w.owner[at[cut:to]], each)
            fits = (start >= w.bounds[doc]) & (start + length_of[row] <= w.bounds[doc + 1])
            start, row = start[fits], row[fits]
            for length in np.unique(length_of[row]):
                of = length_of[row] == length
                s, n = start[of], number[row[of]]
                words = prefixes.windows.words[int(length)]
                same = np.ones(len(s), bool)
                for j in range(int(length)):
                    same &= w.hashes[s + j] == words[n, j]
                yield s[same], int(length), n[same]
            cut = to


def _mark(prefixes: Prefixes):
    filters = {k: _Filter(np.unique(v[0])) for k, v in prefixes.tables.items()}
    names = np.array([*prefixes.windows.names, ""], object)

    def run(text: pa.Array) -> pa.Array:
        """n_words, the words hit as flat [begin, end) intervals, the items that occur."""
        n_words: list[int] = []
        hits: list[list[int]] = []
        items: list[list[str]] = []
        for t in texts(text):
            w = words_of(t)
            step = np.zeros(len(w.hashes) + 1, np.int64)
            owned = [np.zeros((0, 2), np.int64)]
            for start, length, number in _occurrences(w, prefixes, filters):
                np.add.at(step, start, 1)
                np.add.at(step, start + length, -1)
                first, owner = prefixes.windows.owners[length]
                pairs = np.unique(np.stack([w.owner[start], number], 1), axis=0) if len(start) else np.zeros((0, 2), np.int64)
                each = first[pairs[:, 1] + 1] - first[pairs[:, 1]]
                at = np.repeat(first[pairs[:, 1]], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                owned.append(np.unique(np.stack([np.repeat(pairs[:, 0], each), owner[at]], 1), axis=0))
            inside = np.cumsum(step[:-1]) > 0
            edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
            begin, end = np.flatnonzero(edge > 0), np.flatnonzero(edge < 0)
            pairs = np.unique(np.concatenate(owned), axis=0)
            pairs = pairs[pairs[:, 1] >= 0]
            n_words += np.diff(w.bounds).tolist()
            docs = np.arange(len(t) + 1)
            cut = np.searchsorted(pairs[:, 0], docs)
            spans = [[] for _ in range(len(t))]
            for b, e in zip(begin, end, strict=True):  # windows of neighbouring texts may touch
                for d in range(w.owner[b], w.owner[e - 1] + 1):
                    spans[d] += [int(max(b, w.bounds[d]) - w.bounds[d]), int(min(e, w.bounds[d + 1]) - w.bounds[d])]
            hits += spans
            items += [names[pairs[a:b, 1]].tolist() for a, b in zip(cut, cut[1:], strict=False)]
        return pa.StructArray.from_arrays([pa.array(n_words, pa.int64()), pa.array(hits, pa.list_(pa.int64())), pa.array(items, pa.list_(pa.string()))], ["n_words", "hits", "items"])

    return run


def prefixes(docs: DataFrame, items: DataFrame) -> Prefixes:
    """Windows of a bounded benchmark with their rarest shingles in all documents."""
    windows = Windows([tuple(r) for r in items.select("item_id", "text").collect()])
    counts = docs.select("text").mapInArrow(counted(windows.vocabulary()), "shingle bigint, n bigint")
    rows = counts.groupBy("shingle").agg(F.sum("n").alias("n")).collect()  # at most the benchmark's shingles
    return Prefixes(windows, {r["shingle"]: r["n"] for r in rows})


def mark(docs: DataFrame, benchmark: DataFrame, into: str = "marks", most_bytes: int = MOST_BYTES) -> DataFrame:
    """Every document with a struct ``into``: n_words, hits (flat word intervals), items (as strings, sorted)."""
    size = benchmark.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    if size > most_bytes:
        return mark_large(docs, benchmark, into)
    return docs.withColumn(into, F.arrow_udf(_mark(prefixes(docs, benchmark)), _MARKS)(F.col("text")))


# The join by shuffle


def _windows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """item, text -> window (its hash), length, words (their hashes), shingles, item."""
    for batch in batches:
        for t in texts(batch.column(1)):
            w = words_of(t)
            n = np.diff(w.bounds)
            for length in range(1, WINDOW + 1):
                own = np.flatnonzero(n >= WINDOW if length == WINDOW else n == length)
                if not len(own):
                    continue
                each = n[own] - length + 1
                at = np.repeat(w.bounds[own], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
                rows = w.hashes[at[:, None] + np.arange(length)]
                k = min(SHINGLE, length)
                shingles = np.stack([roll(w.hashes, at + j, k) for j in range(length - k + 1)], 1)
                stride = (np.arange(len(at) + 1) * 8 * length).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(roll(w.hashes, at, length).astype(np.int64)),
                        pa.array(np.full(len(at), length, np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(stride), pa.py_buffer(rows.tobytes())]),
                        pa.ListArray.from_arrays(pa.array((np.arange(len(at) + 1) * shingles.shape[1]).astype(np.int32)), pa.array(shingles.ravel().astype(np.int64))),
                        batch.column(0).take(pa.array(t.first + np.repeat(own, each))),
                    ],
                    ["window", "length", "words", "shingles", "item"],
                )


def _bucket_counts(sizes: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """text -> bucket, n: the task's shingles of the given numbers of words."""
        n = np.zeros(COUNT_BUCKETS, np.int64)
        for batch in batches:
            for t in texts(batch.column(0)):
                w = words_of(t)
                for k in sizes:
                    n += np.bincount((w.shingles(k)[1] % U64(COUNT_BUCKETS)).astype(np.int64), minlength=COUNT_BUCKETS)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], ["bucket", "n"])

    return run


def _rarest(n: np.ndarray):
    def run(shingles: pa.Array) -> pa.Array:
        """Of each window the place of the shingle whose bucket is least."""
        shingles = shingles.combine_chunks() if isinstance(shingles, pa.ChunkedArray) else shingles
        offsets = shingles.offsets.to_numpy()
        of = n[(shingles.flatten().to_numpy().astype(U64) % U64(COUNT_BUCKETS)).astype(np.int64)]
        starts, sizes = offsets[:-1] - offsets[0], np.diff(offsets)
        least = np.minimum.reduceat(of, starts) if len(starts) else of
        at = np.flatnonzero(of == np.repeat(least, sizes))
        owner = np.searchsorted(starts, at, "right") - 1
        _, first = np.unique(owner, return_index=True)
        return pa.array((at[first] - starts).astype(np.int32))

    return run


def _bitmaps(bits: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by chunk: chunk, shingle -> chunk, its bitmap of 8 KB."""
        for table, borders in whole_groups(batches, "chunk"):
            at = (table["shingle"].to_numpy().astype(U64) >> U64(64 - bits)) & U64(0xFFFF)
            chunks, maps = table["chunk"].to_numpy()[borders[:-1]], []
            for low, high in zip(borders, borders[1:], strict=False):
                on = np.zeros(1 << 16, bool)
                on[at[low:high].astype(np.int64)] = True
                maps.append(np.packbits(on, bitorder="little").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(chunks, pa.int32()), pa.array(maps, pa.binary())], ["chunk", "bitmap"])

    return run


def _asked(bitmap: np.ndarray, bits: int, sizes: list[int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """row, text -> a row per word whose shingle the bitmap has: shingle, row, at, n_words, context (the hashes of the words around)."""
        for batch in batches:
            for t in texts(batch.column(1)):
                w = words_of(t)
                padded = np.concatenate([np.zeros(BEFORE, U64), w.hashes, np.zeros(AFTER, U64)])
                for k in sizes:
                    at, values = w.shingles(k)
                    bit = values >> U64(64 - bits)
                    on = np.flatnonzero(bitmap[(bit >> U64(3)).astype(np.int64)] >> (bit & U64(7)).astype(np.uint8) & 1)
                    for low in range(0, len(on), 20_000):
                        some = on[low : low + 20_000]
                        place = at[some]
                        doc = w.owner[place]
                        context = padded[place[:, None] + np.arange(BEFORE + AFTER)]
                        stride = (np.arange(len(some) + 1) * 8 * (BEFORE + AFTER)).astype(np.int32)
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(values[some].astype(np.int64)),
                                batch.column(0).take(pa.array(t.first + doc)),
                                pa.array((place - w.bounds[doc]).astype(np.int64)),
                                pa.array((w.bounds[doc + 1] - w.bounds[doc]).astype(np.int64)),
                                pa.Array.from_buffers(pa.binary(), len(some), [None, pa.py_buffer(stride), pa.py_buffer(context.tobytes())]),
                            ],
                            ["shingle", "row", "at", "n_words", "context"],
                        )

    return run


def _merged(spans: pa.Array) -> pa.Array:
    """Sorted structs of start and end -> flat intervals that do not touch."""
    out = []
    for some in spans.to_pylist():
        flat: list[int] = []
        for s in some or ():
            if flat and s["start"] <= flat[-1]:
                flat[-1] = max(flat[-1], s["end"])
            else:
                flat += [s["start"], s["end"]]
        out.append(flat)
    return pa.array(out, pa.list_(pa.int64()))


def _count_words(text: pa.Array) -> pa.Array:
    return pa.array(np.concatenate([np.zeros(0, np.int64), *[np.diff(words_of(t).bounds) for t in texts(text)]]))


def mark_large(docs: DataFrame, benchmark: DataFrame, into: str) -> DataFrame:
    """As ``mark``, for a benchmark of any size: windows and words meet by shuffle on the windows' rarest shingles."""
    items = benchmark.select(F.col("item_id").cast("string"), "text")
    cut = staged(items.mapInArrow(_windows_of, "window bigint, length int, words binary, shingles array<bigint>, item string"), "windows")
    own = cut.where("item is not null").select("window", "length", "item").distinct()
    one = cut.groupBy("window", "length").agg(F.first("words").alias("words"), F.first("shingles").alias("shingles"))
    sizes = sorted({min(SHINGLE, r["length"]) for r in cut.select("length").distinct().collect()})  # at most 13 rows
    counts = docs.select("text").mapInArrow(_bucket_counts(sizes), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    n = np.zeros(COUNT_BUCKETS, np.int64)
    for r in counts.collect():  # a row per bucket
        n[r["bucket"]] = r["n"]
    place = F.arrow_udf(_rarest(n), T.IntegerType())("shingles")
    prefix = staged(one.withColumn("place", place).select("window", "length", "words", "place", F.get("shingles", F.col("place")).alias("shingle")), "prefixes")
    bits = min(MOST_BITS, max(20, int(prefix.count()).bit_length() + 3))
    chunk = F.shiftrightunsigned("shingle", 64 - bits + 16).cast("int").alias("chunk")
    rows = prefix.select(chunk, "shingle").repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_bitmaps(bits), "chunk int, bitmap binary")
    bitmap = np.zeros(1 << bits - 3, np.uint8)
    for r in rows.collect():  # each piece of the bitmap once: 32 MB at most
        part = np.frombuffer(r["bitmap"], np.uint8)
        bitmap[r["chunk"] * len(part) : (r["chunk"] + 1) * len(part)] = part
    row, found_in = free(docs, "row"), free(docs, "found")
    numbered = staged(docs.withColumns({row: F.monotonically_increasing_id(), into: F.arrow_udf(_count_words, T.LongType())("text")}), "numbered")
    asked = numbered.select(row, "text").mapInArrow(_asked(bitmap, bits, sizes), "shingle bigint, row bigint, at bigint, n_words bigint, context binary")
    start = F.col("at") - F.col("place")
    said = F.substring("context", (F.lit(BEFORE) - F.col("place")) * 8 + 1, F.col("length") * 8)
    met = asked.join(prefix, "shingle").where((start >= 0) & (start + F.col("length") <= F.col("n_words")) & (said == F.col("words")))
    met = staged(met.select("row", start.alias("start"), (start + F.col("length")).alias("end"), "window", "length"), "met")
    spans = met.select("row", F.struct("start", "end").alias("s")).groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("spans"))
    names = met.select("row", "window", "length").distinct().join(own, ["window", "length"]).select("row", "item").distinct()
    names = names.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    found = spans.join(names, "row", "left").select(F.col("row").alias(row), F.struct("spans", "items").alias(found_in))
    seen = numbered.join(found, row, "left")
    spans, items = F.col(found_in)["spans"], F.coalesce(F.col(found_in)["items"], F.array().cast("array<string>"))
    marks = F.struct(F.col(into).alias("n_words"), F.arrow_udf(_merged, T.ArrayType(T.LongType()))(spans).alias("hits"), items.alias("items"))
    return seen.withColumn(into, marks).select(*docs.columns, into)


def n_hit(marks: Column) -> Column:
    return F.aggregate(F.transform(marks["hits"], lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("bigint"), lambda a, x: a + x)


def contaminated(marks: Column) -> Column:
    n = n_hit(marks)
    return (n > 0) & (20 * n >= marks["n_words"])


def contamination(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of every document."""
    seen = mark(docs.select("doc_id", "text"), benchmark, "marks", most_bytes)
    m = seen["marks"]
    return seen.select(
        "doc_id",
        m["n_words"].alias("n_words"),
        n_hit(m).alias("n_hit"),
        F.size(m["items"]).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(m["items"], ","), 256).alias("items_sha256"),
        contaminated(m).alias("contaminated"),
    )


def decontaminate(docs: DataFrame, benchmark: DataFrame, most_bytes: int = MOST_BYTES) -> DataFrame:
    """The documents that are not contaminated, with the columns they came with."""
    into = free(docs, "marks")
    seen = mark(docs, benchmark, into, most_bytes)
    return seen.where(~contaminated(seen[into])).drop(into)
