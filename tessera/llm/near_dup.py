"""N-gram Jaccard join with Bayesian candidate pruning.

Texts are sets of five-word shingles (a text of one to four words is one
shingle). Two documents are linked when the Jaccard similarity of their sets is
at least 0.8. The steps:

1. Each text becomes a key (its word sequence) and 80 MinHash values of 16 bits,
   in 20 bands of 4. Documents with equal keys are one class, counted, not paired.
2. Classes that share a band's bucket are candidates: a similarity of 0.8 is
   missed with a chance of (1 - 0.8**4)**20 = 3e-5. A large bucket is dealt into
   blocks of about 256 texts or 16 MB, and each pair of blocks is one group, so that no
   group exceeds about two blocks and the work on a hot bucket spreads over tasks.
3. In a group, a pair is looked at only in the first band it shares. Its MinHash
   values are compared twenty at a time, and it is dropped as soon as the posterior
   chance of reaching the threshold, under a uniform prior, is below 1e-6.
4. What is left is verified exactly on the shingle sets.
5. Linked classes form connected components; each group sends on a spanning forest
   and sums, never its pairs. Components are merged by alternating large-star and
   small-star rounds on tables in the shared folder.

Defined cases: a null text or one without words has no shingles, no link, and is a
class of its own (class_id = its doc_id). A null doc_id is allowed; class_id is then
the least non-null doc_id of the class, if there is one. Repeated rows are copies of
one another. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.batches import whole_groups
from tessera.llm.staging import free, staged
from tessera.llm.words import _BASE, U64, _power, mix, roll, texts, words_of

WORDS, SIMILARITY = 5, 0.8
BANDS, ROWS = 20, 4
HASHES = BANDS * ROWS
STEP = 20
BLOCK = 256
#: A text counts once more for each so many bytes of it when blocks are cut
WEIGHT_BYTES = 1 << 16
BYTES_AT_ONCE = 4 << 20
PAIRS_AT_ONCE = 50_000
_WORDED = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
_rng = np.random.default_rng(77)
_A = _rng.integers(0, 1 << 63, HASHES, dtype=U64) * U64(2) + U64(1)
_B = _rng.integers(0, 1 << 63, HASHES, dtype=U64)


def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """For n compared values, the least number of matches that keeps a pair.

    With a uniform prior, P(s >= t | m of n match) = P(Binomial(n + 1, t) <= m).
    """
    out = {}
    for n in range(STEP, HASHES + 1, STEP):
        total, m = 0.0, -1
        while total < tolerance:
            m += 1
            total += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
        out[n] = m
    return out


def shingle_sets(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[int, list[np.ndarray]]]:
    """By slices: the index of the first text, each text's sorted shingle hashes."""
    for t in texts(column):
        w, at, hashes = _shingled(t)
        owner = w.owner[at]
        order = np.lexsort((hashes, owner))
        owner, hashes = owner[order], hashes[order]
        new = np.ones(len(order), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
        owner, hashes = owner[new], hashes[new]
        bounds = np.searchsorted(owner, np.arange(len(t) + 1))
        yield t.first, [hashes[a:b] for a, b in zip(bounds, bounds[1:], strict=False)]


def _shingled(t):
    w = words_of(t)
    at, hashes = w.shingles(WORDS)
    n = np.diff(w.bounds)
    for k in range(1, WORDS):
        short = w.bounds[:-1][n == k]
        at, hashes = np.concatenate([at, short]), np.concatenate([hashes, roll(w.hashes, short, k)])
    return w, at, hashes


def _keys(w) -> list[bytes | None]:
    """128 bits over each text's word sequence."""
    up, down = _power(len(w.hashes))
    starts, ends, halves = w.bounds[:-1], w.bounds[1:], []
    for values in (w.hashes, mix(w.hashes ^ U64(_BASE))):
        sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[: len(values)], dtype=U64)])
        halves.append(mix((sums[ends] - sums[starts]) * down[starts] + U64(1)))
    both = np.stack(halves, 1)
    return [k.tobytes() if n else None for k, n in zip(both, ends - starts, strict=True)]


def fingerprints(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, text, other columns -> doc_id, key, weight by length, the bands of its signature as 64-bit values, and the other columns."""
    for batch in batches:
        keys, bands, weights = [], [], [np.zeros(0, np.int64)]
        for t in texts(batch.column(1)):
            w, at, hashes = _shingled(t)
            keys += _keys(w)
            weights.append(1 + np.diff(t.bounds) // WEIGHT_BYTES)
            order = np.argsort(w.owner[at], kind="stable")
            owner, hashes = w.owner[at][order], hashes[order]
            full, first = np.unique(owner, return_index=True)
            least = np.zeros((len(t), HASHES), np.uint16)
            if len(full):
                for i in range(HASHES):
                    values = ((hashes * _A[i] + _B[i]) >> U64(32)).astype(np.uint32)
                    least[full, i] = np.minimum.reduceat(values, first) & 0xFFFF
            bands.append(least.view(np.int64).ravel())
        flat = pa.array(np.concatenate(bands) if bands else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
        columns = [batch.column(0), pa.array(keys, pa.binary()), pa.array(np.concatenate(weights)), lists, *batch.columns[2:]]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "key", "weight", "bands", *batch.schema.names[2:]])


def first_texts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> key, text of the first row of each key in the task; texts without words are left out."""
    seen: set[bytes | None] = {None}
    for batch in batches:
        keys = _keys_of(batch.column(0)).to_pylist()
        new = []
        for i, key in enumerate(keys):
            if key not in seen:
                seen.add(key)
                new.append(i)
        yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in new], pa.binary()), batch.column(0).take(pa.array(new, pa.int64()))], ["key", "text"])


def _pairs(borders: np.ndarray, side: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs inside groups; in a group of two blocks, those between them. At most PAIRS_AT_ONCE or a group's."""
    sizes, starts = np.diff(borders), borders[:-1]
    two = np.maximum.reduceat(side, starts) > 0 if len(starts) else np.zeros(0, bool)
    for s in range(2, 17):
        of = starts[(sizes == s) & ~two]
        a, b = np.triu_indices(s, 1)
        step = max(1, PAIRS_AT_ONCE // len(a))
        for k in range(0, len(of), step):
            base = of[k : k + step, None]
            yield (base + a).ravel(), (base + b).ravel()
    for g in np.flatnonzero((sizes > 16) | two):
        rows = np.arange(borders[g], borders[g + 1])
        if two[g]:
            left, right = rows[side[rows] == 0], rows[side[rows] == 1]
            yield np.repeat(left, len(right)), np.tile(right, len(left))
        else:
            a, b = np.triu_indices(len(rows), 1)
            yield rows[a], rows[b]


def _prune(bands: np.ndarray, band: np.ndarray, i: np.ndarray, j: np.ndarray, least: dict[int, int]) -> np.ndarray:
    """Which of the pairs share this band first and may still reach the threshold."""
    keep = np.flatnonzero((bands[i] == bands[j]).argmax(1) == band[i])
    values = bands.view(np.uint16)
    matches, done = np.zeros(len(keep), np.int64), 0
    for n, m in least.items():
        matches = matches + (values[i[keep], done:n] == values[j[keep], done:n]).sum(1)
        on = matches >= m
        keep, matches, done = keep[on], matches[on], n
    return keep


def pruned(least: dict[int, int]):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by task -> the members of each task that have a candidate left, with their partners' keys."""
        for table, borders in whole_groups(batches, "task"):
            bands = table["bands"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, BANDS).copy()
            band, side = table["band"].to_numpy(), table["side"].to_numpy()
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for i, j in _pairs(borders, side):
                for k in range(0, len(i), PAIRS_AT_ONCE):
                    a, b = i[k : k + PAIRS_AT_ONCE], j[k : k + PAIRS_AT_ONCE]
                    on = _prune(bands, band, a, b, least)
                    left.append(a[on])
                    right.append(b[on])
            left, right = np.concatenate(left), np.concatenate(right)
            order = np.argsort(left, kind="stable")
            left, right = left[order], right[order]
            rows = np.union1d(left, right)
            keys = table["key"].combine_chunks()
            offsets = np.concatenate([np.searchsorted(left, rows), [len(left)]]).astype(np.int32)
            partners = pa.ListArray.from_arrays(pa.array(offsets), keys.take(pa.array(right)))
            out = table.select(["task", "key", "copies"]).take(pa.array(rows)).append_column("partners", partners)
            yield from out.to_batches(max_chunksize=20_000)

    return run


def _jaccard(sets: list[np.ndarray], pairs: np.ndarray) -> np.ndarray:
    """Exact similarity of the pairs of rows."""
    sizes = np.array([len(s) for s in sets])
    if len(pairs) <= 32:
        common = np.array([len(np.intersect1d(sets[a], sets[b], assume_unique=True)) for a, b in pairs])
    else:
        used = np.unique(pairs)
        row = np.zeros(len(sets), np.int64)
        row[used] = np.arange(len(used))
        values, ids, n = np.unique(np.concatenate([sets[r] for r in used]), return_inverse=True, return_counts=True)
        rows = np.repeat(np.arange(len(used)), sizes[used])
        shared = n[ids] > 1
        rank = np.cumsum(n > 1) - 1
        rows, ids = rows[shared], rank[ids[shared]]
        order = np.argsort(ids, kind="stable")
        rows, ids = rows[order], ids[order]
        counts = np.zeros((len(used), len(used)), np.float64)
        for low in range(0, int(ids[-1]) + 1 if len(ids) else 0, 4096):
            a, b = np.searchsorted(ids, [low, low + 4096])
            dense = np.zeros((len(used), 4096), np.float32)
            dense[rows[a:b], ids[a:b] - low] = 1
            counts += dense @ dense.T
        common = counts[row[pairs[:, 0]], row[pairs[:, 1]]]
    return common / np.maximum(sizes[pairs[:, 0]] + sizes[pairs[:, 1]] - common, 1)


def _links_of(table: pa.Table, borders: np.ndarray, threshold: float) -> pa.RecordBatch:
    """Of whole groups: per key its links to other keys (copies counted) and a key of its part of the component."""
    keys, copies = table["key"].combine_chunks(), table["copies"].to_numpy()
    lists = table["partners"].combine_chunks()
    n = len(keys)
    group = np.repeat(np.arange(len(borders) - 1), np.diff(borders))
    # a key and its group as one number
    rows = _halves(keys) + mix(group.astype(U64))
    partners = _halves(lists.flatten()) + mix(np.repeat(group, np.diff(lists.offsets.to_numpy())).astype(U64))
    left = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    order = np.argsort(rows, kind="stable")
    at = np.minimum(np.searchsorted(rows[order], partners), n - 1)
    known = rows[order][at] == partners
    pairs = np.stack([left[known], order[at[known]]], 1)
    near = [np.zeros((0, 2), np.int64)]
    cut = np.searchsorted(pairs[:, 0], borders)
    weigh = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(table["text"]), 0).to_numpy())])
    g = 0
    while g < len(borders) - 1:  # whole groups of so many bytes
        to = max(g + 1, int(np.searchsorted(weigh[borders], weigh[borders[g]] + BYTES_AT_ONCE, "right")) - 1)
        sets: list[np.ndarray] = []
        for _, some in shingle_sets(table["text"].slice(borders[g], borders[to] - borders[g])):
            sets += some
        for k in range(g, to):
            mine = pairs[cut[k] : cut[k + 1]] - borders[k]
            if len(mine):
                own = sets[borders[k] - borders[g] : borders[k + 1] - borders[g]]
                near.append(mine[_jaccard(own, mine) >= threshold - 1e-12] + borders[k])
        g = to
    a, b = np.concatenate(near).T
    label = np.arange(n)
    while True:  # no pair leaves its group
        before = label.copy()
        np.minimum.at(label, a, label[b])
        np.minimum.at(label, b, label[a])
        if (label == before).all():
            break
    links = np.bincount(a, copies[b], n) + np.bincount(b, copies[a], n)
    some = np.flatnonzero(links)
    return pa.RecordBatch.from_arrays([keys.take(pa.array(some)), pa.array(links[some].astype(np.int64)), keys.take(pa.array(label[some]))], ["key", "links", "root"])


def _halves(keys: pa.Array) -> np.ndarray:
    """64 of the 128 bits of each key."""
    if not len(keys):
        return np.zeros(0, U64)
    start = int(np.frombuffer(keys.buffers()[1], np.int32)[keys.offset])
    return np.frombuffer(keys.buffers()[2], U64, len(keys) * 2, start)[::2]


def verified(threshold: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sorted by task -> the links of each task's members and their parts of components."""
        for table, borders in whole_groups(batches, "task"):
            yield _links_of(table, borders, threshold)

    return run


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(a, b) edges -> (node, root): the least node of each connected component.

    Alternating large-star and small-star rounds; each is a table in the shared
    folder. Rounds grow with the logarithm of the longest path.
    """
    edges = staged(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    seen = None
    for _ in range(most_rounds):
        both = edges.union(edges.select("b", "a"))
        # the least neighbours are tables too: between plain exchanges a hub's edges can be split over tasks
        low = staged(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), F.least("a", "m").alias("m")), "low")
        large = both.join(low, both["a"] == low["n"]).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = staged(large, "large")
        low = staged(large.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("n"), "m"), "low")
        small = large.join(low, large["a"] == low["n"]).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = staged(small.union(low.select("n", "m")).distinct(), "edges")
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen = now
    raise RuntimeError("connected components have not settled")


def near_duplicates(docs: DataFrame, threshold: float = SIMILARITY, tolerance: float = 1e-6) -> DataFrame:
    """doc_id, key, root, class_id, n_links of every document.

    class_id is the least doc_id of the documents that chains of links connect;
    n_links is the number of other documents whose similarity reaches the threshold,
    copies included. key names equal word sequences (null: no words), root the least key of
    the class, which tells classes apart even where doc_ids repeat.
    """
    return _classified(docs.select(F.col("doc_id").cast("bigint"), "text"), threshold, tolerance)


def _classified(docs: DataFrame, threshold: float, tolerance: float = 1e-6) -> DataFrame:
    """The same of doc_id and text, with the bigint columns that follow them."""
    more = docs.columns[2:]
    kind = ", ".join(["doc_id bigint, key binary, weight bigint, bands array<bigint>", *[f"`{c}` bigint" for c in more]])
    prints = staged(docs.mapInArrow(fingerprints, kind), "prints")
    docs = docs.select("doc_id", "text")
    # band by band, since Spark sums numbers by hashing, arrays by sorting
    bands = [F.first(F.get("bands", F.lit(i))).alias(f"b{i}") for i in range(BANDS)]
    classes = prints.where("key is not null").groupBy("key").agg(F.count("*").alias("copies"), F.min("doc_id").alias("rep"), F.max("weight").alias("weight"), *bands)
    classes = staged(classes.select("key", "copies", "rep", "weight", F.array(*[f"b{i}" for i in range(BANDS)]).alias("bands")), "classes")
    links = staged(_links(docs, classes, threshold, tolerance), "links")
    roots = components(links.select(F.col("key").alias("a"), F.col("root").alias("b")))
    linked = links.groupBy("key").agg(F.sum("links").alias("links"))
    known = classes.select("key", "copies", "rep").join(linked, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    known = known.withColumn("root", F.coalesce("root", "key"))
    ids = known.groupBy("root").agg(F.min("rep").alias("class_id"))
    known = known.join(ids, "root").select("key", "root", "class_id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
    return (
        prints.select("doc_id", "key", *more)
        .join(known, "key", "left")
        .select("doc_id", "key", *more, "root", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )


def keep_one(docs: DataFrame, threshold: float = SIMILARITY) -> DataFrame:
    """Of each class one document stays whole: the least doc_id, then the least hash of its words and of its row.

    Rows that are equal in all columns to one that stays go. Texts without words are classes of
    their own and stay. Which rows stay is found on two hashes of the whole row, 128 bits, so that whole rows are
    dealt once, to the table of those that stay. Only rows that are there more than once are dealt again.
    """
    one, two, number = (free(docs, n) for n in ("one", "two", "number"))
    row = [docs[f"`{c}`"] for c in docs.columns]
    row += [c.isNull() for c in row]  # a hash passes nulls over
    marks = {one: F.xxhash64(*row), two: F.xxhash64(F.lit(7), *row)}
    known = _classified(docs.select(F.col("doc_id").cast("bigint"), "text", *[c.alias(n) for n, c in marks.items()]), threshold)
    rows = known.where("key is not null").groupBy("root", "doc_id", "key", one, two).agg(F.count("*").alias("n"))
    best = rows.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "key", one, two, "n")).alias("best"))
    best = staged(best.select(*[F.col("best")[c].alias(c) for c in (one, two, "n")]), "staying")
    marked = docs.withColumns(marks)
    single = marked.join(best.where("n = 1").drop("n").hint("shuffle_hash"), [one, two], "left_semi")  # no sort of whole rows
    order = Window.partitionBy(one, two).orderBy(one)
    several = marked.join(best.where("n > 1").drop("n"), [one, two], "left_semi").withColumn(number, F.row_number().over(order)).where(F.col(number) == 1)
    worded = F.coalesce(F.col("text").rlike(_WORDED), F.lit(False))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return single.select(*kept).unionByName(several.select(*kept)).unionByName(docs.where(~worded))


def _keys_of(text: pa.Array) -> pa.Array:
    return pa.array([k for t in texts(text) for k in _keys(words_of(t))], pa.binary())


def _links(docs: DataFrame, classes: DataFrame, threshold: float, tolerance: float) -> DataFrame:
    spots = classes.select("key", "weight", F.posexplode("bands").alias("band", "value")).select("key", "weight", "band", F.xxhash64("band", "value").alias("bucket"))
    shared = spots.groupBy("bucket").agg(F.count("*").alias("n"), F.sum("weight").alias("weight")).where("n > 1").select(F.col("bucket").alias("same"), F.ceil(F.col("weight") / BLOCK).alias("blocks"))
    spots = spots.join(shared, spots["bucket"] == shared["same"]).withColumn("own", F.pmod(F.xxhash64("key"), "blocks"))
    spots = spots.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    low, high = F.least("own", "other"), F.greatest("own", "other")
    spots = spots.select("key", F.col("band").cast("int"), F.xxhash64("bucket", low, high).alias("task"), (F.col("own") > F.col("other")).cast("int").alias("side"))
    members = spots.join(classes, "key").select("task", "band", "side", "key", "copies", "bands")
    left = members.repartition("task").sortWithinPartitions("task")
    kept = left.mapInArrow(pruned(least_matches(threshold, tolerance)), "task bigint, key binary, copies bigint, partners array<binary>")
    kept = staged(kept, "candidates")
    # one text per key, as doc_ids may be null or repeat; only keys with a candidate go on, found by hashing, as sorting
    # would sort whole texts; a hash table holds a partition's keys, which are a small part of its texts
    asked = kept.select("key").distinct().hint("shuffle_hash")
    told = docs.select("text").mapInArrow(first_texts, "key binary, text string").join(asked, "key", "left_semi")
    told = told.groupBy("key").agg(F.first("text").alias("text"))
    kept = kept.join(told, "key").select("task", "key", "copies", "partners", "text")
    return kept.repartition("task").sortWithinPartitions("task").mapInArrow(verified(threshold), "key binary, links bigint, root binary")
