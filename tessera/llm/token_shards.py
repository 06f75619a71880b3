"""Token ids in training order, as fixed-stride binary rows.

1. Each task tokenises its documents whole, ends each with the end-of-text id, and
   cuts the run into sequences of ``length`` ids, little-endian in the smallest width
   that holds the vocabulary; the last one of a task is filled up with end-of-text
   ids. The sequences go to a table in the shared folder.
2. Sequences are numbered by task and place. A keyed Feistel network over the next
   even number of bits, applied again while it leaves the range (cycle-walking), turns
   the numbers into a permutation: every sequence's global slot.
3. Ranges of ``per_shard`` slots are the shards, one partition each, in order, so that
   slot s is row s % per_shard of shard s // per_shard. ``per_shard`` grows with the
   corpus so that there are at most ``MOST_SHARDS``.

``write_shards`` writes each partition as one raw file, without another exchange: slot s
starts at byte ``stride`` * (s % per_shard) of its shard's file, where the stride is the ids' bytes and
one line feed, since Spark's text writer ends every row. A reader that stopped
after slot s seeks to slot s + 1.

The vocabulary is a file of ranks (base64 token, rank) on every executor; its path is
a parameter. Only the number of sequences per task is gathered on the driver.

Defined cases: a null text is an empty one, and an empty document is its end-of-text
id alone. Null doc_ids stay null in the lists. Repeated rows are tokenised each.
Strings of special tokens in a text are ordinary text. A run of white space of any length is encoded as the
pattern has it. An empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import base64
import functools
import os
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.staging import staged
from tessera.llm.words import U64, mix, release

VOCABULARY = os.environ.get("TESSERA_VOCABULARY", "/opt/tokenizers/byte_bpe_50k.tiktoken")
LENGTH, PER_SHARD, KEY = 1024, 4096, 20240229
#: Fixed value: how this vocabulary splits a text before merging
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MOST_SHARDS = 100_000
CHARS_AT_ONCE = 1 << 20
#: What the pattern takes for white space. It goes back over a run sign by sign, so the time grows with a run's square, and it fails on very long ones.
_RUN = re.compile("[\\t-\\r\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]{100,}")


@functools.cache
def encoding(path: str):
    """The tokenizer, once per Python worker, and the id after its last as end-of-text."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("tessera", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), max(ranks.values()) + 1


def encode(encoder, text: str) -> Iterator[np.ndarray]:
    """The ids of a whole text, in parts.

    A run of white space before another sign is one piece but for its last sign, which begins what follows; at the
    text's end it is one piece. So long runs are merged by themselves and the ids stay those of the text.
    """
    at = 0
    for run in _RUN.finditer(text):
        end = run.end() - (run.end() < len(text))
        yield encoder.encode_to_numpy(text[at : run.start()], disallowed_special=())
        yield np.array(encoder._encode_single_piece(text[run.start() : end]), np.uint32)
        at = end
    yield encoder.encode_to_numpy(text[at:] if at else text, disallowed_special=())


def sequences(path: str, length: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> part, seq, doc_ids, n_tokens, tokens."""
        encoder, end = encoding(path)
        width = np.dtype(np.uint16 if end < 1 << 16 else np.uint32)
        part = TaskContext.get().partitionId()
        # ids of no full sequence yet, whose they are, and where each document begins in them
        rest, of_rest, at_rest, done = np.zeros(0, width), pa.array([], pa.int64()), np.zeros(0, np.int64), 0

        def cut(ids: np.ndarray, starts: np.ndarray, docs: pa.Array, n: int) -> pa.RecordBatch:
            """The first n sequences of a run of documents."""
            nonlocal done
            first = np.searchsorted(starts, np.arange(n) * length, "right") - 1
            last = np.searchsorted(starts, np.minimum((np.arange(n) + 1) * length, len(ids)), "left")
            each = last - first
            offsets = np.concatenate([[0], np.cumsum(each)])
            at = np.repeat(first - offsets[:-1], each) + np.arange(offsets[-1])
            filled = np.full(n, length)
            filled[-1] = min(length, len(ids) - (n - 1) * length)
            data = ids[: n * length]
            if len(data) < n * length:
                data = np.concatenate([data, np.full(n * length - len(data), end, width)])
            stride = length * width.itemsize
            columns = [
                pa.array(np.full(n, part, np.int32)),
                pa.array(np.arange(done, done + n)),
                pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), docs.take(pa.array(at))),
                pa.array(filled.astype(np.int32)),
                pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((np.arange(n + 1) * stride).astype(np.int32)), pa.py_buffer(data.tobytes())]),
            ]
            done += n
            return pa.RecordBatch.from_arrays(columns, ["part", "seq", "doc_ids", "n_tokens", "tokens"])

        def some(texts: pa.Array) -> Iterator[tuple[int, int]]:
            """Rows from and to, of about so many characters."""
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            i = 0
            while i < len(texts):
                j = max(i + 1, int(np.searchsorted(sizes, (sizes[i - 1] if i else 0) + CHARS_AT_ONCE, "right")))
                yield i, j
                i = j

        for batch in batches:
            for i, j in some(batch.column(1)):
                ids, sizes = [rest], []
                for text in batch.column(1).slice(i, j - i):
                    parts = [*encode(encoder, text.as_py() or ""), np.array([end], width)]
                    ids += [p.astype(width) for p in parts]
                    sizes.append(sum(map(len, parts)))
                run_of = np.concatenate(ids)
                starts = np.concatenate([at_rest, len(rest) + np.cumsum([0, *sizes[:-1]])])
                docs = pa.concat_arrays([of_rest, batch.column(0).slice(i, j - i)])
                n = len(run_of) // length
                if n:
                    yield cut(run_of, starts, docs, n)
                rest = run_of[n * length :].copy()
                kept = int(np.searchsorted(starts, n * length, "right")) - 1 if len(rest) else len(docs)
                at_rest, of_rest = np.maximum(starts[kept:] - n * length, 0), docs.slice(kept)
            release()
        if len(rest):
            yield cut(rest, at_rest, of_rest, 1)

    return run


def feistel(numbers: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of 0 .. n - 1, applied to some of its members."""
    half = U64(max(1, -(-(n - 1).bit_length() // 2)))
    mask = (U64(1) << half) - U64(1)
    keys = mix(np.arange(1, rounds + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(key & (1 << 64) - 1))
    out = numbers.astype(U64)
    walk = np.ones(len(out), bool)
    while walk.any():
        x = out[walk]
        left, right = x >> half, x & mask
        for k in keys:
            left, right = right, left ^ (mix(right ^ k) & mask)
        out[walk] = left << half | right
        walk[walk] = out[walk] >= n
    return out.astype(np.int64)


def _slots(firsts: dict[int, int], n: int, key: int):
    first = np.zeros(max(firsts, default=0) + 1, np.int64)
    for part, number in firsts.items():
        first[part] = number

    def run(part: pa.Array, seq: pa.Array) -> pa.Array:
        return pa.array(feistel(first[part.to_numpy()] + seq.to_numpy(), n, key))

    return run


def training_order(docs: DataFrame, vocabulary: str = VOCABULARY, length: int = LENGTH, per_shard: int = PER_SHARD, key: int = KEY) -> DataFrame:
    """slot, shard, row (in the shard), doc_ids, n_tokens, tokens of every sequence; partition k is shard k, in order."""
    made = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(sequences(vocabulary, length), "part int, seq bigint, doc_ids array<bigint>, n_tokens int, tokens binary")
    made = staged(made, "sequences")
    counts = made.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()  # a row per task
    n = sum(r["n"] for r in counts)
    firsts = dict(zip([r["part"] for r in counts], np.cumsum([0, *[r["n"] for r in counts]]).tolist(), strict=False))
    per_shard = max(per_shard, -(-n // MOST_SHARDS))
    slot = F.arrow_udf(_slots(firsts, n, key), T.LongType())("part", "seq")
    placed = made.select(slot.alias("slot"), "doc_ids", "n_tokens", "tokens")
    shard, row = F.floor(F.col("slot") / per_shard).cast("int"), (F.col("slot") % per_shard).cast("int")
    placed = placed.select("slot", shard.alias("shard"), row.alias("row"), "doc_ids", "n_tokens", "tokens")
    return placed.repartitionById(max(1, -(-n // per_shard)), F.col("shard")).sortWithinPartitions("shard", "slot")


def write_shards(ordered: DataFrame, path: str) -> None:
    """``path``/shard=k/: one raw file of the rows' ids in order, each followed by a line feed.

    A failed task's file is written again as a whole, at a name of its own.
    """
    rows = ordered.select("shard", F.col("tokens").cast("string").alias("value"))  # bytes as they are
    rows.write.partitionBy("shard").option("lineSep", "\n").text(path)


def read_from(spark: SparkSession, path: str, slot: int, stride: int, per_shard: int = PER_SHARD) -> DataFrame:
    """slot and tokens from a slot on, in order; earlier shards are not opened, earlier rows are skipped by their offset."""
    files = spark.read.format("binaryFile").load(path).where(F.col("shard") >= slot // per_shard)
    first = F.col("shard").cast("bigint") * per_shard
    skip = F.greatest(F.lit(slot) - first, F.lit(0)).cast("int")
    rows = F.floor(F.col("length") / stride).cast("int")
    at = files.where(skip < rows).select(first.alias("first"), "content", F.explode(F.sequence(skip, rows - 1)).alias("row"))
    return at.select((F.col("first") + F.col("row")).alias("slot"), F.substring("content", F.col("row") * stride + 1, F.lit(stride - 1)).alias("tokens")).orderBy("slot")
