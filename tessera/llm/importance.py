"""Quality by importance resampling.

Two generative models of hashed n-grams (words and their beginnings, word pairs, tokens as
written): the target, from documents labelled as good and not toxic, and the raw text, from
all documents. A document's log weight is the
sum of the log ratios of its n-grams; Gumbel noise, a hash of the document, is added
to it, and the k documents with the largest sums are kept, which samples k documents
without replacement in proportion to their weights.

The target is fitted to at most ``max_labelled`` labelled documents, those with the
least hashes; the raw model counts every document, summed per task and then by bucket.
k is ``keep_share`` of all documents, by default the share of good ones among those
labels. The k-th largest sum is found exactly by counting, 16 bits at a time, so that
nothing is sorted or gathered.

Defined cases: a null or empty text, or one of white space, has no n-grams and log weight 0, and is never
kept. Documents with equal ids and texts have equal sums; all that tie with the k-th
are kept. Labels with nulls in any column are left out; conflicting labels of a
doc_id make it no target. Without any good label the target is the raw model, and
keep_share is 1. Empty tables give an empty result. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.staging import staged
from tessera.llm.words import ALNUM, POINT, U64, Texts, mix, texts, words_of

BUCKETS = 1 << 18
#: Lengths of word beginnings, in code points
BEGINNINGS = (3, 4, 5, 6)
MAX_LABELLED = 20_000
PSEUDO, SHRINK, SIGMAS = 0.5, 1.0, 3.0


def _ngrams(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and text of every word, its beginnings, every word pair, and every token between white space as it is written."""
    w, raw = words_of(t), words_of(t, lower=False)
    at, pairs = w.shingles(2)
    word, begin = _beginnings(t)
    hashes = np.concatenate([w.hashes, begin, pairs, mix(raw.hashes)])
    return (hashes % U64(BUCKETS)).astype(np.int64), np.concatenate([w.owner, w.owner[word], w.owner[at], raw.owner])


def _beginnings(t: Texts) -> tuple[np.ndarray, np.ndarray]:
    """Word number and hash of each proper beginning; they meet inflected and compound words that are rare themselves."""
    starts, ends = t.segments(ALNUM[t.data])
    points = np.append(np.flatnonzero(POINT[t.data]), len(t.data))
    first = np.searchsorted(points, starts)
    word, until, salt = [], [], []
    for n in BEGINNINGS:
        stop = points[np.minimum(first + n, len(points) - 1)]
        longer = np.flatnonzero(stop < ends)
        word.append(longer)
        until.append(stop[longer])
        salt.append(np.full(len(longer), n, U64))
    word = np.concatenate(word)
    return word, mix(t.hashes(starts[word], np.concatenate(until), lower=True) + np.concatenate(salt))


def counted(targets: np.ndarray):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """doc_id, text -> bucket, of all documents, of targets: sums of a task."""
        every, good = np.zeros(BUCKETS, np.int64), np.zeros(BUCKETS, np.int64)
        for batch in batches:
            wanted = np.isin(batch.column(0).fill_null(-(1 << 63)).to_numpy(), targets)
            for t in texts(batch.column(1)):
                buckets, owner = _ngrams(t)
                every += np.bincount(buckets, minlength=BUCKETS)
                on = wanted[t.first : t.first + len(t)]
                if on.any():
                    good += np.bincount(buckets[on[owner]], minlength=BUCKETS)
        some = np.flatnonzero(every)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(every[some]), pa.array(good[some])], ["bucket", "n", "good"])

    return run


def _weights(ratio: np.ndarray):
    def run(text: pa.Array) -> pa.Array:
        out = [np.zeros(0)]
        for t in texts(text):
            buckets, owner = _ngrams(t)
            weight = np.bincount(owner, ratio[buckets], len(t))
            weight[np.bincount(owner, minlength=len(t)) == 0] = np.nan
            out.append(weight)
        return pa.array(np.concatenate(out), from_pandas=True)  # null without n-grams

    return run


def _labelled(labels: DataFrame, most: int) -> tuple[np.ndarray, float]:
    """Ids of good documents among at most ``most`` labelled ones, and their share."""
    one = labels.select(F.col("doc_id").cast("bigint"), "quality", "toxic").dropna().groupBy("doc_id").agg(F.min(((F.col("quality") == 1) & (F.col("toxic") == 0)).cast("int")).alias("good"))
    rows = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most).collect()  # the documented bound
    ids = np.array(sorted(r["doc_id"] for r in rows if r["good"]), np.int64)
    return ids, len(ids) / len(rows) if len(ids) else 1.0


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[DataFrame, float]:
    """doc_id, some (has it n-grams), log_weight, gumbel of every document; the share of good labels."""
    ids, share = _labelled(labels, max_labelled)
    sums = docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(counted(ids), "bucket bigint, n bigint, good bigint").groupBy("bucket").agg(F.sum("n").alias("n"), F.sum("good").alias("good"))
    every, good = np.zeros(BUCKETS), np.zeros(BUCKETS)
    for r in sums.collect():  # a row per bucket
        every[r["bucket"]], good[r["bucket"]] = r["n"], r["good"]
    raw = (every + PSEUDO) / (every.sum() + PSEUDO * BUCKETS)
    # target over raw per bucket is a gamma variable of mean 1: buckets with few expected counts stay near 1,
    # and a ratio that sampling error explains is 1, else the errors of a long text's n-grams drown the rest
    expected = good.sum() * raw
    rate = (good + SHRINK) / (expected + SHRINK)
    rate[np.abs(good - expected) < SIGMAS * np.sqrt(expected + SHRINK)] = 1.0
    ratio = np.log(rate / (raw @ rate))
    weight = F.arrow_udf(_weights(ratio), T.DoubleType())("text")
    uniform = (F.shiftrightunsigned(F.xxhash64(F.lit(17), "doc_id", "text"), 11).cast("double") + 0.5) / float(1 << 53)
    scored = docs.select("doc_id", weight.alias("w"), (-F.log(-F.log(uniform))).alias("gumbel"))
    return scored.select("doc_id", F.col("w").isNotNull().alias("some"), F.coalesce("w", F.lit(0.0)).alias("log_weight"), "gumbel"), share


def kth_largest(values: DataFrame, k: int) -> int | None:
    """The k-th largest of a column of longs, exactly: four counts of 2**16 bins."""
    high = None
    for shift in (48, 32, 16, 0):
        bins = values if high is None else values.where(F.shiftright("v", shift + 16) == high)
        rows = bins.groupBy(F.shiftright("v", shift).alias("b")).agg(F.count("*").alias("n")).collect()  # at most 2**16 rows
        for b, n in sorted(((r["b"], r["n"]) for r in rows), reverse=True):
            if k <= n:
                high = b
                break
            k -= n
        else:
            return None
    return high


def resample(docs: DataFrame, labels: DataFrame, keep_share: float | None = None, max_labelled: int = MAX_LABELLED) -> DataFrame:
    """doc_id, log_weight, priority (with noise) and kept of every document."""
    scored, share = score(docs, labels, max_labelled)
    priority = F.col("log_weight") + F.col("gumbel")
    scored = staged(scored.select("doc_id", "some", "log_weight", priority.alias("priority")), "weights")
    total = scored.count()
    k = round((share if keep_share is None else keep_share) * total)
    # 2**-20 steps keep the order of doubles as longs
    value = (F.greatest(F.least("priority", F.lit(8e12)), F.lit(-8e12)) * (1 << 20)).cast("bigint")
    least = kth_largest(scored.where("some").select(value.alias("v")), k) if k else None
    enough = F.lit(bool(k)) if least is None else value >= least
    return scored.select("doc_id", "log_weight", "priority", (F.col("some") & enough).alias("kept"))
