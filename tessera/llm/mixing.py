"""Mixing sources to target weights by systematic sampling.

A source's target is its share of all words by weight, at most ``MOST`` times its own
size, the excess reshared among the others by weight. Each of its documents is
expected target / size times. Documents are put in order of size (then of a hash of
the doc_id), expected copies are summed up along that order from one random offset per
source, and a document is emitted once per integer that its sum crosses. In order of
size, the words taken differ from the target by about the largest document.

The running sums need no task that holds a source: ranks come from the numbers of
documents per (source, size) and per hash cell inside it, and a row number within a
cell. Cells are made small enough that the largest (source, size) has about ``cell_rows`` in each; a
cell that is larger all the same, since doc_ids repeat or are null, is parted by whole hash and
record number. Nor does one task hold more than ``IN_ONE_TASK`` sources: the order of more comes from ranges of
their keys, and what full ones leave to others from sums over all, repeated until no other is full.

Defined cases: a null text has size 0. Null sources are one source, last in order. A
source without words has target 0 and is not taken. Repeated rows are documents of
their own; which of them gets a copy makes no difference. Null doc_ids are allowed.
Empty tables give an empty result. Extra columns are carried by ``mixed``, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessera.llm.staging import staged

MOST = 3
WEIGHTS = (1, 2, 3)
SEED = "tessera-mix"
CELL_ROWS = 100_000
IN_ONE_TASK = 100_000  # sources
_P = "_tessera_"


def size_of(text: Column) -> Column:
    """Words between white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")


def _weighed(sources: DataFrame, n: int) -> DataFrame:
    """source key, size -> the same with its weight, by its place in the order of keys; ``n`` is how many there are."""
    part, place = _P + "part", _P + "place"
    weight_at = lambda number: F.get(F.array(*map(F.lit, WEIGHTS)), (number % len(WEIGHTS)).cast("int"))
    if n <= IN_ONE_TASK:
        at = F.row_number().over(Window.orderBy(_P + "key")) - 1
        return staged(sources.select(_P + "key", _P + "total", weight_at(at).alias("w")), "weighed")
    s = staged(sources.repartitionByRange(_P + "key").withColumn(part, F.spark_partition_id()), "ranges")
    ahead = F.sum("n").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1))  # a row per range
    before = s.groupBy(part).agg(F.count("*").alias("n")).select(part, F.coalesce(ahead, F.lit(0)).alias("before"))
    s = s.withColumn(place, F.row_number().over(Window.partitionBy(part).orderBy(_P + "key")) - 1).join(before, part)
    return staged(s.select(_P + "key", _P + "total", weight_at(F.col(place) + F.col("before")).alias("w")), "weighed")


def _level(weighed: DataFrame) -> float:
    """Words per weight of the sources that are not full; it rises as full ones leave words to the others."""
    cap = MOST * F.col(_P + "total")
    every = weighed.agg(F.sum(_P + "total")).first()[0] or 0
    level, full, weight = 0.0, 0, weighed.agg(F.sum("w")).first()[0]
    while weight and (every - full) / weight > level:
        level = (every - full) / weight
        is_full = cap <= F.col("w") * F.lit(level)
        full, weight = weighed.agg(F.coalesce(F.sum(F.when(is_full, cap)), F.lit(0)), F.sum(F.when(~is_full, F.col("w")))).first()
    return level


def targets(sources: DataFrame, n: int | None = None) -> DataFrame:
    """source key, size -> the same with target, rate and offset; as many rows as there are sources (``n``, if that is known)."""
    s = _weighed(sources, sources.count() if n is None else n)
    cap, share = (MOST * F.col(_P + "total")).cast("double"), F.col("w") * F.lit(_level(s))
    target = F.least(cap, share)
    offset = (F.conv(F.substring(F.md5(F.concat(F.lit(SEED), _P + "key")), 1, 5), 16, 10).cast("double") + 0.5) / (1 << 20)
    return s.select(_P + "key", _P + "total", target.alias(_P + "target"), F.when(F.col(_P + "total") > 0, target / F.col(_P + "total")).otherwise(0.0).alias(_P + "rate"), offset.alias(_P + "offset"))


def sized(docs: DataFrame) -> DataFrame:
    """With the size, the source's sort key (null last), the doc_id's hash and a record number."""
    return docs.withColumns(
        {
            _P + "size": size_of(docs["text"]),
            _P + "key": F.coalesce(F.concat(F.lit("0"), docs["source"].cast("string")), F.lit("1")),
            _P + "hash": F.md5(F.coalesce(docs["doc_id"].cast("string"), F.lit(""))),
            _P + "number": F.monotonically_increasing_id(),
        }
    )


def _celled(docs: DataFrame, digits: int, cell_rows: int) -> DataFrame:
    """With the cell in (source, size): the hash's first digits; in a cell of over two cells' rows, the hash and one of several parts."""
    keys, cell, hot = [_P + "key", _P + "size"], _P + "cell", _P + "hot"
    docs = docs.withColumn(cell, F.substring(_P + "hash", 1, digits))
    large = docs.groupBy(*keys, cell).agg(F.count("*").alias("n")).where(F.col("n") > 2 * cell_rows)
    # at most a row for each 2 * cell_rows documents; as a table its size is known, so that Spark sends a small one to all tasks and shuffles no documents for it
    large = staged(large.select(*keys, cell, F.ceil(F.col("n") / cell_rows).alias(hot)), "large")
    parted = F.concat_ws("-", _P + "hash", F.lpad(F.pmod(F.xxhash64(_P + "number"), hot).cast("string"), 12, "0"))
    return docs.join(large, [*keys, cell], "left").withColumn(cell, F.when(F.col(hot).isNull(), F.col(cell)).otherwise(parted)).drop(hot)


def with_copies(docs: DataFrame, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Written ``sized`` rows with _tessera_copies, _tessera_total and _tessera_target."""
    keys = [_P + "key", _P + "size"]
    sizes = staged(docs.groupBy(*keys).agg(F.count("*").alias("n")), "sizes")
    most, n_sources = sizes.agg(F.coalesce(F.max("n"), F.lit(1)), F.count_distinct(_P + "key")).first()
    digits = max(2, math.ceil(math.log(most / cell_rows, 16))) if most > cell_rows else 2
    # no cell has more rows than its (source, size)
    docs = _celled(docs, digits, cell_rows) if most > 2 * cell_rows else docs.withColumn(_P + "cell", F.substring(_P + "hash", 1, digits))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    of_source = targets(sizes.groupBy(_P + "key").agg(F.sum(F.col(_P + "size") * F.col("n")).alias(_P + "total")), n_sources)
    base = F.coalesce(F.sum("n").over(earlier(Window.partitionBy(_P + "key").orderBy(_P + "size"))), F.lit(0))
    bases = sizes.select(*keys, base.alias("base")).join(of_source, _P + "key")
    cells = docs.groupBy(*keys, _P + "cell").agg(F.count("*").alias("n"))
    inner = F.coalesce(F.sum("n").over(earlier(Window.partitionBy(*keys).orderBy(_P + "cell"))), F.lit(0))
    cells = cells.select(*keys, _P + "cell", inner.alias("inner")).join(bases, keys)
    cells = cells.select(*keys, _P + "cell", (F.col("base") + F.col("inner")).alias(_P + "first"), _P + "total", _P + "target", _P + "rate", _P + "offset")
    place = Window.partitionBy(*keys, _P + "cell").orderBy(_P + "hash", "doc_id")
    ranked = docs.withColumn(_P + "place", F.row_number().over(place)).join(cells, [*keys, _P + "cell"])
    until = F.col(_P + "first") + F.col(_P + "place")
    crossed = F.floor(F.col(_P + "offset") + F.col(_P + "rate") * until) - F.floor(F.col(_P + "offset") + F.col(_P + "rate") * (until - 1))
    return ranked.withColumn(_P + "copies", F.least(crossed, F.lit(MOST)))


def report(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken, copies of every document."""
    seen = staged(sized(docs.select("doc_id", "text", "source")).drop("text"), "sized")
    size = F.col(_P + "size")
    return with_copies(seen).select(
        "doc_id", size.alias("size"), F.col(_P + "total").alias("source_size"), F.col(_P + "target").alias("target"), (size * F.col(_P + "copies")).alias("taken")
    )


def mixed(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns it came with."""
    row = F.struct(*[docs[c] for c in docs.columns]).alias("row")
    seen = staged(sized(docs.select("doc_id", "text", "source", row)).drop("text", "source"), "sized")
    taken = with_copies(seen).where(F.col(_P + "copies") > 0)
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(_P + "copies")))).select("row.*")


#: DuckDB, over documents
SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce('0' || source, '1') AS k, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS h,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (SELECT k, CAST(sum(size) AS BIGINT) AS total FROM d GROUP BY k),
w AS (SELECT k, total, (row_number() OVER (ORDER BY k) - 1) % 3 + 1 AS w, 3 * total AS cap, sum(total) OVER () AS everything FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY cap / w, k) AS n FROM w),
f AS (SELECT *, CAST(everything - coalesce(sum(cap) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
              / CAST(sum(w) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS lev FROM o),
t AS (SELECT k, total, CASE WHEN cap > w * lev THEN w * (SELECT min_by(lev, n) FROM f WHERE cap > w * lev) ELSE CAST(cap AS DOUBLE) END AS target,
             (CAST('0x' || substr(md5('tessera-mix' || k), 1, 5) AS BIGINT) + 0.5::DOUBLE) / 1048576 AS u FROM f),
r AS (SELECT d.doc_id, d.size, t.total, t.target, t.u, CASE WHEN total > 0 THEN target / total ELSE 0 END AS rate,
             row_number() OVER (PARTITION BY d.k ORDER BY d.size, d.h, d.doc_id) AS n FROM d JOIN t ON d.k = t.k)
SELECT doc_id, size, total AS source_size, target,
       CAST(size * least(floor(u + rate * n) - floor(u + rate * (n - 1)), 3) AS BIGINT) AS taken
FROM r"""
