r"""All passages that occur in any document: the quote rule over every document and quote at once.

A quote is looked for by one of its grams. Of a text's gram hashes some positions are selected by the
text around them alone (the least hash of a stretch), so a quote's selected grams are
selected in every document that holds it. Of these the one that fewest documents' positions
share is the quote's key. The steps:

1. The grams that quotes select are counted among the documents' selected grams. A filter of the quotes' grams of at most
   ``MOST_BITS`` bits goes to all tasks and spares the shuffle what no quote can ask for; quotes
   themselves are sent nowhere. A quote with a gram that no document has is found nowhere.
2. Documents' positions and quotes meet by the key's hash. A hash that very many positions share is a skewed join of plain rows,
   which Spark splits.
3. What the position says of the document's text is compared with the quote exactly: length and SHA-256, case-sensitive.

A quote's length decides its grams: from 47 characters on the least of 32 grams of 16, from 15 on the least of 8
grams of 8, below that every gram of the largest power of two that it holds. Equal quotes are looked for once.

A null or empty quote is found nowhere, and a null text holds nothing. Documents need unequal ids. Ids of quotes may repeat.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.grams import U64, codes, levels, mixed, selected
from tessera.functions.staging import staged

#: least length of a quote -> characters of a gram, grams of a stretch
LEVELS = ((47, 16, 32), (15, 8, 8), (8, 8, 1), (4, 4, 1), (2, 2, 1), (1, 1, 1))
MOST_BITS = 1 << 26
_SLICE = 1 << 20
_GRAMS = "array<struct<hash:bigint,at:int>>"
_ARROW = pa.list_(pa.struct([("hash", pa.int64()), ("at", pa.int32())]))


def level(length: Column) -> Column:
    """The number of a quote's level; null for an empty one."""
    return F.coalesce(*[F.when(length >= least, F.lit(i)) for i, (least, _, _) in enumerate(LEVELS)])


def selected_grams(text: str, wanted: frozenset[int]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes (those of two levels differ) and positions of a text's selected grams, slice by slice."""
    hashes, places = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
    reach = max(gram + window for _, gram, window in LEVELS)
    for begin in range(0, len(text), _SLICE):
        lead = min(begin, reach)  # what is selected depends on so many grams before
        part = codes(text[begin - lead : begin + _SLICE + reach])
        for gram, h in levels(part, max(LEVELS[i][1] for i in wanted)):
            for i in wanted:
                if LEVELS[i][1] == gram:
                    at = selected(h, LEVELS[i][2])
                    at = at[(at >= lead) & (at < lead + _SLICE)]
                    hashes.append(mixed(h[at] + U64(i)))
                    places.append(at + begin - lead)
    return np.concatenate(hashes), np.concatenate(places)


def _grams(wanted: frozenset[int], bits: np.ndarray | None = None):
    """A UDF of a text's selected grams, of all or of those whose bit is set."""

    def run(texts: pa.Array) -> pa.Array:
        sizes, hashes, places = [0], [np.zeros(0, U64)], [np.zeros(0, np.int64)]
        for t in texts:
            h, at = selected_grams(t.as_py() or "", wanted)
            if bits is not None:
                asked = bits[(h >> U64(3)) % U64(len(bits))] >> (h & U64(7)).astype(np.uint8) & 1 == 1
                h, at = h[asked], at[asked]
            sizes.append(len(h))
            hashes.append(h)
            places.append(at)
        columns = [pa.array(np.concatenate(hashes).view(np.int64)), pa.array(np.concatenate(places).astype(np.int32))]
        return pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), pa.StructArray.from_arrays(columns, ["hash", "at"]))

    return F.arrow_udf(run, _GRAMS)


def _of_level(i: Column) -> Column:
    """A quote's own grams: those of its level."""

    def run(texts: pa.Array, numbers: pa.Array) -> pa.Array:
        made = (selected_grams(t.as_py(), frozenset([n.as_py()])) for t, n in zip(texts, numbers, strict=True))
        return pa.array([[{"hash": int(x), "at": int(p)} for x, p in zip(h.view(np.int64), at, strict=True)] for h, at in made], _ARROW)

    return F.arrow_udf(run, _GRAMS)("text", i)


def _bitmap(hashes: DataFrame) -> np.ndarray:
    """The filter: a bit for each hash, 32 bits a hash as far as ``MOST_BITS`` reach; a byte of it is a row at most."""
    n = hashes.agg(F.approx_count_distinct("hash")).first()[0]
    size = min(MOST_BITS, 1 << max(10, (32 * n - 1).bit_length())) // 8
    place = F.pmod(F.shiftrightunsigned("hash", 3), F.lit(size)).cast("int")
    one = F.expr("shiftleft(1, CAST(hash & 7 AS INT))")
    found = hashes.select(place.alias("place"), one.alias("bit")).groupBy("place").agg(F.bit_or("bit").alias("bits")).toArrow()
    bits = np.zeros(size, np.uint8)
    bits[found["place"].to_numpy()] = found["bits"].to_numpy()
    return bits


def _verified(text: pa.Array, asked: pa.Array) -> pa.Array:
    """Of the places (quote, start, length, sha256) of a text, those where it holds the quote."""
    from hashlib import sha256

    out = []
    for t, places in zip(text, asked, strict=True):
        t, kept = t.as_py(), []
        for p in places.as_py():
            end = p["start"] + p["length"]
            if end <= len(t) and sha256(t[p["start"] : end].encode()).digest() == p["sha256"]:
                kept.append({"sha256": p["sha256"], "start": p["start"], "length": p["length"]})
        out.append(kept)
    return pa.array(out, pa.list_(pa.struct([("sha256", pa.binary()), ("start", pa.int32()), ("length", pa.int32())])))


_FOUND = "array<struct<sha256:binary,start:int,length:int>>"


def quote_scan(docs: DataFrame, quotes: DataFrame) -> DataFrame:
    """docs (id, raw_text), quotes (item_id, text) -> item_id, document_id, start (the first place), n_places (counted left to right without overlap)."""
    length = F.length("text")
    known = quotes.where(length > 0).select("item_id", F.unhex(F.sha2("text", 256)).alias("sha256"), "text")
    single = known.groupBy("sha256").agg(F.first("text").alias("text")).withColumns({"length": length, "level": level(length)})
    grams = single.select("sha256", "length", F.explode(_of_level(F.col("level"))).alias("g")).select("sha256", "length", "g.hash", "g.at")
    wanted = frozenset(r["level"] for r in single.select("level").distinct().collect())  # at most as many as there are levels
    if not wanted:
        none = F.lit(None).cast(docs.schema["id"].dataType)
        return quotes.where(F.lit(False)).select("item_id", none.alias("document_id"), F.lit(0).alias("start"), F.lit(0).cast("bigint").alias("n_places"))
    texts = docs.where("raw_text is not null")
    own = texts.select(F.col("id"), F.explode(_grams(wanted, _bitmap(grams))("raw_text")).alias("g")).select("id", "g.hash", F.col("g.at").alias("place"))
    own = staged(own, "quote-grams")
    counts = own.groupBy("hash").agg(F.count("*").alias("n"))
    rarity = grams.join(counts, "hash", "left").groupBy("sha256", "length")
    keys = rarity.agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "hash", "at")).alias("key")).where("key.n > 0").select("sha256", "length", "key.hash", "key.at")
    places = own.join(keys, "hash").select("id", "sha256", "length", (F.col("place") - F.col("at")).alias("start")).where("start >= 0")
    # a written table, so that Spark knows its size: where it is small the texts are not shuffled for it
    asked = staged(places.groupBy("id").agg(F.collect_list(F.struct("sha256", "start", "length")).alias("asked")), "quote-places")
    found = texts.select("id", "raw_text").join(asked, "id").select("id", F.explode(F.arrow_udf(_verified, _FOUND)("raw_text", "asked")).alias("f"))
    # an occurrence is one further on if it begins behind the end of the one that counted last
    at = F.array_sort(F.collect_list("f.start"))
    per_pair = found.groupBy("id", "f.sha256").agg(at.alias("starts"), F.first("f.length").alias("length"))
    zero = F.struct(F.lit(-1).alias("end"), F.lit(0).cast("bigint").alias("n"))
    step = lambda a, s: F.when(s >= a["end"], F.struct((s + F.col("length")).alias("end"), (a["n"] + 1).alias("n"))).otherwise(a)
    per_pair = per_pair.select("id", "sha256", F.get("starts", F.lit(0)).alias("start"), F.aggregate("starts", zero, step)["n"].alias("n_places"))
    return known.select("item_id", "sha256").join(per_pair, "sha256").select("item_id", F.col("id").alias("document_id"), "start", "n_places")
