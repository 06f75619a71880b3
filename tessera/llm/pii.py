r"""Personal data by a skip-chain conditional random field.

Candidates are spans of a text. Base candidates fit a kind's pattern and check: email,
ip (parts at most 255), card (16 to 19 digits that pass Luhn), phone (+ and 8 to 15
digits); they are what they are. Loose candidates look like one: digits in groups
without the plus, addresses with the at or the dots spelt out, ip parts apart by other
signs, card digits in groups of other signs, and a run of digits without any sign that ends as a base number's digits do. The field labels loose candidates with a
kind or none:

- node potentials are log probabilities of a multinomial logistic model of a candidate's
  shape, fitted to how often each shape is base or loose in all documents;
- chain edges join candidates that follow each other, with the log odds of the kinds
  of such neighbours in all documents;
- skip edges join a repeated or similar candidate (same last nine digits, or all of the
  seven or eight of the shorter number; same address) with the one before it and with the first base one, however far apart, with
  an agreement potential.

Loopy message passing over all graphs of a batch at once gives the marginals; a loose
candidate is added where a kind has more than half. Since loose candidates are never
base, their own shape speaks against them: it is consistency with a base span of the
same document that adds them (MISSED is the share of loose candidates that the patterns
are taken to have missed). What the fit gathers is a table of shapes, bounded by
their number.

Defined cases: a null text is an empty one. Offsets are code points, ends exclusive.
Repeated rows are searched each. A null doc_id stays null. An empty table gives no
rows. Extra columns are not read; ``redact`` carries them, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.staging import staged

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
AGREEMENT, MISSED = 6.0, 0.02
ROUNDS, DAMPING = 12, 0.3
_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_LOOSE_PHONE = re.compile(r"(?<![\w+.(-])(?:[0-9](?:[.-]\(?|\()[0-9]{2,5}\)?|\(?[0-9]{2,4}\)?)(?:[ .-]?\(?[0-9]{2,5}\)?){1,5}(?![\w-])")
_LOOSE_EMAIL = re.compile(r"(?<![\w.@%+-])[A-Za-z0-9_%+-]+(?:\.[A-Za-z0-9_%+-]+){0,4} ?(?:\(at\)|\[at\]|\{at\}| at ) ?[A-Za-z0-9-]+(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}) ?| dot |\.)[A-Za-z0-9-]+){1,4}", re.I)
_LOOSE_IP = re.compile(r"(?<![\w.-])(?=([0-9]{1,3}(?:(?: ?(?:\(dot\)|\[dot\]|\{dot\}|\(\.\)|\[\.\]|\{\.\}) ?| dot | ?\. ?|[ -])[0-9]{1,3}){3}(?![\w-]|\.[0-9])))", re.I)  # at every start, as a number may stand before
_LOOSE_CARD = re.compile(r"(?<![\w./,-])[0-9]{2,7}( {2,3}| ?[./_,-] ?)[0-9]{2,7}(?:\1[0-9]{2,7}){1,7}(?!\w)")
_PLAIN = re.compile(r"(?<![\w.,+-])[0-9]{7,17}(?![\w-]|[.,][0-9])")
_DIGIT = re.compile(r"[0-9]")
_CANDIDATE = T.StructType([T.StructField(n, t) for n, t in (("kind", T.IntegerType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("shape", T.IntegerType()), ("same", T.StringType()))])


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by the patterns alone, leftmost and non-overlapping per kind; ordered by kind and start."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:  # an address's local part is the run before the sign, from the previous sign or address on
        start = last + len(text[last:at].rstrip(_LOCAL))
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            out.append((0, start, domain.end()))
        last = domain.end() if domain else at + 1
        at = text.find("@", last)
    if not _DIGIT.search(text):
        return out
    out += [(1, *m.span()) for m in _IP.finditer(text) if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        out += [(3, *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(map(str.isdigit, m[0])) <= 15]
    return out


def _shape(span: str) -> int:
    """Digits, and which of some signs are there."""
    digits = min(31, len(_DIGIT.findall(span)))
    return digits | sum(32 << i for i, c in enumerate("@+( -.") if c in span)


def _same(kind: int, span: str) -> str:
    """What similar candidates have in common: the last nine digits, or the address."""
    if kind == 0:
        plain = re.sub(r" ?[(\[{]at[)\]}] ?| at ", "@", span.lower())
        return "@" + re.sub(r" ?[(\[{]dot[)\]}] ?| dot ", ".", plain).replace(" ", "")
    if kind == 1:
        return ".".join(p.lstrip("0") or "0" for p in re.findall("[0-9]+", span))
    return "".join(_DIGIT.findall(span))[-9:]


def _tails(same: str) -> list[str]:
    """Under which names others may mean the same: a number's last seven digits and more."""
    return [same[-n:] for n in range(7, len(same) + 1)] if same.isdigit() else [same]


def candidates(text: str) -> list[tuple[int, int, int, int, str]]:
    """Base candidates with their kind, loose ones with NONE, in order of their starts."""
    base = base_spans(text)
    out = [(kind, s, e, _shape(text[s:e]), _same(kind, text[s:e])) for kind, s, e in base]
    taken = sorted((s, e) for _, s, e in base)
    if not taken:  # a loose candidate is added by its consistency with a base one only
        return out
    loose = []
    if _DIGIT.search(text):
        loose += [(3, *m.span()) for m in _LOOSE_PHONE.finditer(text) if 7 <= len(_DIGIT.findall(m[0])) <= 15]
        kinds = {kind for kind, _, _ in base}
        if 3 in kinds:
            loose += _plain_numbers(text, {"".join(_DIGIT.findall(text[s:e])) for kind, s, e in base if kind == 3}, [x[1:] for x in loose])
        for m in _LOOSE_IP.finditer(text) if 1 in kinds else ():
            spelt = "." in m[1] or "dot" in m[1].lower()
            if all(int(p) <= 255 for p in re.findall("[0-9]+", m[1])) and (spelt or len(_DIGIT.findall(m[1])) >= 7):
                loose.append((1, *m.span(1)))
        for m in _LOOSE_CARD.finditer(text) if 2 in kinds else ():
            digits = "".join(_DIGIT.findall(m[0]))
            if 16 <= len(digits) <= 19 and luhn(digits):
                loose.append((2, *m.span()))
    low = text.lower()
    if any(sign in low for sign in (" at ", "(at)", "[at]", "{at}")):  # all that _LOOSE_EMAIL takes for the at
        loose += [(0, *m.span()) for m in _LOOSE_EMAIL.finditer(text)]
    if loose:
        starts, ends = np.array(taken).T
        furthest = np.maximum.accumulate(ends)
        for kind, s, e in loose:
            before = int(np.searchsorted(starts, e))
            if not before or furthest[before - 1] <= s:
                out.append((NONE, s, e, _shape(text[s:e]), _same(kind, text[s:e])))
    return sorted(out, key=lambda c: (c[1], c[2], c[0]))


def _plain_numbers(text: str, numbers: set[str], taken: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Runs of digits, of seven or more, that end as one of the numbers or that one ends as, outside the spans taken (in order)."""
    tails, lengths, starts = {t for n in numbers for t in _tails(n)}, set(map(len, numbers)), [s for s, _ in taken]
    out = []
    for m in _PLAIN.finditer(text):
        before = bisect_right(starts, m.start()) - 1
        if before >= 0 and taken[before][1] > m.start():
            continue
        if m[0] in tails or any(m[0][-n:] in numbers for n in lengths if n < len(m[0])):
            out.append((3, *m.span()))
    return out


def _candidates(text: pa.Array) -> pa.Array:
    names = [f.name for f in _CANDIDATE.fields]
    rows = [[dict(zip(names, c, strict=True)) for c in candidates(x)] if (x := v.as_py()) else [] for v in text]
    kind = pa.list_(pa.struct([(n, pa.string() if n == "same" else pa.int32()) for n in names]))
    return pa.array(rows, kind)


class Field:
    """Potentials: node[shape] and chain[kind, next kind], as logs."""

    def __init__(self, shapes: Counter, neighbours: Counter):
        codes = np.array(sorted({s for s, _ in shapes}), np.int64)
        x = np.stack([*[codes & 31 == d for d in range(32)], *[(codes >> b) & 1 for b in range(5, 11)], np.ones(len(codes))], 1).astype(float)
        n = np.zeros((len(codes), NONE + 1))
        for (s, k), c in shapes.items():
            n[np.searchsorted(codes, s), k] += c
        w = np.zeros((x.shape[1], NONE + 1))
        for _ in range(300):  # maximum likelihood with a weak ridge, by gradient steps on the shape table
            p = self._softmax(x @ w)
            w += 2.0 * (x.T @ (n - p * n.sum(1, keepdims=True)) / max(1, n.sum()) - 1e-4 * w)
        self.codes, self.node = codes, np.log(self._softmax(x @ w) + MISSED)
        pairs = np.ones((NONE + 1, NONE + 1))
        for (a, b), c in neighbours.items():
            pairs[a, b] += c
        share = pairs / pairs.sum()
        self.chain = np.clip(np.log(share / share.sum(1, keepdims=True) / share.sum(0)), -1, 1)

    @staticmethod
    def _softmax(z: np.ndarray) -> np.ndarray:
        e = np.exp(z - z.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def label(self, kinds: np.ndarray, shapes: np.ndarray, docs: np.ndarray, same: list[str]) -> np.ndarray:
        """The kind of each candidate of some documents (candidates in order of document and start)."""
        if not len(kinds):
            return kinds
        p = self.marginals(kinds, shapes, docs, same)
        return np.where(kinds != NONE, kinds, np.where(p.max(1) > 0.5, p.argmax(1), NONE))

    def marginals(self, kinds: np.ndarray, shapes: np.ndarray, docs: np.ndarray, same: list[str]) -> np.ndarray:
        """By message passing, exact where a document's edges form no loop."""
        n = len(kinds)
        node = np.where((kinds == NONE)[:, None], self.node[np.searchsorted(self.codes, shapes)], -20.0)
        fixed = np.flatnonzero(kinds != NONE)
        node[fixed, kinds[fixed]] = 0.0
        chain = np.flatnonzero(docs[1:] == docs[:-1])
        names = [(doc, key, _tails(key)) for doc, key in zip(docs.tolist(), same, strict=True)]
        # by whole key and by any tail: the first base candidate, the last one so far
        sure: tuple[dict, dict] = ({}, {})
        last: tuple[dict, dict] = ({}, {})

        def enter(known: tuple[dict, dict], i: int) -> None:
            doc, key, tails = names[i]
            known[0][doc, key] = i
            known[1].update(((doc, t), i) for t in tails)

        def similar(known: tuple[dict, dict], i: int) -> list[int]:
            doc, key, tails = names[i]
            at = [known[1].get((doc, key)), *[known[0].get((doc, t)) for t in tails]]
            return [x for x in at if x is not None]

        for i in fixed[::-1].tolist():
            enter(sure, i)
        skips = []
        for i in range(n):
            before = max(similar(last, i), default=None)
            if before is not None:
                skips.append((before, i))
            base = min(similar(sure, i), default=i) if kinds[i] == NONE else i
            if base not in (i, before):
                skips.append((base, i))
            enter(last, i)
        a, b = np.array(skips, np.int64).reshape(-1, 2).T
        source = np.concatenate([chain, chain + 1, a, b])
        target = np.concatenate([chain + 1, chain, b, a])
        back = np.concatenate([len(chain) + np.arange(len(chain)), np.arange(len(chain)), 2 * len(chain) + len(a) + np.arange(len(a)), 2 * len(chain) + np.arange(len(a))])
        agree = np.eye(NONE + 1) * AGREEMENT
        edge = np.concatenate([np.repeat(m[None], k, 0) for m, k in ((self.chain, len(chain)), (self.chain.T, len(chain)), (agree, len(a)), (agree, len(a)))])
        message = np.zeros((len(source), NONE + 1))
        for _ in range(ROUNDS):
            belief = node.copy()
            np.add.at(belief, target, message)
            out = (belief[source] - message[back])[:, :, None] + edge
            top = out.max(1)
            new = top + np.log(np.exp(out - top[:, None]).sum(1))
            new -= new.max(1, keepdims=True)
            message = DAMPING * message + (1 - DAMPING) * new
        belief = node.copy()
        np.add.at(belief, target, message)
        return self._softmax(belief)


def fit(found: DataFrame) -> Field:
    """From all candidates: counts of shapes by kind and of neighbouring kinds."""
    kinds = F.col("found.kind")
    shapes = found.select(F.explode("found").alias("c")).groupBy("c.shape", "c.kind").agg(F.count("*").alias("n")).collect()  # at most 2**11 shapes
    pairs = F.zip_with(kinds, F.slice(kinds, 2, F.greatest(F.size(kinds), F.lit(1))), lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    near = found.select(F.explode(pairs).alias("p")).where("p.b is not null").groupBy("p.a", "p.b").agg(F.count("*").alias("n")).collect()
    return Field(Counter({(r["shape"], r["kind"]): r["n"] for r in shapes}), Counter({(r["a"], r["b"]): r["n"] for r in near}))


def _labels(field: Field):
    def run(found: pa.Array) -> pa.Array:
        """The kind of each candidate, as found or as the field has it."""
        found = found.combine_chunks() if isinstance(found, pa.ChunkedArray) else found
        sizes = np.array([len(x) if x.is_valid else 0 for x in found], np.int64)
        flat = found.flatten()
        kinds, shapes = (flat.field(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("kind", "shape"))
        docs = np.repeat(np.arange(len(sizes)), sizes)
        open_docs = np.zeros(len(sizes) + 1, bool)
        open_docs[docs[kinds == NONE]] = True
        some = np.flatnonzero(open_docs[docs])  # without a loose candidate there is nothing to decide
        same = flat.field("same").take(pa.array(some)).to_pylist()
        kinds[some] = field.label(kinds[some], shapes[some], docs[some], same)
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(kinds.astype(np.int32)))

    return run


def find(docs: DataFrame, carried: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The carried columns, base and spans (arrays of kind number, start, end, by kind and start) of every document."""
    kept = [F.col(c).alias(f"_tessera_{i}") for i, c in enumerate(carried)]
    seen = staged(docs.select(*kept, F.arrow_udf(_candidates, T.ArrayType(_CANDIDATE))("text").alias("found")), "candidates")
    labels = F.arrow_udf(_labels(fit(seen)), T.ArrayType(T.IntegerType()))("found")
    span = lambda kind, c: F.struct(kind.alias("kind"), c["start"].alias("start"), c["end"].alias("end"))
    real = lambda x: x["kind"] < NONE
    both = seen.withColumn("kinds", labels).select(
        *[F.col(f"_tessera_{i}").alias(c) for i, c in enumerate(carried)],
        F.array_sort(F.filter(F.transform("found", lambda c: span(c["kind"], c)), real)).alias("base"),
        F.array_sort(F.filter(F.zip_with("found", "kinds", lambda c, k: span(k, c)), real)).alias("spans"),
    )
    return both


def _listed(spans: str):
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(kind: int) -> Column:
    return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("bigint")  # a second parameter would be the place in the array


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base), base_sha256, spans of every document."""
    counts = [_count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return find(docs).select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"), _listed("spans").alias("spans"))


def _redacted(text: pa.Array, spans: pa.Array) -> pa.Array:
    out = []
    for t, found in zip(text.to_pylist(), spans.to_pylist(), strict=True):
        parts, at = [], 0
        for s in sorted(found or [], key=lambda s: (s["start"], s["end"], s["kind"])):
            if s["start"] >= at:
                parts += [t[at : s["start"]], f"[{KINDS[s['kind']]}]"]
            at = max(at, s["end"])
        out.append("".join([*parts, t[at:]]) if parts else t)
    return pa.array(out, pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """The documents with the columns they came with; in ``text`` each span is its kind in brackets.

    Where spans overlap, the one that starts first is named and the rest of the other goes
    with it. A null text stays null.
    """
    row = F.struct(*[docs[c] for c in docs.columns])
    seen = find(docs.select("text", row.alias("row")), ("row",))
    text = F.arrow_udf(_redacted, T.StringType())(F.col("row")["text"], F.col("spans"))
    return seen.select(*[(text if c == "text" else F.col("row")[c]).alias(c) for c in docs.columns])
