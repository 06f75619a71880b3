r"""Secret scan with multipart credential linking.

Parts of credentials are spans of a text. Base spans are secrets by their own shape and
always stay: assign (password, passwd, secret, token, api key, and a value of 8 or more characters),
access (AKIA and 12 or more), hex (32 digits or more). Weak candidates have one of three parts each and
say little alone:

- identifier: other key ids by their prefix, and values named as user, account, client, tenant, key id;
- secret: values named pwd, pass, passphrase, credential, private, signing or shared key, bearer; a run of 24 or more characters
  of base64 with letters of both cases and digits, of at least ``BITS`` bits a character;
- endpoint: an address with a scheme, or a named host or server.

A part's scope is the stretch of lines around it that no blank line ends, and within it
``REACH`` code points to both sides. Scopes and parts are joined as intervals: over the sorted
starts and ends of the complementary parts of a text, two binary searches tell how many meet a scope,
without making the pairs. A weak candidate is reported only if complementary parts co-occur:

- a named secret with an identifier or an endpoint, a random run with an identifier;
- an identifier with a secret (assign and hex are secrets, access is an identifier);
- an endpoint with both.

An address that holds user and password itself has all its parts, so it is reported alone. A candidate that
overlaps a base span is part of that one. ``credentials`` links each secret with the nearest
identifier and endpoint of its scope: at most one row for each secret.

A text is scanned in the task that reads it, and nothing is shuffled.

Defined cases: a null text is an empty one. Offsets are code points, ends exclusive. Repeated rows are
scanned each. A null doc_id stays null. Texts of any length are scanned whole, in time near their length.
An empty table gives no rows. Extra columns are not read; ``redact`` carries them, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.staging import free

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
ASSIGN, ACCESS, HEX, IDENTIFIER, SECRET, ENDPOINT = range(6)
REACH, BITS, VALUE = 300, 3.5, 8
#: by kind: is it an identifier, a secret, an endpoint
_ROLE = np.array([[0, 1, 0], [1, 0, 0], [0, 1, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], bool)

_ASSIGN = re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ASSIGN_NAMES = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
_HEX = re.compile(r"[0-9a-f]{32,}")

_SET = r"""["']?\x20*(?::|=>?)\x20*["']?"""
_NAMED = r"(?<![A-Za-z0-9])"
_OTHER_KEY = re.compile(r"(?<![A-Za-z0-9])(?:ASIA|AGPA|AIDA|AROA|AIPA|ANPA|ANVA)[A-Z0-9]{12,}(?![A-Za-z0-9])")
_IDENTIFIER = re.compile(
    _NAMED + r"(?:(?:access|aws_access)[_ -]?key(?:[_ -]?id)?|key[_ -]?id|client[_ -]?id|tenant[_ -]?id|app(?:lication)?[_ -]?id|account(?:[_ -]?(?:id|name))?|user(?:[_ -]?(?:id|name))?|login|uid)" + _SET + r"([A-Za-z0-9@._+-]{3,})",
    re.I | re.A,
)
_SECRET = re.compile(_NAMED + r"(?:pwd|pass|passphrase|credentials?|(?:private|signing|shared|access|account|encryption|master)[_ -]?key|bearer|auth)" + _SET + r"""([^\s"',;]{6,})""", re.I | re.A)
_RANDOM = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{24,}={0,2}(?![A-Za-z0-9+/_=-])")
_ENDPOINT = re.compile(r"""(?<![A-Za-z0-9])[A-Za-z][A-Za-z0-9+-]{1,14}://[^\s"'<>]+""")
_HOST = re.compile(_NAMED + r"(?:host(?:name)?|server|endpoint|database[_ -]?url)" + _SET + r"([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?::[0-9]+)?)", re.I | re.A)
_HOLDS = re.compile(r"://[^\s/:@]+:[^\s/@]+@[^\s/@]")
_BREAK = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int, int]


def base_spans(text: str) -> list[Span]:
    """(start, kind, end) by the patterns alone, leftmost and non-overlapping per kind; ordered by start and kind."""
    out = []
    low = text.lower()
    if any(name in low for name in _ASSIGN_NAMES):
        out += [(m.start(), ASSIGN, m.end()) for m in _ASSIGN.finditer(text) if len(m[1]) >= VALUE]
    if "AKIA" in text:
        out += [(m.start(), ACCESS, m.end()) for m in _ACCESS.finditer(text)]
    out += [(m.start(), HEX, m.end()) for m in _HEX.finditer(text)]
    return sorted(out)


def bits(value: str) -> float:
    """Entropy of a character of the value."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def random(value: str) -> bool:
    return any(map(str.isupper, value)) and any(map(str.islower, value)) and any(map(str.isdigit, value)) and bits(value) >= BITS


def weak_spans(text: str) -> list[tuple[int, int, int, bool]]:
    """(start, kind, end, named) of all weak candidates; an unnamed secret is a random run."""
    out = []
    if ":" in text or "=" in text:
        out += [(m.start(), IDENTIFIER, m.end(), True) for m in _IDENTIFIER.finditer(text)]
        out += [(m.start(), SECRET, m.end(), True) for m in _SECRET.finditer(text)]
        out += [(m.start(), ENDPOINT, m.end(), True) for m in _HOST.finditer(text)]
    out += [(m.start(), IDENTIFIER, m.end(), True) for m in _OTHER_KEY.finditer(text)]
    if "://" in text:
        out += [(m.start(), ENDPOINT, m.end(), True) for m in _ENDPOINT.finditer(text)]
    if out or "AKIA" in text:  # a random run is reported beside other parts only
        out += [(m.start(), SECRET, m.end(), False) for m in _RANDOM.finditer(text) if random(m[0])]
    return sorted(out)


def _covered(spans: np.ndarray, by: np.ndarray) -> np.ndarray:
    """Which spans (start, end) meet one of others."""
    return _meeting(spans, by) > 0


def _meeting(scopes: np.ndarray, parts: np.ndarray) -> np.ndarray:
    """The interval join, counted: how many parts (start, end) meet each scope (start, end)."""
    starts, ends = np.sort(parts[:, 0]), np.sort(parts[:, 1])
    return np.searchsorted(starts, scopes[:, 1], "left") - np.searchsorted(ends, scopes[:, 0], "right")


def scopes(text: str, spans: np.ndarray, reach: int = REACH) -> np.ndarray:
    """Of each span (start, end) the interval in which its parts are looked for."""
    breaks = np.array([(m.start(), m.end()) for m in _BREAK.finditer(text)], np.int64).reshape(-1, 2)
    last = np.searchsorted(breaks[:, 1], spans[:, 0], "right") - 1
    after = np.searchsorted(breaks[:, 0], spans[:, 1], "left")
    left = np.where(last >= 0, np.append(breaks[:, 1], 0)[last], 0)
    right = np.append(breaks[:, 0], len(text))[after]
    return np.stack([np.maximum(left, spans[:, 0] - reach), np.minimum(right, spans[:, 1] + reach)], 1)


def scan(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the weak candidates that complementary parts make credible; (start, kind, end) in order."""
    base = base_spans(text)
    weak = weak_spans(text)
    if not weak:
        return base, []
    sure = np.array(base, np.int64).reshape(-1, 3)
    found = np.array([w[:3] for w in weak], np.int64)
    named = np.array([w[3] for w in weak], bool)
    free_of = ~_covered(found[:, ::2], sure[:, ::2])
    holds = np.array([k == ENDPOINT and bool(_HOLDS.search(text, s, e)) for s, k, e in found.tolist()], bool)
    # a random run within a named candidate or an address is part of that one
    free_of &= named | ~_covered(found[:, ::2], found[named][:, ::2])
    found, named, holds = found[free_of], named[free_of], holds[free_of]
    if not len(found):
        return base, []
    where = scopes(text, found[:, ::2])
    parts = np.concatenate([sure, found])
    role = _ROLE[parts[:, 1]]
    near = np.stack([_meeting(where, parts[role[:, r]][:, ::2]) > 0 for r in range(3)], 1)
    identifier, secret, endpoint = near.T
    kind = found[:, 1]
    fine = holds | (kind == SECRET) & (identifier | endpoint & named) | (kind == IDENTIFIER) & secret | (kind == ENDPOINT) & identifier & secret
    return base, [tuple(x) for x in found[fine].tolist()]


_SPAN = T.StructType([T.StructField(n, T.IntegerType()) for n in ("start", "kind", "end")])
_FOUND = T.StructType([T.StructField(n, T.ArrayType(_SPAN)) for n in ("base", "added")])
_ARROW_SPANS = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))
_LINK = pa.struct([(f"{part}_{at}", pa.int32()) for part in ("secret", "identifier", "endpoint") for at in ("start", "end")])


def _found(texts: pa.Array) -> pa.Array:
    made: tuple[list, list] = ([], [])
    for t in texts:
        for out, spans in zip(made, scan(t.as_py() or ""), strict=True):
            out.append([{"start": s, "kind": k, "end": e} for s, k, e in spans])
    return pa.StructArray.from_arrays([pa.array(x, _ARROW_SPANS) for x in made], ["base", "added"])


def find(text: Column) -> Column:
    """base and added spans (arrays of start, kind number, end, in order)."""
    return F.arrow_udf(_found, _FOUND)(text)


def _listed(spans: Column) -> Column:
    name = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(name, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _count(spans: Column, kind: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")  # a second parameter would be the place in the array


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, and n_linked, the number of reported weak candidates."""
    seen = docs.select("doc_id", find(F.col("text")).alias("found"))
    base, added = F.col("found.base"), F.col("found.added")
    counts = [_count(base, k).alias(f"n_{name}") for k, name in enumerate(KINDS[:IDENTIFIER])]
    return seen.select("doc_id", *counts, F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.array_sort(F.concat(base, added))).alias("spans"), F.size(added).cast("bigint").alias("n_linked"))


def links(text: str) -> list[dict]:
    """Each reported secret with the nearest identifier and endpoint that its scope meets; secrets without either are left out."""
    base, added = scan(text)
    spans = np.array(sorted(base + added), np.int64).reshape(-1, 3)
    role = _ROLE[spans[:, 1]]
    own = spans[role[:, 1]]
    if not len(own):
        return []
    where = scopes(text, own[:, ::2])
    out = {"secret": own}
    for name, r in (("identifier", 0), ("endpoint", 2)):
        parts = spans[role[:, r]]
        at = np.searchsorted(parts[:, 0], own[:, 0])
        both = np.stack([at - 1, np.minimum(at, len(parts) - 1)], 1)
        some = np.full((len(own), 3), -1, np.int64)
        if len(parts):
            near = parts[both.clip(0)]  # the parts before and after
            apart = np.maximum(near[:, :, 0] - own[:, None, 2], own[:, None, 0] - near[:, :, 2])
            meets = (near[:, :, 0] < where[:, None, 1]) & (near[:, :, 2] > where[:, None, 0]) & (both >= 0)
            apart = np.where(meets, apart, np.iinfo(np.int64).max)
            pick = apart.argmin(1)
            rows = np.arange(len(own))
            some = np.where(meets[rows, pick][:, None], near[rows, pick], -1)
        out[name] = some
    linked = (out["identifier"][:, 0] >= 0) | (out["endpoint"][:, 0] >= 0)
    value = lambda x: int(x) if x >= 0 else None
    return [{f"{n}_{at}": value(out[n][i, c]) for n in out for at, c in (("start", 0), ("end", 2))} for i in np.flatnonzero(linked)]


def _links(texts: pa.Array) -> pa.Array:
    return pa.array([links(t.as_py() or "") for t in texts], pa.list_(_LINK))


def credentials(docs: DataFrame) -> DataFrame:
    """doc_id and the offsets of secret, identifier and endpoint (null where there is none), a row for each linked secret."""
    kind = "array<struct<" + ",".join(f"{f.name}:int" for f in _LINK) + ">>"
    return docs.select("doc_id", F.explode(F.arrow_udf(_links, kind)("text")).alias("link")).select("doc_id", "link.*")


def _redacted(texts: pa.Array) -> pa.Array:
    out = []
    for t in texts:
        text = t.as_py()
        base, added = scan(text or "")
        parts, at = [], 0
        for start, kind, end in sorted(base + added):
            if start >= at:
                parts += [text[at:start], f"[{KINDS[kind]}]"]
            at = max(at, end)
        out.append("".join([*parts, text[at:]]) if parts else text)
    return pa.array(out, pa.string())


def redact(docs: DataFrame) -> DataFrame:
    """The documents with each span of ``text`` as its kind in brackets; where spans overlap, the first is named. A null text stays null."""
    clean = free(docs, "clean")
    made = docs.withColumn(clean, F.arrow_udf(_redacted, T.StringType())("text"))
    return made.select(*[made[clean].alias(c) if c == "text" else made[f"`{c}`"] for c in docs.columns])
