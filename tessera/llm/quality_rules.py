"""Quality rules under weak supervision.

Eight rules look at a document and vote good (1), bad (-1) or abstain (0).
Nobody labels documents: expectation-maximisation finds each rule's accuracy
from how the rules agree over the whole corpus, and a document's verdict is the
posterior probability that it is good. What the fit gathers is the number of
documents per voting pattern, at most 3**8 rows whatever the corpus, counted
over every document.

Defined cases: a null or empty text has no words, its base rule fails and it is
not kept. A null doc_id stays null. Repeated rows are judged each for itself. An
empty table gives an empty result (the model then rests on its pseudo-counts). Other
columns are left alone; ``judge`` adds one struct column.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.staging import free, staged
from tessera.llm.words import POINT, SPACE, Texts, _table, mix, texts, word_hash, words_of

#: Frequent function words of English, German, French and Spanish.
FUNCTION_WORDS = (
    "the of and to in is that for it with as was on be are by this from not have "
    "der die und das ist nicht ein eine zu den mit von sich auf für im dem des auch "
    "le la les de et des en un une du que est pour dans qui sur avec pas au ce "
    "el los las y que en del se por con una para es no su al lo como más"
).split()
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RULES = ["length", "word_length", "symbols", "duplicate_lines", "repeats", "letters", "capitals", "function_words"]
_TYPE = T.StructType([*[T.StructField(c, T.LongType()) for c in COUNTS], T.StructField("pattern", T.IntegerType())])
_SYMBOL = _table(lambda b: b in b"#*$%&|<>")
_UPPER = _table(lambda b: 0x41 <= b <= 0x5A)
_LETTER = _table(lambda b: b >= 0x80 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A)
_FUNCTION = np.array(sorted({word_hash(w) for w in FUNCTION_WORDS}), np.uint64)


def _repeated(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each (text, hash): is it there twice or more; is it a later occurrence."""
    keys = mix(hashes + mix(owner.astype(np.uint64)))
    _, first, inverse, n = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
    later = np.ones(len(keys), bool)
    later[first] = False
    return n[inverse] > 1, later


def _vote(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    return np.where(bad, -1, np.where(good, 1, 0))


def _measure(t: Texts) -> tuple[list[np.ndarray], np.ndarray]:
    """The five counts of each text, and the votes of the rules in the order of RULES."""
    docs, data = len(t), t.data
    total = lambda values: np.bincount(values, minlength=docs).astype(np.int64)
    w = words_of(t, lower=False)
    at, triples = w.shingles(3)
    twice, _ = _repeated(triples, w.owner[at])
    covered = np.zeros(len(w.hashes), bool)
    for j in range(3):
        covered[at[twice] + j] = True
    starts, ends = t.segments(data != 0x0A)
    visible = np.concatenate([[0], np.cumsum(~SPACE[data])])
    full = visible[ends] > visible[starts]
    starts, ends = starts[full], ends[full]
    line_of = t.owner(starts)
    _, later = _repeated(t.hashes(starts, ends), line_of)
    n_words, n_lines = total(w.owner), total(line_of)
    word_chars = t.totals(~SPACE[data] & POINT[data])
    symbols, dup = t.totals(_SYMBOL[data]), total(line_of[later])
    repeat = total(w.owner[covered])
    plain = words_of(t)
    function = total(plain.owner[np.isin(plain.hashes, _FUNCTION)])
    letters, upper = t.totals(_LETTER[data] & POINT[data]), t.totals(_UPPER[data])
    some = np.maximum(n_words, 1)
    mean, lines = word_chars / some, np.maximum(n_lines, 1)
    cased = np.maximum(letters, 1)
    votes = [
        _vote(n_words >= 80, n_words < 20),
        _vote((mean >= 3.5) & (mean <= 9), (mean < 2.5) | (mean > 14)),
        _vote(symbols <= 0.02 * some, symbols > 0.1 * some),
        _vote((n_lines >= 3) & (dup <= 0.1 * lines), dup > 0.3 * lines),
        _vote(repeat <= 0.1 * some, repeat > 0.35 * some),
        _vote(letters >= 0.85 * word_chars, letters < 0.7 * word_chars),
        _vote(upper <= 0.1 * cased, upper > 0.3 * cased),
        _vote(function >= 0.08 * some, (n_words >= 50) & (function < 0.02 * some)),
    ]
    return [n_words, word_chars, symbols, dup, repeat], np.stack(votes, 1)


def _features(text: pa.Array) -> pa.Array:
    columns, patterns = [[] for _ in COUNTS], []
    for t in texts(text):
        counts, votes = _measure(t)
        for out, c in zip(columns, counts, strict=True):
            out.append(c)
        patterns.append((votes + 1) @ 3 ** np.arange(len(RULES)))
    join = lambda parts, kind: pa.array(np.concatenate(parts) if parts else [], kind)
    fields = [join(c, pa.int64()) for c in columns] + [join(patterns, pa.int32())]
    return pa.StructArray.from_arrays(fields, [*COUNTS, "pattern"])


@dataclass(frozen=True)
class VoteModel:
    """What EM has found: the share of good documents, and each rule's two accuracies when it votes.

    ``on_good`` is the chance that its vote on a good document is good, ``on_bad``
    that its vote on a bad one is bad. Rules that look for one kind of fault have a
    low ``on_bad``, so their good votes say little and their bad votes much.
    """

    prior: float
    on_good: tuple[float, ...]
    on_bad: tuple[float, ...]

    def weights(self) -> tuple[float, list[tuple[float, float]]]:
        """Log odds before any vote, and what a good and a bad vote of each rule add."""
        rules = [(float(np.log(g / (1 - b))), float(np.log((1 - g) / b))) for g, b in zip(self.on_good, self.on_bad, strict=True)]
        return float(np.log(self.prior / (1 - self.prior))), rules

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        start, rules = self.weights()
        good, bad = np.array(rules).T
        return 1 / (1 + np.exp(-(start + (votes > 0) @ good + (votes < 0) @ bad)))


def expectation_maximisation(patterns: np.ndarray, n: np.ndarray, rounds: int = 300) -> VoteModel:
    """Fit to the number of documents per voting pattern.

    It starts from the vote count (one bad vote makes a document doubtful, two bad) and
    holds accuracies to ranges in which a vote is never evidence against itself, which
    also fixes which of the two classes is the good one.
    """
    votes = patterns[:, None] // 3 ** np.arange(len(RULES)) % 3 - 1
    good, bad = (votes > 0) * n[:, None], (votes < 0) * n[:, None]
    p = np.choose(np.minimum((votes < 0).sum(1), 2), [0.98, 0.2, 0.02])
    model = None
    for _ in range(rounds):
        q = 1 - p
        on_good = np.clip((p @ good + 19) / (p @ (good + bad) + 20), 0.8, 0.999)
        on_bad = np.clip((q @ bad + 3) / (q @ (good + bad) + 10), 0.02 + 1 - on_good, 0.98)
        new = VoteModel(float(np.clip((p @ n + 7) / (n.sum() + 10), 0.05, 0.95)), tuple(on_good.tolist()), tuple(on_bad.tolist()))
        moved = 1 if model is None else np.abs(np.array([*new.on_good, *new.on_bad, new.prior]) - [*model.on_good, *model.on_bad, model.prior]).max()
        model, p = new, new.posterior(votes)
        if moved < 1e-9:
            break
    return model


def measure(text: Column | str = "text") -> Column:
    """The struct of counts and the voting pattern of a text."""
    return F.arrow_udf(_features, _TYPE)(text)


def fit(patterns: DataFrame) -> VoteModel:
    """EM over all rows of a table with an integer column ``pattern``."""
    rows = patterns.groupBy("pattern").agg(F.count("*").alias("n")).collect()  # at most 3**8 rows
    rows = [(r["pattern"], r["n"]) for r in rows]
    p, n = (np.array([r[i] for r in rows], np.int64) for i in (0, 1))
    return expectation_maximisation(p, n)


def verdict(model: VoteModel, features: Column, threshold: float = 0.5) -> Column:
    """A struct of the posterior, base_failed and kept, from a struct that ``measure`` made."""
    posterior = _posterior(model, features["pattern"])
    failed = (features["n_words"] < 50) | (100 * features["n_repeat_words"] > 50 * features["n_words"])
    return F.struct(posterior.alias("posterior"), failed.alias("base_failed"), (~failed & (posterior >= threshold)).alias("kept"))


def _posterior(model: VoteModel, pattern: Column) -> Column:
    """The votes are the ternary digits of the pattern."""
    odds, rules = model.weights()
    odds = F.lit(odds)
    for j, (good, bad) in enumerate(rules):
        digit = F.floor(pattern / 3**j) % 3
        odds = odds + F.when(digit == 2, good).when(digit == 0, bad).otherwise(0.0)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, threshold: float = 0.5, into: str = "quality") -> DataFrame:
    """Every document with a struct ``into``: the counts, posterior, base_failed and kept; the measured rows are staged."""
    seen = staged(docs.withColumn(into, measure("text")), "measured")
    model = fit(seen.select(F.col(into)["pattern"].alias("pattern")))
    return seen.withColumn(into, _with(seen[into], verdict(model, seen[into], threshold)))


def keep(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """The documents whose verdict is to keep them, with the columns they came with."""
    into = free(docs, "quality")
    seen = judge(docs, threshold, into)
    return seen.where(seen[into]["kept"]).drop(into)


def _with(features: Column, made: Column) -> Column:
    return F.struct(*[features[c].alias(c) for c in COUNTS], *[made[c].alias(c) for c in ("posterior", "base_failed", "kept")])


def report(docs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """doc_id, the counts, the posterior and the verdict; texts are read once, the counts staged."""
    seen = staged(docs.select("doc_id", measure("text").alias("f")), "quality")
    made = verdict(fit(seen.select("f.pattern")), seen["f"], threshold)
    return seen.select("doc_id", *[f"f.{c}" for c in COUNTS], made["base_failed"].alias("base_failed"), made["kept"].alias("kept"), made["posterior"].alias("posterior"))
