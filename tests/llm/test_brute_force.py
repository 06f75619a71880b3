"""Whole queries against plain programs: quality verdicts, token order, pages."""

import html
import math
import random
import re
from collections import Counter

import numpy as np

from tessera.llm import html_text, quality_rules, queries, token_shards

SF = "/root/testdata/sf0.001"


def votes(text):
    """The eight rules' votes by regular expressions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n, some = len(words), max(1, len(words))
    chars = sum(map(len, words))
    symbols = len(re.findall(r"[#*$%&|<>]", text))
    dup = len(lines) - len(set(lines))
    triples = Counter(zip(words, words[1:], words[2:]))
    covered = {i + j for i, t in enumerate(zip(words, words[1:], words[2:])) if triples[t] > 1 for j in range(3)}
    letters, upper = len(re.findall(r"[A-Za-z]|[^\x00-\x7F]", text)), len(re.findall(r"[A-Z]", text))
    plain = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
    function = sum(w in quality_rules._FUNCTION_SET for w in plain)
    repeat, mean = len(covered), chars / some
    said = [
        (n >= 80, n < 20),
        (3.5 <= mean <= 9, mean < 2.5 or mean > 14),
        (symbols <= 0.02 * some, symbols > 0.1 * some),
        (len(lines) >= 3 and dup <= 0.1 * len(lines), dup > 0.3 * max(1, len(lines))),
        (repeat <= 0.1 * some, repeat > 0.35 * some),
        (letters >= 0.85 * chars, letters < 0.7 * chars),
        (upper <= 0.1 * max(1, letters), upper > 0.3 * max(1, letters)),
        (function >= 0.08 * some, n >= 50 and function < 0.02 * some),
    ]
    return [n, chars, symbols, dup, repeat], [-1 if bad else 1 if good else 0 for good, bad in said]


def posteriors(all_votes):
    """Expectation-maximisation over documents one by one."""
    p = [(0.98, 0.2, 0.02)[min(2, v.count(-1))] for v in all_votes]
    before = None
    for _ in range(300):
        clip = lambda x, low, high: min(max(x, low), high)
        good, bad = [], []
        for j in range(8):
            g = [sum(w for w, v in zip(p, all_votes) if v[j] == s) for s in (1, -1)]
            b = [sum(1 - w for w, v in zip(p, all_votes) if v[j] == s) for s in (1, -1)]
            good.append(clip((g[0] + 19) / (sum(g) + 20), 0.8, 0.999))
            bad.append(clip((b[1] + 3) / (sum(b) + 10), 0.02 + 1 - good[-1], 0.98))
        prior = clip((sum(p) + 7) / (len(p) + 10), 0.05, 0.95)
        p = []
        for v in all_votes:
            odds = math.log(prior / (1 - prior))
            for s, g, b in zip(v, good, bad):
                odds += math.log(g / (1 - b)) if s > 0 else math.log((1 - g) / b) if s < 0 else 0
            p.append(1 / (1 + math.exp(-odds)))
        now = [*good, *bad, prior]
        if before and max(abs(x - y) for x, y in zip(now, before)) < 1e-9:
            break
        before = now
    return p


def test_quality_verdicts(spark):
    quality_rules._FUNCTION_SET = set(quality_rules.FUNCTION_WORDS)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    measured = {r["doc_id"]: votes(r["text"] or "") for r in docs}
    belief = dict(zip(measured, posteriors([v for _, v in measured.values()])))
    for r in queries.op9_quality_rules(spark, SF).collect():
        counts, _ = measured[r["doc_id"]]
        failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
        assert [r[c] for c in quality_rules.COUNTS] == counts and r["base_failed"] == failed
        assert abs(r["posterior"] - belief[r["doc_id"]]) < 1e-6 and r["kept"] == (not failed and belief[r["doc_id"]] >= 0.5)


M64 = (1 << 64) - 1


def mixed(x):
    x ^= x >> 31
    x = x * 0xD6E8FEB86659FD93 & M64
    x ^= x >> 29
    x = x * 0xA0761D6478BD642F & M64
    return x ^ (x >> 32)


def permuted(number, n, key, rounds=6):
    """The slot of a sequence, in plain integers."""
    half = max(1, -(-(n - 1).bit_length() // 2))
    mask = (1 << half) - 1
    while True:
        left, right = number >> half, number & mask
        for i in range(1, rounds + 1):
            left, right = right, left ^ (mixed(right ^ mixed((i * 0x9E3779B97F4A7C15 + key) & M64)) & mask)
        number = left << half | right
        if number < n:
            return number


def test_token_order(spark):
    """Every sequence is where the permutation puts it, and in the order before it the sequences are the documents, token for token."""
    rows = {r["slot"]: r for r in queries.op10_token_shards(spark, SF).collect()}
    n = len(rows)
    slots = [permuted(i, n, token_shards.KEY) for i in range(n)]
    assert sorted(slots) == list(range(n)) == sorted(rows)
    encoder, end = token_shards.encoding(token_shards.VOCABULARY)
    width = np.uint16 if end < 1 << 16 else np.uint32
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()  # one file, in its order
    want, whose = [], []
    for r in docs:
        ids = [*encoder.encode_ordinary(r["text"] or ""), end]
        want += ids
        whose += [r["doc_id"]] * len(ids)
    at = 0
    for i, slot in enumerate(slots):
        r = rows[slot]
        tokens = np.frombuffer(r["tokens"], width)
        assert len(tokens) == token_shards.LENGTH and (r["shard"], r["row"]) == divmod(slot, token_shards.PER_SHARD)
        here = slice(at, at + r["n_tokens"])
        assert tokens[: r["n_tokens"]].tolist() == want[here] and (tokens[r["n_tokens"] :] == end).all()
        assert r["doc_ids"] == list(dict.fromkeys(whose[here]))
        at += r["n_tokens"]
    assert at == len(want)


def test_pages_that_are_made_of_known_parts():
    """Pages put together at random from an article's parts and from boilerplate: the article comes back, whole and in order."""
    rnd = random.Random(8)
    say = lambda: "It is one of the texts that are in the page and it is of some length, number %d of them." % rnd.randrange(10**6)
    made_of = [
        lambda s: (f"<p>{s}</p>", [s]),
        lambda s: (f"<h2>{s[:20]}</h2><p>{s}</p>", [" ".join(s[:20].split()), s]),
        lambda s: (f"<ul><li>{s}</li><li>short &amp; sweet</li></ul>", [s, "short & sweet"]),
        lambda s: (f"<p>{s} <a href='x'>a link</a> &#8211; <em>so</em>.</p>", [f"{s} a link – so."]),
        lambda s: (f"<blockquote><p>{s}</p></blockquote>", [s]),
        lambda s: (f"<table><tr><td>{s}</td><td>7</td></tr></table>", [f"{s} 7"]),
        lambda s: (f"<section id='search-results-of-1990'><h3>Head</h3><p>{s}</p></section>", ["Head", s]),
    ]
    boilerplate = [
        lambda s: f"<nav><a href=a>{s}</a></nav>",
        lambda s: f"<aside><p>{s}</p></aside>",
        lambda s: f"<div class='ad-slot'><p>{s}</p></div>",
        lambda s: f"<div id='cookie-notice'>{s}</div>",
        lambda s: f"<form><label>{s}</label><input></form>",
        lambda s: f"<script>if (a < b) '{s}'</script><style>{s}</style><!-- {s} -->",
        lambda s: f"<section class='comments'><article class='comment'><p>{s}</p></article></section>",
    ]
    for _ in range(200):
        body, want = [], []
        for _ in range(rnd.randrange(1, 7)):
            part, lines = rnd.choice(made_of)(say())
            body.append(part)
            want += lines
            if rnd.random() < 0.4:
                body.append(rnd.choice(boilerplate)(say()))
        tag = rnd.choice(["article", "main", "main><article"])
        inner = "".join(body)
        close = "".join(f"</{t.strip('<>')}>" for t in reversed(tag.split("><")))
        around = [rnd.choice(boilerplate)(say()) for _ in range(4)]
        page = f"<!DOCTYPE html><html><head><title>{html.escape(say())}</title></head><body>{around[0]}{around[1]}<{tag}>{inner}{close}{around[2]}{around[3]}<footer>&copy; {say()}</footer></body></html>"
        assert html_text.main_text(page).split("\n") == want, page
