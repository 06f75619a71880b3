"""The training-data operations against brute force and exact round trips, on awkward rows."""

import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, decontaminate, html_text, importance, mixing, near_dup, pii, quality_rules, sharding, token_shards
from tessera.llm import words as words_mod

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, size string, key string, record string, quality string, marks string, slot string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
sha = lambda s: hashlib.sha256(s.encode()).hexdigest()


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls, empty and long texts, ties, repeated rows and columns named like internal ones."""
    rnd = random.Random(3)
    vocabulary = ["the", "of", "and", "to", "Haus", "été", "niño", "word", "x1", "𝔘"] + [f"w{i}" for i in range(300)]
    prose = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    base = [prose(120) for _ in range(6)]
    texts = [*base, base[0], base[0].upper(), base[1] + " more", " ".join(["same"] * 200), "", None, " \n ", "!!! ***", "one two", "one two", "one, TWO!", base[2].replace("the", "THE,"), prose(30000), "\n".join(["a line of some words"] * 9), "x" * 50000]
    texts += [" ".join(base[3].split()[:-2] + [f"n{i}"]) for i in range(5)]
    rows = [(i, t, "en", ["a", "b", None, "c"][i % 4], 1, "s", "k", "r", "q", "m", "t") for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[0], None, None, None) + rows[0][5:], (None, None, None, None, None) + rows[0][5:], (3, "another text of id 3", "en", "a", 1) + rows[0][5:]]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def labels_of(spark):
    rows = [(i, 1 if i < 6 else 0, 0) for i in range(20)] + [(0, 1, 0), (2, 0, 0), (None, 1, 0), (3, None, 0), (4, 1, None)]
    return spark.createDataFrame(rows, "doc_id bigint, quality int, toxic int")


def test_quality_counts(awkward, empty):
    seen = sorted((tuple(r)[:8] for r in quality_rules.report(awkward).collect()), key=repr)
    want = []
    for r in awkward.collect():
        text = r["text"] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", text)
        three = list(zip(w, w[1:], w[2:], strict=False))
        many = {t for t in three if three.count(t) > 1} if len(w) < 3000 else {t for t, n in __import__("collections").Counter(three).items() if n > 1}
        cover = {i + j for i, t in enumerate(three) if t in many for j in range(3)}
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want.append((r["doc_id"], len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(cover), len(w) < 50 or 100 * len(cover) > 50 * len(w)))
    assert [s[:7] for s in seen] == sorted(want, key=repr)
    assert not any(s[6] and s[7] for s in seen)
    assert quality_rules.report(empty).count() == 0 and quality_rules.keep(empty).columns == empty.columns
    assert quality_rules.keep(awkward).columns == awkward.columns


def test_expectation_maximisation_finds_the_accuracies():
    rnd = np.random.default_rng(1)
    k, n = len(quality_rules.RULES), 20000
    good = rnd.random(n) < 0.8
    on_good, on_bad = np.full(k, 0.97), np.linspace(0.5, 0.9, k)
    right = rnd.random((n, k)) < np.where(good[:, None], on_good, on_bad)
    votes = np.where(right == good[:, None], 1, -1)
    patterns, counts = np.unique((votes + 1) @ 3 ** np.arange(k), return_counts=True)
    model = quality_rules.expectation_maximisation(patterns, counts)
    assert abs(model.prior - 0.8) < 0.03 and np.abs(np.array(model.on_bad) - on_bad).max() < 0.06
    assert ((model.posterior(votes) > 0.5) == good).mean() > 0.98


def test_quality_agrees_with_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_rules.report(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality", "kept").count().collect()
    n = {(r["quality"], r["kept"]): r["count"] for r in rows}
    assert n[1, True] > 0.98 * (n[1, True] + n.get((1, False), 0)) and n[0, False] > 0.7 * (n[0, False] + n.get((0, True), 0))


def sets(df):
    out = []
    for r in df.collect():
        w = words(r["text"])
        out.append((r["doc_id"], frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (frozenset([tuple(w)]) if w else frozenset())))
    return out


def test_near_duplicates(awkward, empty):
    rows = sets(awkward)
    n = len(rows)
    link = [[i != j and bool(a & b) and len(a & b) / len(a | b) >= 0.8 for j, (_, b) in enumerate(rows)] for i, (_, a) in enumerate(rows)]
    root = list(range(n))
    for _ in range(n):
        root = [min([root[i], *[root[j] for j in range(n) if link[i][j]]]) for i in range(n)]
    least = {r: min((rows[i][0] for i in range(n) if root[i] == r and rows[i][0] is not None), default=None) for r in root}
    want = sorted(((rows[i][0], least[root[i]], sum(link[i])) for i in range(n)), key=repr)
    got = sorted(((r["doc_id"], r["class_id"], r["n_links"]) for r in near_dup.near_duplicates(awkward).collect()), key=repr)
    assert got == want
    stay = near_dup.keep_one(awkward)
    wordless = sum(not s for _, s in rows)
    assert stay.columns == awkward.columns and stay.count() == len({root[i] for i in range(n) if rows[i][1]}) + wordless
    assert near_dup.near_duplicates(empty).count() == 0 and near_dup.keep_one(empty).count() == 0


def test_large_groups_of_near_copies(spark):
    """More members than a block holds: no link is lost and none is counted twice."""
    rnd = random.Random(5)
    base = [f"v{rnd.randrange(900)}" for _ in range(60)]
    rows = []
    for i in range(700):
        w = list(base)
        w[rnd.randrange(60)] = f"z{i % 300}"
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    s = dict(sets(df))
    want = {i: 0 for i in s}
    for a, b in itertools.combinations(s, 2):
        if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
            want[a] += 1
            want[b] += 1
    got = {r["doc_id"]: (r["n_links"], r["class_id"]) for r in near_dup.near_duplicates(df).collect()}
    lost = sum(want.values()) - sum(n for n, _ in got.values())
    assert 0 <= lost <= 2e-4 * sum(want.values())
    assert {c for i, (_, c) in got.items() if want[i]} == {0}


def test_null_and_repeated_ids_do_not_multiply_texts(spark, monkeypatch):
    """A candidate meets its own text, not that of every row under its doc_id."""
    rnd = random.Random(6)
    texts = [" ".join(f"u{rnd.randrange(5000)}" for _ in range(60)) for _ in range(60)]
    texts += [t + " end" for t in texts]
    right = near_dup.verified
    for same in (None, 7):
        df = spark.createDataFrame([(same, t) for t in texts + texts[:5]], "doc_id bigint, text string")
        rows = near_dup.near_duplicates(df).collect()
        assert sorted(r["n_links"] for r in rows) == [1] * 110 + [2] * 15 and {r["class_id"] for r in rows} == {same}

        def counted(threshold):
            def run(batches):
                for b in batches:
                    yield pa.RecordBatch.from_arrays([b["key"], pa.array([1] * len(b), pa.int64()), b["key"]], ["key", "links", "root"])

            return run

        monkeypatch.setattr(near_dup, "verified", counted)
        assert max(r["n_links"] for r in near_dup.near_duplicates(df).collect()) <= near_dup.BANDS + 1
        monkeypatch.setattr(near_dup, "verified", right)


def test_pruning_keeps_what_may_reach_the_threshold():
    least = near_dup.least_matches(0.8, 1e-6)
    assert list(least) == [20, 40, 60, 80] and all(m < 0.8 * n for n, m in least.items())
    draws = np.random.default_rng(0).random((200_000, 80)) < 0.8
    assert np.mean([(draws[:, :n].sum(1) < m) for n, m in least.items()]) < 1e-4


def test_components(spark):
    path = [(f"n{i:04}", f"n{i + 1:04}") for i in range(300)] + [("x", "y"), ("y", "x"), ("z", "z")]
    out = {r["node"]: r["root"] for r in near_dup.components(spark.createDataFrame(path, "a string, b string")).collect()}
    assert out == {f"n{i:04}": "n0000" for i in range(1, 301)} | {"y": "x"}


def contamination(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        for i in range(max(1, len(w) - 12)) if w else []:
            windows.setdefault(tuple(w[i : i + 13]), set()).add(item)
    out = []
    for r in docs.collect():
        w, hit, found = words(r["text"]), set(), set()
        for k in {len(x) for x in windows}:
            for i in range(len(w) - k + 1):
                if tuple(w[i : i + k]) in windows:
                    hit |= set(range(i, i + k))
                    found |= windows[tuple(w[i : i + k])]
        names = sorted({str(i) for i in found if i is not None})
        out.append((r["doc_id"], len(w), len(hit), len(names), sha(",".join(names)), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


@pytest.mark.parametrize("most_bytes", [decontaminate.MOST_BYTES, 0])
def test_decontamination(spark, awkward, empty, most_bytes):
    """By tables in every task, and by the join by shuffle."""
    texts = [r["text"] for r in awkward.where("doc_id < 6").orderBy("doc_id").collect()]
    items = [(1, texts[0]), (2, " ".join(texts[1].split()[3:20])), (10, "one two"), (None, "the of"), (4, None), (5, "!!"), (6, "no such words anywhere at all"), (1, "same same"), (7, "word"), (8, " ".join(texts[0].split()[:13]))]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    assert sorted(map(tuple, decontaminate.contamination(awkward, bench, most_bytes).collect()), key=repr) == contamination(awkward, items)
    left = decontaminate.decontaminate(awkward, bench, most_bytes)
    assert left.columns == awkward.columns and left.count() == sum(not x[5] for x in contamination(awkward, items))
    assert decontaminate.contamination(empty, bench, most_bytes).count() == 0
    assert decontaminate.decontaminate(awkward, bench.limit(0), most_bytes - 1).count() == awkward.count()


def test_sharding(awkward, empty, tmp_path):
    placed = sharding.shards(awkward, bucket_bytes=4000)
    rows = placed.select("shard", "slot", "record.*").collect()
    assert sorted((repr((r["doc_id"], r["text"], r["key"])) for r in rows)) == sorted(repr((r["doc_id"], r["text"], r["key"])) for r in awkward.collect())
    for s, group in itertools.groupby(sorted(rows, key=lambda r: (r["shard"], r["slot"])), key=lambda r: r["shard"]):
        assert [r["slot"] for r in group] == list(range(sum(r["shard"] == s for r in rows)))
    for r in sharding.digest(placed).join(awkward.dropDuplicates(["doc_id"]).select("doc_id", "text"), "doc_id").where("doc_id <> 3").collect():
        data = (r["text"] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 8, zlib.crc32(data)) and r["grown_shard"] in (r["shard"], 24)
    assert sharding.digest(sharding.shards(empty)).count() == 0
    sharding.write_shards(placed, str(tmp_path / "s"))
    back = awkward.sparkSession.read.parquet(str(tmp_path / "s"))
    assert back.count() == awkward.count()


def test_shards_by_hand_and_slots_whatever_the_plan(spark):
    """Shards from xxHash by its own library; the same slots with other joins and partitions; a hot doc_id spreads over buckets."""
    import xxhash

    def rendezvous(doc_id, n):
        draws = []
        for s in range(n):
            h = 42
            for data in ([] if doc_id is None else [doc_id.to_bytes(8, "little", signed=True)]) + [x.to_bytes(4, "little") for x in (s, sharding.SEED)]:
                h = xxhash.xxh64_intdigest(data, h)
            draws.append(h - (1 << 64) if h >> 63 else h)
        return draws.index(max(draws))

    rnd = random.Random(7)
    rows = [(None if i % 3 == 0 else i % 700, "t" * rnd.randrange(90)) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4).sortWithinPartitions("doc_id", "text")
    kept = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold", "spark.sql.shuffle.partitions")}
    seen = []
    try:
        for change in ({}, {"spark.sql.autoBroadcastJoinThreshold": "-1"}, {"spark.sql.adaptive.enabled": "false", "spark.sql.shuffle.partitions": "3"}):
            for k, v in (kept | change).items():
                spark.conf.set(k, v)
            placed = sharding.shards(df, bucket_bytes=4000)
            seen.append(sorted(map(repr, sharding.digest(placed).collect())))
    finally:
        for k, v in kept.items():
            spark.conf.set(k, v)
    assert seen[0] == seen[1] == seen[2]
    for r in sharding.digest(placed).select("doc_id", "shard", "grown_shard").distinct().collect():
        assert r["shard"] == rendezvous(r["doc_id"], 24) and r["grown_shard"] == rendezvous(r["doc_id"], 25)
    held = placed.groupBy(F.spark_partition_id()).agg(F.sum(sharding.stored_size(F.col("record.text"))).alias("n")).collect()
    assert max(r["n"] for r in held) < 2 * 4000


def test_mixing(spark, awkward, empty):
    rows = mixing.report(awkward).collect()
    assert len(rows) == awkward.count() and all(r["taken"] <= 3 * r["size"] for r in rows)
    size = {}
    for r in awkward.collect():
        size[r["source"]] = size.get(r["source"], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, full, total = {}, set(), sum(size.values())
    while True:
        rest = total - sum(3 * size[s] for s in full)
        level = rest / sum(weight[s] for s in order if s not in full)
        target = {s: 3 * size[s] if s in full else weight[s] * level for s in order}
        over = {s for s in order if target[s] > 3 * size[s] + 1e-9}
        if not over:
            break
        full |= over
    assert {round(r["target"], 6) for r in rows} == {round(t, 6) for t in target.values()} and {r["source_size"] for r in rows} == set(size.values())
    assert sorted(map(tuple, mixing.report(awkward.repartition(5)).collect()), key=repr) == sorted(map(tuple, rows), key=repr)
    mixed = mixing.mixed(awkward)
    assert mixed.columns == awkward.columns and mixed.select(F.sum(mixing.size_of(F.col("text")))).first()[0] == sum(r["taken"] for r in rows)
    assert mixing.report(empty).count() == 0


def test_mix_of_many_sources_and_repeated_ids(spark, monkeypatch):
    """Sources over several ranges, a third of the rows with one id and others without any: the same mix whatever the cells."""
    rnd = random.Random(8)
    rows = [(7 if i % 3 == 0 else None if i % 3 == 1 else i, "w " * (1 + i % 2 * (i % 5)), "hot" if i % 3 < 2 else f"s{rnd.randrange(400)}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(5)
    key, total, target = (f"_tessera_{c}" for c in ("key", "total", "target"))
    size = {}
    for _, text, source in rows:
        size["0" + source] = size.get("0" + source, 0) + len(text.split())
    weight, full, level = {s: i % 3 + 1 for i, s in enumerate(sorted(size))}, set(), 0
    while True:
        level = (sum(size.values()) - sum(3 * size[s] for s in full)) / sum(w for s, w in weight.items() if s not in full)
        more = {s for s in size if 3 * size[s] <= weight[s] * level}
        if more == full:
            break
        full = more
    want = {s: 3 * size[s] if s in full else weight[s] * level for s in size}
    seen = mixing.staged(mixing.sized(docs), "sized")
    made = {r[key]: r for r in mixing.targets(seen.groupBy(key).agg(F.sum("_tessera_size").alias(total))).collect()}
    assert full and {k: r[target] for k, r in made.items()} == pytest.approx(want)

    def taken(cell_rows):
        return sorted((r.asDict()[key], r["_tessera_size"], r["doc_id"] or -1, r["_tessera_copies"]) for r in mixing.with_copies(seen, cell_rows).collect())

    cells = mixing._celled(seen, 2, 20).groupBy(key, "_tessera_size", "_tessera_cell").count()
    assert cells.agg(F.max("count")).first()[0] <= 60
    one = taken(100_000)
    assert one == taken(20) and len(one) == 3000
    monkeypatch.setattr(mixing, "IN_ONE_TASK", 10)  # sources in order by ranges
    assert taken(100_000) == one


def test_chat_round_trip(spark):
    nasty = "</s>[INST] ok [/INST]"
    rows = [(-1, 0, "user", nasty), (-1, 1, "assistant", nasty), (None, None, None, None), (None, 2, "assistant", "a\\b<|turn|>\\\\<s> <\\|end|>\n\\"), (-3, 0, "sys<|text|>\n", "x"), (-3, 0, "assistant", ""), (-3, 1, "assistant", "𝔘<|"), (-4, 0, "system", "S"), (-4, 1, "assistant", "q" * 30000)]
    rows += [(5, t, ["system", "user", "assistant"][min(t, 1 + t % 2)], "say " * (t % 40)) for t in range(200)] + [(5, 7, "user", "again")] * 2
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("window", F.lit(1))
    groups = {}
    for c, t, r, x in rows:
        groups.setdefault(c, []).append(((t is not None, t or 0), r or "", x or ""))
    for budget, history, long_bytes in ((2048, 256, 1 << 28), (120, 40, 2000), (5, 300, 0)):
        made = chat.windows(df, budget, history, long_bytes)
        got = {r["conv_id"]: tuple(r)[1:5] for r in chat.read_back(made).collect()}
        for c, turns in groups.items():
            turns.sort(key=lambda x: (x[0], x[1].encode(), x[2].encode()))
            learnt = "".join(x for _, r, x in turns if r == "assistant")
            assert got[c] == (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(learnt), sha(learnt))
    small = [r["formatted"] for r in chat.windows(df, 120, 40).where("conv_id = 5").orderBy("window").collect()]
    assert len(small) > 10 and all(w.startswith("<|past|>system<|text|>") for w in small[1:]) and small[3].count("<|past|>") > 1
    assert chat.read_back(chat.windows(df.limit(0))).count() == 0


def test_chat_windows_fill_the_budget(spark):
    """A long turn has a window of its own and leaves the others as they are; none exceeds the budget but by one turn."""
    say = "word " * 30
    turns = [(0, 0, "system", "be kind")] + [(0, t, ("user", "assistant")[t % 2], say) for t in range(1, 101)]
    split = lambda rows: [r["formatted"] for r in chat.windows(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string"), 512, 64).orderBy("window").collect()]
    even = split(turns)
    cost = lambda w: sum(len(x) // 4 + 4 for x in w.split("<|end|>\n")[:-1])
    assert all(cost(w) <= 700 for w in even) and len(even) <= 11
    long = [*turns, (0, 50, "user", "long " * 2000)]
    made = split(long)
    assert len(made) <= len(even) + 3 and sum(len(w) > 9000 for w in made) == 1
    lead = split([(0, 0, "system", "be kind"), (0, 1, "user", "long " * 2000), (0, 2, "assistant", "ok")])
    assert [w.count("<|turn|>") for w in lead] == [2, 1]
    wide = split([(0, t, "user", "漢" * 50) for t in range(40)])
    assert len(wide) >= 40 * 50 * 1.5 // 512


def test_a_long_conversation_in_many_blocks(spark):
    """A third of all turns in one conversation: the windows are the same however many tasks share it."""
    c = F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id"))
    role = F.when(F.col("id") == 0, "system").when(F.col("id") % 2 == 0, "user").otherwise("assistant")
    said = F.repeat(F.lit("word "), F.when(F.col("id") % 50 == 0, 600).otherwise(F.pmod(F.xxhash64("id"), F.lit(40))).cast("int"))
    turns = spark.range(1500).select(c.alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), said.alias("text"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    made = []
    try:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        for parts in (1, 16):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            assert chat._ordered(turns).select("part").distinct().count() >= parts // 2
            made.append(sorted(map(repr, chat.windows(turns, 512, 96, 0).collect())))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    mixed, whole = (sorted(map(repr, chat.windows(turns, 512, 96, most).collect())) for most in (10_000, 1 << 28))
    assert made[0] == made[1] == mixed == whole and len(whole) > 1000


def test_html():
    page = """<html><body class="page has-sidebar"><header><h1>Site</h1></header><nav>x</nav><div id="cookie-notice">We use cookies on the site and we think that it is the best for you and for all of us.</div>
<main><article><header><h1>Title &amp; more</h1></header><p>Short.</p><p>It is the first of the paragraphs and it has <a href=q>a link</a> in it, with many words.<br>next line<br><br>Third bit<ul><li>One<li>Two</ul>
<table><tr><td>a</td><td>b</td></tr></table><aside>Related</aside><form>Email <input></form><div class="ad-slot">Buy</div><!-- c --><script>if(a<b){"</p>"}</script></article>
<section class="comments"><p>I think that it is the best of all and so on and on, for ever and ever more.</p></section></main><footer>&copy; me</footer></body></html>"""
    assert html_text.main_text(page).split("\n") == ["Title & more", "Short.", "It is the first of the paragraphs and it has a link in it, with many words. next line", "Third bit", "One", "Two", "a b"]
    plain = "<div><a href=a>Home</a> <a href=b>News</a></div><h2>Head</h2><p>" + "It is one of the words that are in the text and of it. " * 3 + "<p>Short end.<div>&copy; all rights</div>"
    assert html_text.main_text(plain).split("\n")[0] == "Head" and html_text.main_text(plain).split("\n")[-1] == "Short end."
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<nav>a</nav>") == ""
    assert html_text.main_text("<p>only") == "only" and html_text.main_text("a &lt;b&gt;<script>x") == "a <b>"


def test_html_class_names():
    said = "It is one of the texts that are in the page and it is of some length for this."
    body = f"<p>{said}</p>"
    for open_, close in (("<div class='page has-sidebar'><article class='post category-social'>", "</article></div>"), ("<main class='no-comments'><article class='post ad-free'>", "</article></main>"), ("<div class='content without-menu'>", "</div>")):
        assert html_text.main_text(f"{open_}{body}{close}") == said
    reader = "It is what I, the reader, have to say of this and that and it is long enough."
    assert html_text.main_text(f"<main>{body}<article class='comment even'><p>{reader}</p></article></main>") == said
    assert html_text.main_text(f"<article id=story>{body}</article><article class='comment'><p>{reader}</p></article>") == said
    assert html_text.main_text(f"<article class='promo-card'>{body}</article>") == said


def test_html_on_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    pages = pages.unionByName(spark.createDataFrame([(None, None, None), (-1, "u", "")], pages.schema))
    import html

    source = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in html_text.extract(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", source[r["page_id"]] or "", re.S)
        want = [y for x in re.split(r"</?(?:p|h1)>", inner[1] if inner else "") if (y := " ".join(html.unescape(re.sub(r"<[^>]+>", "", x)).split()))]
        assert r["text"] == "\n".join(want) and r["n_chars"] == len(r["text"])
    assert html_text.extract(pages.limit(0)).count() == 0


def test_a_wrapper_does_not_condemn_the_page():
    """A layout's name or a page-wide form is no boilerplate; what is named so beside an article stays out."""
    prose = "This is the long story of a town that was built by the sea and of the people who lived in it for years."
    other = "And this is what the readers of the paper had to say about it when they were asked for their views on it."
    article, side = f"<article><h1>Town</h1><p>{prose}</p><p>{prose}</p></article>", f"<p>{other}</p>"
    want = f"Town\n{prose}\n{prose}"
    for wrapped in (
        f"<div class='content-sidebar-wrap'><main><h1>Town</h1><p>{prose}</p><p>{prose}</p></main></div>",
        f"<div class='content-sidebar-wrap'><nav><p>{other}</p></nav>{article}</div>",
        f"<div class='layout-sidebar-right'>{article}</div>{side}",
        f"<form id='aspnetForm'>{article}<footer>{side}</footer></form>",
        f"<form id='aspnetForm'><h1>Town</h1><p>{prose}</p><p>{prose}</p></form>",
        f"<div id='page-header-wrap'><main><h1>Town</h1><p>{prose}</p><p>{prose}</p></main></div>",
        f"<main><div class='layout-sidebar-right'>{article}</div></main>",
        f"{article}<div class='related'><article>{side}</article><article>{side}</article></div>",
        f"{article}<div class='comments'>{side * 9}</div>",
    ):
        assert html_text.main_text(f"<html><body>{wrapped}</body></html>") == want, wrapped
    assert html_text.main_text(f"<body><form id='login'><label>Name</label><input> Password</form><nav>{side}</nav></body>") == ""
    assert html_text.main_text(f"<body><div hidden class='sidebar'><main>{side}</main></div></body>") == ""


def test_html_anchors_that_never_close():
    said = "It is one of the texts that are in the page and it is of some length for this."
    for anchor in ('<a name="top">', '<a id=x>', '<a href="#top">'):
        for body in (f"{anchor}<h1>Head</h1><p>{said}</p><p>{said} Too.</p>", f"<p>{anchor}</p><h1>Head</h1><p>{said}</p><p>{said} Too.</p>"):
            want = f"Head\n{said}\n{said} Too."
            assert html_text.main_text(f"<body><article>{body}</article></body>") == want
            assert html_text.main_text(f"<body><div>{body}</div></body>") == want
    assert html_text.main_text(f"<body><p>{said}</p><a href=x><div>{said} Of another page.</div></a></body>") == said
    assert html_text.main_text(f"<body><ul><li><a href=a>{said}<li><a href=b>{said}</ul><p>{said} This.</p></body>") == f"{said} This."


def test_html_wrappers_by_what_they_hold():
    said = "It is one of the texts that are in the page and it is of some length for this."
    other = f"<div><p>{said} Elsewhere.</p></div>"
    long = f"<p>{said}</p><p>Short.</p><p>{said} Too.</p><p>{said} And so on.</p>"
    for wrapper in ("div class='post comments-enabled'", "div class='content-sidebar-wrap'", "section class='layout-menu-left'", "form id='aspnetForm'"):
        text = html_text.main_text(f"<body><{wrapper}>{long}</{wrapper.split()[0]}>{other}</body>").split("\n")
        assert text[:4] == [said, "Short.", f"{said} Too.", f"{said} And so on."], wrapper
    for section in ("div class='comments'", "div id='post-comments'", "section class='user-replies'", "div class='sidebar'"):
        assert html_text.main_text(f"<body>{other}<{section}>{long}</{section.split()[0]}></body>") == f"{said} Elsewhere.", section


def test_html_of_languages_without_listed_words():
    zh = ["这是第一段正文，讲的是港口的历史，还有那里的人们。", "第二段也是正文；它说明了当时的情况，并且给出了几个例子。"]
    ru = ["Город стоит на берегу реки, и в нём живут рыбаки; летом сюда приезжают гости из других мест.", "Зимой здесь тихо, но в порту всё равно работают люди, которые чинят лодки и сети."]
    pl = ["Miasto leży nad rzeką, a jego mieszkańcy od wieków zajmują się rybołówstwem; latem przyjeżdżają tutaj goście z innych stron, którzy podziwiają stary port, wieże i mury.", "Zimą jest tutaj cicho, lecz w porcie nadal pracują ludzie, którzy naprawiają łodzie oraz sieci, gotują, śpiewają, opowiadają dawne historie i czekają na wiosnę."]
    english = "It is one of the texts that are in the page and it is of some length for this."
    for paragraphs in (zh, ru, pl):
        body = "".join(f"<p>{p}</p>" for p in paragraphs)
        assert html_text.main_text(f"<body><div class=menu>菜单</div><div>{body}</div><p>{english}</p></body>") == "\n".join([*paragraphs, english])
    assert html_text.main_text(f"<body><p>{english}</p><div><a href=a>首页</a> <a href=b>新闻</a></div><div>版权</div></body>").split("\n")[0] == english


def test_html_takes_linear_time():
    import time

    for unit in ("a <b ", '<a x="', "<!x", "<div>", "<div>x", '<a ">"', "</div", "<!--", "<td>", "<ul><li>x", "<title>", "<svg>x", "</b></i>", "<div class='", "<a href=x>y", "<a href=x>", "<div class=content-menu>x", "<a "):
        for end in ("", ">", "\">'>"):
            began = time.time()
            html_text.main_text(unit * (1_000_000 // len(unit)) + end)
            assert time.time() - began < 10, (unit, end)
    assert html_text.main_text("<p>a<!-- b <p>c") == "a" and html_text.main_text("<p>a<!--> b <!-- x --> c") == "a b c"


def test_html_ids_with_a_subject():
    """Inside an article a name that only contains a hint drops nothing of a section with text of length; a plain hint does."""
    said = "It is one of the texts that are in the page and it is of some length for this."
    for name in ("search-algorithms", "social-security-history", "form-of-government", "menu-planning"):
        assert html_text.main_text(f"<article><p>{said}</p><div id='{name}'><p>{said} Too.</p><h3>Share</h3><p>Short.</p><pre>code(x)</pre></div></article>") == f"{said}\n{said} Too.\nShare\nShort.\ncode(x)"
        assert html_text.main_text(f"<article><p>{said}</p><div id='{name}'><p>Share</p></div></article>") == said
    for name in ("ad", "ad-slot", "related-posts", "cookie-notice", "newsletter_box", "shareButtons", "comments"):
        assert html_text.main_text(f"<article><p>{said}</p><div class='{name}'><p>{said} Too.</p></div></article>") == said


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    digits = lambda m: re.sub(r"[^0-9]", "", m[0])
    out = [(0, *m.span()) for m in EMAIL.finditer(t)]
    out += [(1, *m.span()) for m in IP.finditer(t) if all(int(q) <= 255 for q in m[0].split("."))]
    out += [(2, *m.span()) for m in CARD.finditer(t) if 16 <= len(digits(m)) <= 19 and pii.luhn(digits(m))]
    return out + [(3, *m.span()) for m in PHONE.finditer(t) if 8 <= len(digits(m)) <= 15]


def test_pii_base_patterns():
    rnd = random.Random(5)
    for _ in range(20000):
        t = "".join(rnd.choice("a1.@ +-(4)%b2._") for _ in range(rnd.randrange(40)))
        assert pii.base_spans(t) == base(t)
    card = "4111 1111-1111 1111"
    assert pii.base_spans(card) == base(card) == [(2, 0, 19)]
    for long in ("a" * 60000 + "@", "1" * 60000, "1." * 30000, "+1" + "(" * 60000, "a@" * 20000, "5 " * 30000, "a.b" * 20000 + " at "):
        assert pii.base_spans(long) == [] or long[0] in "1"
        pii.candidates(long)


def test_pii_counts_of_several_spans(spark):
    """Counts of texts with several spans of a kind and of several kinds; zeros before an address's parts."""
    rnd = random.Random(6)
    pieces = ["a@b.cz", "1.2.3.4", "4111 1111 1111 1111", "+47 22 12 34 56", "x", "0" * 5000 + "1.2.3.4", "1.2.3." + "0" * 5000]
    texts = ["me@x.org or you@x.org", "mail a@b.cz, call +47 22 12 34 56", None, *[", ".join(rnd.choices(pieces, k=rnd.randrange(9))) for _ in range(200)]]
    got = pii.report(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).collect()
    assert len(got) == len(texts)
    plain = lambda t: t.replace("0" * 5000, "0")
    for r in got:
        t = texts[r["doc_id"]] or ""
        assert [r[f"n_{name}"] for name in pii.KINDS] == [sum(k == x for x, _, _ in base(plain(t))) for k in range(4)], t
        assert "0" * 5000 in t or r["base_sha256"] == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base(t)))


def test_pii_field_adds_repeated_entities(spark, awkward, empty):
    text = "call +1 (743) 555-3824 now. or (743) 555-3824 x 743-555-3824; 12345678 and me@x.example.com, me at x dot example dot com. ring 555-1234 Bob"
    rows = [(1, text), (2, None), (3, "555-123-4567 2020-01-02 10 000 000")]
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").where("doc_id > 9").union(spark.createDataFrame(rows, "doc_id bigint, text string"))
    out = {r["doc_id"]: r for r in pii.report(docs).collect()}
    for i, t in ((r["doc_id"], r["text"] or "") for r in docs.collect()):
        want = base(t)
        assert out[i]["base_sha256"] == sha(",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want))
        assert set(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want) <= set(out[i]["spans"].split(",")) or not want
    assert [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in out[1]["spans"].split(",")) if k == "phone"] == ["+1 (743) 555-3824", "(743) 555-3824", "743-555-3824"]
    assert out[3]["spans"] == out[2]["spans"] == ""
    assert pii.report(awkward).count() == awkward.count() and pii.report(empty).count() == 0


def test_marginals_equal_an_enumeration():
    """On chains exact; with a skip edge, which closes a loop, near and of the same verdict."""
    from collections import Counter

    rnd = random.Random(4)
    shapes = Counter({(s, k): rnd.randrange(1, 50) for s in (10, 12, 16) for k in (1, 3, pii.NONE)})
    field = pii.Field(shapes, Counter({(a, b): rnd.randrange(1, 60) for a in range(pii.NONE + 1) for b in range(pii.NONE + 1)}))
    agree = np.eye(pii.NONE + 1) * pii.AGREEMENT
    for case in range(30):
        n = rnd.randrange(1, 6)
        kinds = np.array([rnd.choice([3, pii.NONE]) for _ in range(n)])
        codes = np.array([rnd.choice([10, 12, 16]) for _ in range(n)])
        same = [f"x{i}" for i in range(n)]
        skip = case >= 15 and n > 2
        if skip:
            same[-1] = same[0]
        got = field.marginals(kinds, codes, np.zeros(n, np.int64), same)
        node = np.where((kinds == pii.NONE)[:, None], field.node[np.searchsorted(field.codes, codes)], -20.0)
        node[kinds != pii.NONE, kinds[kinds != pii.NONE]] = 0.0
        want = np.zeros((n, pii.NONE + 1))
        for z in itertools.product(range(pii.NONE + 1), repeat=n):
            score = sum(node[i, k] for i, k in enumerate(z)) + sum(field.chain[a, b] for a, b in itertools.pairwise(z)) + (agree[z[0], z[-1]] if skip else 0)
            for i, k in enumerate(z):
                want[i, k] += np.exp(score)
        want /= want.sum(1, keepdims=True)
        if skip:
            assert np.abs(got - want).max() < 0.1 and (got.argmax(1) == want.argmax(1)).all()
        else:
            assert np.abs(got - want).max() < 1e-3


def test_pii_redaction(spark, awkward, empty):
    clash = "doc_id bigint, text string, base string, spans string, row string, kinds string, _tessera_0 string"
    docs = spark.createDataFrame([(1, "\U0001d518 a@b.cz, 1.2.3.4 a@1.2.3.4 end") + ("x",) * 5, (2, None) + ("y",) * 5, (None, "none") + (None,) * 5], clash)
    made = pii.redact(docs)
    assert made.columns == docs.columns
    assert {r["doc_id"]: r["text"] for r in made.collect()} == {1: "\U0001d518 [email], [ip] [email] end", 2: None, None: "none"}
    assert {r["doc_id"]: r["base"] for r in made.collect()} == {1: "x", 2: "y", None: None}
    assert pii.redact(awkward).schema == awkward.schema and pii.redact(empty).count() == 0
    assert sorted(map(repr, pii.redact(awkward).where("text is null").collect())) == sorted(map(repr, awkward.where("text is null").collect()))


LOOSE = [
    ("call +47 22 12 34 56 or just 22123456 or 004722123456", ["22123456", "004722123456"]),
    ("call +1 (743) 555-3824 then 7435553824, order 22123456 and 1234567", ["7435553824"]),
    ("mail john@example.com or john at example.com", ["john at example.com"]),
    ("mail john@example.com or call jane at example.com", []),
    ("call +1 743 555 3824 or 555-3824 or 1-743-555-3824", ["555-3824", "1-743-555-3824"]),
    ("call +47 22 12 34 56 or 22 12 34 56 or 22 12 34 57", ["22 12 34 56"]),
    ("call 555-3824, abroad +1 743 555 3824", ["555-3824"]),
    ("call +49 30 1234567, here 030 1234567", ["030 1234567"]),
    ("host 192.168.10.12, that is 7 192 168 10 12 or 192[.]168[.]10[.]12 or 192 dot 168 dot 10 dot 13", ["192 168 10 12", "192[.]168[.]10[.]12"]),
    ("card 4111 1111 1111 1111, again 22 4111.1111.1111.1111 or 4111/1111/1111/1112", ["4111.1111.1111.1111"]),
]


def test_loose_spans_do_not_hang_on_other_text(spark):
    """Each loose form of a base span is added, with or without a stray sign elsewhere."""
    texts = [t + more for more in ("", " a dot b") for t, _ in LOOSE] + ["plain text with 12 34 56 78"] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in pii.report(docs).collect():
        text = texts[r["doc_id"]]
        base = {f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in pii.base_spans(text)}
        added = sorted(set(filter(None, r["spans"].split(","))) - base, key=lambda x: int(x.split(":")[1]))
        want = LOOSE[r["doc_id"] % len(LOOSE)][1] if r["doc_id"] < 2 * len(LOOSE) else []
        assert [text[int(x.split(":")[1]) : int(x.split(":")[2])] for x in added] == want, text
    for long in ("a" * 300_000 + "a@b.c", "a@b.c " + "a." * 150_000 + " at ", "1.2.3.4 " + "1 " * 150_000, "+47 22 12 34 56 " + "12-" * 100_000):
        pii.candidates(long)


def test_many_signs_take_linear_time():
    text = "@" * 2_000_000 + " a@b.cz"
    assert pii.base_spans(text) == [(0, 2_000_001, len(text))]
    for long in ("a+" * 500_000, "a%-" * 300_000, "a_b " * 200_000, "a." * 300_000, "(at) " * 100_000, "x at y " * 100_000):
        pii.candidates(long + " (at) dot ")


def test_importance(spark, awkward, empty):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    half = labels.where("doc_id % 2 = 0")
    out = importance.resample(docs, half)
    held = out.join(labels.where("doc_id % 2 = 1"), "doc_id").groupBy("quality", "toxic").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    kept = {(r["quality"], r["toxic"]): r["k"] for r in held}
    assert kept[1, 0] > 0.93 and kept[0, 0] < 0.1 and kept[1, 1] < 0.3
    rows = out.collect()
    k = sum(r["kept"] for r in rows)
    assert {r["doc_id"] for r in sorted(rows, key=lambda r: -r["priority"])[:k]} == {r["doc_id"] for r in rows if r["kept"]}
    odd = importance.resample(awkward, labels_of(spark)).collect()
    assert len(odd) == awkward.count() and importance.resample(empty, labels_of(spark).limit(0)).count() == 0


def test_importance_weights_by_hand(spark):
    """Log weights from plain counts of each text's n-grams; texts without any are not kept."""
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice(["the", "of", "Haus", "x,y", "été", "w1", "w2"]) for _ in range(rnd.randrange(1, 90))) for _ in range(60)]
    texts += ["\n", "\t\n", "", None, " ", "!!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(60)], "doc_id bigint, quality int, toxic int")
    grams = []
    for x in texts:
        found = [importance._ngrams(t)[0].tolist() for t in words_mod.texts(pa.array([x], pa.string()))]
        grams.append(found[0] if found else [])
    every, good = np.zeros(importance.BUCKETS), np.zeros(importance.BUCKETS)
    for i, g in enumerate(grams):
        for b in g:
            every[b] += 1
            good[b] += i < 60 and i % 3 > 0
    raw = (every + 0.5) / (every.sum() + 0.5 * importance.BUCKETS)
    expected = good.sum() * raw
    rate = np.where(np.abs(good - expected) < 3 * np.sqrt(expected + 1), 1.0, (good + 1) / (expected + 1))
    ratio = np.log(rate / (raw @ rate))
    out = {r["doc_id"]: r for r in importance.resample(docs, labels).collect()}
    assert all(abs(out[i]["log_weight"] - sum(ratio[b] for b in g)) < 1e-9 for i, g in enumerate(grams))
    assert not any(out[i]["kept"] for i, g in enumerate(grams) if not g) and [bool(g) for g in grams[60:]] == [False] * 5 + [True]
    assert sum(r["kept"] for r in out.values()) == round(40 / 60 * len(texts))


def test_word_beginnings():
    """As many n-grams as by hand, and a word's beginnings are those of a word that starts alike."""
    batch = pa.array(["Été, étés étéska abc", None, "", "ab", "étésabc x1y2z3"])
    (t,) = words_mod.texts(batch)
    word, hashes = importance._beginnings(t)
    said = [w for x in batch.to_pylist() for w in words(x)]
    want = [(i, w[:n]) for n in importance.BEGINNINGS for i, w in enumerate(said) if len(w) > n]
    assert word.tolist() == [i for i, _ in want]
    assert len(set(hashes.tolist())) == len({b for _, b in want})
    assert len({(b, h) for (_, b), h in zip(want, hashes.tolist(), strict=True)}) == len({b for _, b in want})


def test_kth_largest(spark):
    values = [random.Random(2).randrange(-(1 << 60), 1 << 60) for _ in range(500)] + [7, 7, 7]
    df = spark.createDataFrame([(v,) for v in values], "v bigint")
    for k in (1, 2, 250, 503):
        assert importance.kth_largest(df, k) == sorted(values, reverse=True)[k - 1]
    assert importance.kth_largest(df, 504) is None


def test_feistel_is_a_permutation():
    for n in (1, 2, 3, 5, 100, 1025):
        out = token_shards.feistel(np.arange(n), n, 9)
        assert sorted(out) == list(range(n)) and (n < 100 or (out != token_shards.feistel(np.arange(n), n, 10)).any())


def test_tokens_come_back(spark, awkward, empty, tmp_path):
    made = token_shards.training_order(awkward, length=64, per_shard=16)
    encoder, end = token_shards.encoding(token_shards.VOCABULARY)
    rows = sorted(made.collect(), key=lambda r: r["slot"])
    assert [r["slot"] for r in rows] == list(range(len(rows))) and all(len(r["tokens"]) == 128 and r["slot"] == 16 * r["shard"] + r["row"] for r in rows)
    ids = lambda x: [*encoder.encode_ordinary(x or ""), end]
    got, want = [], []
    for r in rows:
        got += np.frombuffer(r["tokens"], np.uint16)[: r["n_tokens"]].tolist()
    for r in awkward.collect():
        want += ids(r["text"])
    assert sorted(got) == sorted(want)
    path = str(tmp_path / "t")
    token_shards.write_shards(made, path)
    files = sorted((tmp_path / "t").glob("shard=*/part-*"), key=lambda f: int(f.parent.name[6:]))
    assert [f.stat().st_size for f in files] == [129 * sum(r["shard"] == s for r in rows) for s in range(len(files))]
    for f in files:  # fixed strides of raw ids
        for k, r in enumerate(r for r in rows if r["shard"] == int(f.parent.name[6:])):
            assert f.read_bytes()[129 * k : 129 * k + 128] == r["tokens"]
    for slot in (0, 20, len(rows) - 1, len(rows)):
        assert [tuple(r) for r in token_shards.read_from(spark, path, slot, 129, 16).collect()] == [(r["slot"], r["tokens"]) for r in rows[slot:]]
    assert token_shards.training_order(empty).count() == 0


def test_sequences_hold_their_documents_in_order(spark):
    """One task: the run of all documents, cut every 16 ids; each list names the documents of its ids."""
    rnd = random.Random(8)
    texts = ["", None, "a", *["word " * rnd.randrange(60) for _ in range(60)], " x" * 31, ""]
    encoder, end = token_shards.encoding(token_shards.VOCABULARY)
    run = [(i, t) for i, x in enumerate(texts) for t in [*encoder.encode_ordinary(x or ""), end]]
    cut = token_shards.CHARS_AT_ONCE
    try:
        token_shards.CHARS_AT_ONCE = 50
        import unittest.mock as mock

        with mock.patch.object(token_shards.TaskContext, "get", lambda: mock.Mock(partitionId=lambda: 3)):
            batches = [pa.RecordBatch.from_arrays([pa.array(range(a, b), pa.int64()), pa.array(texts[a:b], pa.string())], ["doc_id", "text"]) for a, b in ((0, 2), (2, 40), (40, len(texts)))]
            rows = pa.Table.from_batches(token_shards.sequences(token_shards.VOCABULARY, 16)(iter(batches))).to_pylist()
    finally:
        token_shards.CHARS_AT_ONCE = cut
    assert [r["seq"] for r in rows] == list(range(len(rows))) and len(rows) == -(-len(run) // 16)
    for k, r in enumerate(rows):
        mine = run[16 * k : 16 * k + 16]
        assert np.frombuffer(r["tokens"], np.uint16).tolist() == [t for _, t in mine] + [end] * (16 - len(mine))
        assert r["doc_ids"] == sorted({i for i, _ in mine}) and r["n_tokens"] == len(mine) and r["part"] == 3


def test_very_long_runs_are_encoded_whole():
    encoder, _ = token_shards.encoding(token_shards.VOCABULARY)
    ids = lambda text: np.concatenate([*token_shards.encode(encoder, text)]).tolist()
    for n in (9_999, 10_000, 10_001, 30_000):
        for sign in (" ", "\n", "\u3000", " \n", "\t"):
            for before, after in (("", ""), ("word", ""), ("", "word"), ("a.", "b"), ("1", "!x"), (" x", "\x1cy"), ("it", "'s")):
                text = before + (sign * n)[:n] + after
                assert ids(text) == encoder.encode_ordinary(text), (n, sign, before, after)
    both = ("a" + " " * 20_000 + "b" + "\n" * 15_000) * 3
    assert ids(both) == encoder.encode_ordinary(both)
    for text in (" " * 5_000_000, "\n" * 5_000_000 + "x", "\n " * 2_000_000, "a" * 5_000_000, "!" * 1_000_000):
        assert encoder.decode(ids(text)) == text
