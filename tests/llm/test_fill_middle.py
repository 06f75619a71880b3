"""Fill-in-middle against a plain build of the forms, and its round trip."""

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import fill_middle as fim


def plainly(text, draws, rate=100, spm=50):
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or draws[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((draws[0] % (n + 1), draws[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if draws[3] % 100 < spm else "psm"
    return n, form, len(p), len(m), f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}"


@settings(max_examples=300, deadline=None)
@given(st.text(st.sampled_from(["a", "é", "😀", "\n", "<", "P", "S", "M", ">", "\r", " "])), st.lists(st.integers(0, 2**32 - 1), min_size=4, max_size=4))
def test_forms_and_round_trip(text, draws):
    made = fim._one(text, draws, 100, 50)
    assert made == plainly(text, draws)
    if made[1] != "plain":
        assert fim.rebuilt(made[4].encode(), made[1]).decode() == text


def test_rotation_is_in_pieces(monkeypatch):
    for piece in (1, 3, 64):
        monkeypatch.setattr(fim, "PIECE", piece)
        for n in range(12):
            for k in range(n + 1):
                data = bytearray(range(n))
                fim.rotate(data, 0, k, n)
                assert data == bytearray([*range(k, n), *range(k)])
                fim.rotate(data, 0, n - k, n)
                assert data == bytearray(range(n))


def test_long_text():
    text = "zeile é\n" * 400_000
    made = fim._one(text, [123_456, 333_333, 0, 0], 100, 50)
    assert made == plainly(text, [123_456, 333_333, 0, 0])
    assert fim.rebuilt(made[4].encode(), made[1]).decode() == text


def test_awkward_rows(spark):
    rnd = random.Random(4)
    texts = [None, "", "\n", "\n\n", "one line", "a\nb\n", "holds <P> itself\n", "<P", ">\n<", "x\n" * 50_000, "a" * 200_000]
    rows = [(i, t, "f", 1, "o") for i, t in enumerate(texts)] + [(None, "no id\nhere", None, None, None)] + [(3, "\n\n", "f", 1, "o")] * 2
    rnd.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, Form string, `n.x` int, made string").repartition(3)
    made = fim.transform(docs)
    assert made.columns == ["doc_id", "text", "n.x", "made", "n", "form", "prefix_chars", "middle_chars", "output"]
    back = made.withColumn("back", fim.restore(made["output"], made["form"])).collect()
    assert len(back) == len(rows) and all(r["back"] == (r["text"] or "") for r in back)
    assert {r["form"] for r in back if not r["text"] or "<P>" in r["text"]} == {"plain"}
    assert len({tuple(r) for r in back if r["doc_id"] == 3}) == 1
    assert fim.report(docs.limit(0)).collect() == []
    half = fim.transform(docs, seed=1, rate=0).collect()
    assert all(r["form"] == "plain" and r["output"] == (r["text"] or "") for r in half)
