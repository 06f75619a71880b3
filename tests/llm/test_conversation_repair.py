"""Repairs against a search without bounds, long conversations against short ones, the query against a plain program."""

import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessera.llm import conversation_repair as repair
from tessera.llm import queries

SF = "/root/testdata/sf0.001"
LEGAL, PREFIX = re.compile(r"(s?(ua)+)?"), re.compile(r"s?(ua)*u?")


def cheapest(roles, faults):
    """All edits in order of (cost, letters), without bounds: cost, letters and the repaired roles' initials."""
    heap, done = [(0, "", 0, "")], set()
    while True:
        cost, letters, i, made = heapq.heappop(heap)
        if i == len(roles) and LEGAL.fullmatch(made):
            return cost, letters, made
        if (i, made[-1:]) in done:
            continue
        done.add((i, made[-1:]))

        def push(more, letter, j, x):
            if PREFIX.fullmatch(made + x):
                heapq.heappush(heap, (cost + more, letters + letter, j, made + x))  # noqa: B023

        for x in "ua":
            push(3, "I", i, x)
        if i < len(roles):
            push(4, "D", i + 1, "")
            if faults[i] in (repair.FINE, repair.TRUNCATED):
                more = 3 if faults[i] == repair.TRUNCATED else 0
                if roles[i][:1] in ("s", "u", "a"):
                    push(more, "K", i + 1, roles[i][0])
                for x in "ua":
                    push(3 + more, "R", i + 1, x)


def test_search_is_optimal(monkeypatch):
    rnd = random.Random(13)
    for _ in range(600):
        n = rnd.randrange(9)
        roles = [rnd.choice(["system", "user", "assistant", "assistant", "user", "tool", ""]) for _ in range(n)]
        faults = [rnd.choice([0, 0, 0, 1, 2, 3]) for _ in range(n)]
        want = cheapest(roles, faults)[:2]
        rows = repair.coded(roles, faults)
        assert repair.search(rows, 0, repair.ENDS) == want
        for block in (1, 2, 5):
            with monkeypatch.context() as m:
                m.setattr(repair, "BLOCK", block)
                assert repair.best(rows) == want


def test_weaker_bounds_give_the_same(monkeypatch):
    """What the bounds leave out, incumbent and dominance table still find."""
    rnd = random.Random(14)
    cases = [("".join(chr(65 + rnd.randrange(16)) for _ in range(rnd.randrange(8)))) for _ in range(150)]
    want = [repair.search(c, 0, repair.ENDS) for c in cases]
    monkeypatch.setattr(repair, "_bounds", lambda rows, leave: [[0] * 4 for _ in range(len(rows) + 1)])
    assert [repair.search.__wrapped__(c, 0, repair.ENDS) for c in cases] == want


def plainly(rows):
    """The contract's columns of one conversation's rows (turn, role, text) after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns = {t for t, _, _ in rows if t is not None}
    faults, seen = [], set()
    for _, role, text in rows:
        said = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append(1 if not said else 2 if (role, text) in seen else 0 if said[-1] in ".!?" else 3)
        seen.add((role, text))
    cost, audit, roles = cheapest([r for _, r, _ in rows], faults)
    left, i, k = [], 0, 0
    for letter in audit:
        if letter in "IR":
            left.append({"u": "user", "a": "assistant"}[roles[k]] + ":" + ("" if letter == "I" else rows[i][2]))
        elif letter == "K":
            left.append(rows[i][1] + ":" + rows[i][2])
        k += letter != "D"
        i += letter != "I"
    pairs = zip(rows, rows[1:])
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(k) for k in (1, 2, 3)),
        sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in pairs),
        cost,
        audit,
        hashlib.sha256("\n".join(left).encode()).hexdigest(),
    )


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        said = lambda x: " " if x is None else str(x)
        role, text, what = said(role), said(text), zlib.crc32(f"{said(conv)}:{said(turn)}".encode()) % 20
        own = out.setdefault(conv, [])
        row = (turn, "user" if what == 4 else role, "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text)
        own += [row] * {0: 0, 3: 2}.get(what, 1)
    return {conv: plainly(own) for conv, own in out.items()}


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def test_query(spark):
    got = queries.op13_conversation_repair(spark, SF)
    assert got.columns == COLUMNS
    turns = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()
    assert {r[0]: tuple(r)[1:] for r in got.collect()} == damaged(map(tuple, turns))


def awkward():
    rnd = random.Random(5)
    roles = ["system", "user", "assistant", "tool", "", None, "u"]
    texts = ["Yes.", "no", "", None, " \t\n", "Stop!  \n", "Stop! ", "?", "same.", "same.", "ё" * 3000]
    rows = [(c, rnd.choice([None, *range(-2, 9)]), rnd.choice(roles), rnd.choice(texts)) for c in (1, 2, None) for _ in range(9)]
    rows += [(3, 0, "user", "x")] * 40 + [(4, None, None, None), (5, 10**15, "user", "a."), (5, -(10**15), "assistant", "b.")]
    rows += [(6, t, "user" if t % 2 else "assistant", f"word {t}.") for t in range(700)]
    return rows


@pytest.mark.parametrize("limit", [0, 3000, repair.LONG_BYTES])
def test_awkward_rows_and_long_conversations(spark, limit, monkeypatch):
    rows = awkward()
    docs = spark.createDataFrame([(*r, "c", "p") for r in rows], "conv_id bigint, turn bigint, role string, text string, conv string, part string").repartition(3)
    monkeypatch.setattr(repair, "LONG_BYTES", limit)
    monkeypatch.setattr(repair.repair, "__defaults__", (limit,))
    got = repair.report(docs).collect()
    want = damaged(rows)
    assert {r[0]: tuple(r)[1:] for r in got} == want and len(got) == len(want)
    made = {r["conv_id"]: r for r in repair.repair(docs, limit).collect()}
    assert all(LEGAL.fullmatch("".join(x["role"][0] for x in r["repaired"])) for r in made.values())
    assert repair.report(docs.limit(0)).collect() == []


def test_a_conversation_without_rows(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    turns = spark.createDataFrame([(gone, 0, "user", "Hello.")], "conv_id bigint, turn bigint, role string, text string")
    assert [tuple(r) for r in repair.report(turns).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
