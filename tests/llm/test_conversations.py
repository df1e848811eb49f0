"""Conversation repair against a search over whole edit scripts and a plain fault count."""
import hashlib
import heapq
import itertools
import re
import zlib

import pytest

from haulcube.llm import conversations as c
from haulcube.llm.queries import QUERIES
from tests.conftest import SMALL

SPACE = " \t\n\x0b\f\r"


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        t = text.rstrip(SPACE)
        if not t.lstrip(SPACE):
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append(None if t[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def brute_repair(rows, found):
    """Least (cost, audit) by uniform-cost search over scripts; the grammar is checked on the roles at the end."""
    heap, done = [(0, "", 0, ())], set()
    while heap:
        cost, audit, i, kept = heapq.heappop(heap)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or " " for r, _ in kept)):
            return cost, audit, "\n".join(f"{r}:{t}" for r, t in kept)
        state = (i, len(kept) % 2, (kept[-1][0][:1] or " ") if kept else "", bool(re.fullmatch("(s?(ua)*u?)?", "".join(r[:1] or " " for r, _ in kept))))
        if not state[3] or state in done:
            continue
        done.add(state)
        for r in ("user", "assistant"):
            heapq.heappush(heap, (cost + 2, audit + "I", i, kept + ((r, ""),)))
        if i < len(rows):
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, kept))
            if found[i] not in ("blank", "duplicate"):
                more = int(found[i] == "truncated")
                heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept + (rows[i],)))
                for r in ("user", "assistant"):
                    heapq.heappush(heap, (cost + more + 2, audit + "R", i + 1, kept + ((r, rows[i][1]),)))


def expected(rows):
    """rows: (turn, role, text) in order."""
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [(r, x) for _, r, x in rows]
    found = faults(pairs)
    initials = [r[:1] or " " for r, _ in pairs]
    cost, audit, text = brute_repair(pairs, found)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(found.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def damaged(rows):
    """{conv: rows} of (conv, turn, role, text) after the planted damage."""
    out = {}
    for conv, turn, role, text in rows:
        held = out.setdefault(conv, [])
        show = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        m, role, text = zlib.crc32(f"{show[0]}:{show[1]}".encode()) % 20, show[2], show[3]
        if m == 0:
            continue
        text = "" if m == 1 else re.sub("[.!?]", "", text) if m == 2 else text
        held += [(turn, "user" if m == 4 else role, text)] * (2 if m == 3 else 1)
    for held in out.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    return out


def test_automaton_equals_search(spark):
    letters = {"s": ("system", "x."), "u": ("user", "x."), "a": ("assistant", "x."), "o": ("tool", "x."), "U": ("user", "x"), "A": ("assistant", "x"),
               "x": ("user", "")}
    sigs = ["".join(x) for n in range(5) for x in itertools.product("suaoUx", repeat=n)] + ["".join(x) for x in itertools.product("suAx", repeat=6)]
    df = spark.createDataFrame([(s,) for s in sigs], "signature string")
    got = {r.signature: r for r in c.repairs(df).collect()}
    assert len(got) == len(sigs)
    for s in sigs:
        rows = [(letters[x][0], f"{i}{letters[x][1]}" if x != "x" else "") for i, x in enumerate(s)]
        found = ["blank" if x == "x" else "truncated" if x.isupper() else None for x in s]
        cost, audit, text = brute_repair(rows, found)
        mine = "\n".join(f"{r.role or rows[r.row][0]}:{rows[r.row][1] if r.row is not None else ''}" for r in got[s].repaired)
        assert (got[s].cost, got[s].audit, mine) == (cost, audit, text), s


def test_long_conversation(spark):
    n = 60_000
    df = spark.createDataFrame([("ua" * n,), ("s" + "ua" * n,), ("u" * n,)], "signature string")
    got = {r.signature[:2]: r for r in c.repairs(df).select("signature", "cost", F_left("audit")).collect()}
    assert got["ua"].cost == 0 and got["su"].cost == 0 and got["uu"].cost > 0


def F_left(col):
    from pyspark.sql import functions as F
    return F.left(col, F.lit(5)).alias("audit")


ODD = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (1, 1, "assistant", "Yes."), (1, None, None, None), (2, None, None, "x"), (2, None, "tool", " \n"),
       (None, 3, "user", "no end"), (None, 9, "assistant", "Done! \n"), (3, 5, "", "A."), (3, 7, "ubuntu", "B."), (3, 8, "System", "C?"), (4, 1, "system", "S."),
       (4, 2, "system", "T."), (4, 4, "user", "é\U0001F600"), (5, 2, "user", "y" * 100_000 + "."), (5, 2, "user", "y" * 100_000 + ".")]


def test_odd_rows(spark):
    df = spark.createDataFrame(ODD, "conv_id long, turn long, role string, text string").selectExpr("*", "1 as kept", "2 as rows", "3 as m", "4 as signature")
    got = {r[0]: tuple(r)[1:] for r in c.digest(c.repair(df.select("conv_id", "turn", "role", "text", "rows", "m", "signature"))).collect()}
    want = {}
    for conv, turn, role, text in ODD:
        want.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for held in want.values():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    assert got == {k: expected(v) for k, v in want.items()}
    got = {r[0]: tuple(r)[1:] for r in c.digest(c.repair(c.with_planted_faults(df), kept_col="kept")).collect()}
    assert got == {k: expected(v) for k, v in damaged(ODD).items()}


def test_empty_table_and_text_ids(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert c.digest(c.repair(c.with_planted_faults(none), kept_col="kept")).count() == 0
    df = spark.createDataFrame([("urn:a", 1, "user", "Q?"), ("urn:a", 2, "assistant", "A.")], "conv_id string, turn int, role string, text string")
    (row,) = c.digest(c.repair(df)).collect()
    assert row.conv_id == "urn:a" and row.cost == 0 and row.audit == "KK"


def test_all_rows_dropped(spark):
    conv, turn = next((a, b) for a in range(100) for b in range(9) if zlib.crc32(f"{a}:{b}".encode()) % 20 == 0)
    df = spark.createDataFrame([(conv, turn, "user", "Q?")], "conv_id long, turn long, role string, text string")
    (row,) = c.digest(c.repair(c.with_planted_faults(df), kept_col="kept")).collect()
    assert tuple(row) == (conv, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


@pytest.mark.parametrize("sf_dir", [SMALL, "/root/testdata/sf0.01"])
def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op12_conversation_repair"](spark, sf_dir).collect()}
    assert got == {k: expected(v) for k, v in damaged(rows).items()}
