"""Runs against a brute-force search."""
import hashlib
import zlib

import numpy as np
import pytest

from haulcube.llm import runs
from haulcube.llm.queries import QUERIES
from tests.conftest import SMALL


def brute_runs(words, e=4, least=6):
    n, out = len(words), {}
    for q in range(1, n // e + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j + q - i >= max(least, e * q):
                out.setdefault((i, j + q), q)
            i = j
    return sorted((a, b - a, q) for (a, b), q in out.items())


def collapsed(words, found):
    gone = {i for a, n, q in found for i in range(a + q, a + n)}
    return [w for i, w in enumerate(words) if i not in gone]


def test_extensions_equal_a_plain_comparison():
    rng = np.random.default_rng(1)
    for alphabet in (1, 2, 3, 50):
        for n in (2, 5, 40, 700):
            s = rng.integers(0, alphabet, n)
            s = np.concatenate([s, s[: n // 2], s])  # long equal stretches
            seq = np.concatenate(([alphabet], s, [alphabet + 1]))
            g = runs.Grammar(seq, 4)
            i, j = rng.integers(1, len(s) + 1, 300), rng.integers(1, len(s) + 1, 300)
            i, j = i[i != j], j[i != j]
            last = len(seq) - 1
            for a, b, got, behind in zip(i, j, g.extension(i, j), g.mirror().extension(last - i, last - j)):
                k = 0
                while seq[a + k] == seq[b + k]:
                    k += 1
                assert got == k
                k = 0
                while seq[a - k] == seq[b - k]:
                    k += 1
                assert behind == k


@pytest.mark.parametrize("e,least", [(4, 6), (2, 2), (3, 1)])
def test_runs_equal_brute_force(e, least):
    rng = np.random.default_rng(e)
    texts = [rng.integers(0, a, n) for a in (1, 2, 3, 9) for n in (0, 1, 5, 6, 7, 30, 120)]
    for p in (1, 2, 3, 7, 16):  # planted periods, nested periods, touching runs
        part = rng.integers(0, 3, p)
        texts.append(np.concatenate([rng.integers(0, 3, 11), np.resize(part, 5 * p + 3), np.resize(part[::-1], 6 * p)]))
    texts.append(np.resize(np.concatenate([np.zeros(7, int), [1, 2]]), 60))
    for found, t in zip(runs.batch_runs(texts, e, least), texts):
        assert [tuple(r) for r in found.tolist()] == brute_runs(t.tolist(), e, least)


def test_long_text_of_one_word():
    (found,) = runs.batch_runs([np.zeros(300_000, np.int64)], 4, 6)
    assert found.tolist() == [[0, 300_000, 1]]


def test_odd_rows(spark, odd_docs):
    out = runs.find_runs(odd_docs).collect()
    assert len(out) == odd_docs.count()
    by = {(r.doc_id, r.n_words): r for r in out}
    assert by[(10, 5000)].kept_text == "again" and [tuple(x) for x in by[(10, 5000)].runs] == [(0, 5000, 1)]
    assert by[(1, 0)].runs == [] and by[(1, 0)].kept_text == ""
    assert [tuple(x) for x in by[(8, 70)].runs] == [(0, 40, 1)]
    planted = runs.with_planted_repeats(odd_docs)
    assert planted.count() == len(out) and runs.digest(runs.find_runs(planted)).where("runs_sha256 is null or collapsed_sha256 is null").count() == 0


def test_empty_table_and_text_ids(spark, no_docs):
    assert runs.digest(runs.find_runs(runs.with_planted_repeats(no_docs))).count() == 0
    df = spark.createDataFrame([("https://a/b", "x y " * 4), (None, None)], "doc_id string, text string")
    got = {r.doc_id: r for r in runs.find_runs(runs.with_planted_repeats(df)).collect()}
    assert [tuple(x) for x in got["https://a/b"].runs] == [(0, 8, 2)] and got[None].n_words == 0


def test_query(spark, small_docs):
    want = {}
    for r in small_docs.collect():
        words = [w.decode() for w in (r.text or "").encode().split()]
        h, n = zlib.crc32(str(r.doc_id).encode()), len(words)
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
        found = brute_runs(words)
        best = max(found, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        want[r.doc_id] = (len(found), *best, best[1] and 1000 * best[1] // best[2],
                          hashlib.sha256("".join("%d,%d,%d\n" % x for x in found).encode()).hexdigest(),
                          hashlib.sha256(" ".join(collapsed(words, found)).encode()).hexdigest())
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op11_periodic_runs"](spark, SMALL).collect()}
    assert got == want and sum(x[0] for x in want.values()) > 10
