from collections import Counter

import numpy as np
import pytest

from haulcube.llm import packing as P

from .brute import TOKENIZER as PATH
from .brute import verify_packing


def verify(docs, **kw):
    return verify_packing(docs, P.pack(docs, PATH, **kw).collect(), kw.get("length", P.LENGTH))


def test_every_id_once(small_docs, odd_docs):
    verify(small_docs.repartition(3))
    verify(odd_docs, length=64, window=256)


def test_special_strings_and_scripts(spark):
    rows = [(1, "A<|endoftext|>b don't ΑΣ café été  x y 12ab!!"), (2, "<|startoftext|> \x1c ok"), (3, "")]
    verify(spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string"), length=16, window=32)


def test_encoder_equals_the_library(small_docs):
    from tokenizers import Tokenizer
    tok, enc = Tokenizer.from_file(PATH), P.Encoder(PATH)
    assert enc.separate
    texts = [r.text for r in small_docs.collect()] + [
        "<|endoftext|> a<|startoftext|>b", "don't can't I'll we've x's 'S 'T", "WORD. word, word! wor;d a:b ?a a? 12. 3a, É. é, e\u0301. \u00a0x\u2003y z",
        "\u0130stanbul \u1e9e \u03a3. \u0391\u03a3, \ufb01. \U0001F600! \x00 \x1c\x1f a\x85b", "", " \n", "<", "a<b", "|>"]
    assert [list(np.frombuffer(x, "<u4")) for x in enc.encode_batch([t.encode() for t in texts])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


def test_windows_hold_the_mixture(spark):
    rows = [(i, " ".join(f"word{i}" for _ in range(50 + i % 37)), ("big", "big", "big", "small", None)[i % 5]) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    source = {i: s for i, _, s in rows}
    out = P.pack(docs, PATH, length=512, window=4096).collect()
    total = Counter()
    for r in out:
        total[source[r.doc_id]] += r.length
    n = sum(total.values())
    rounds = -(-n // 4096)
    for w in range(rounds):
        here = Counter()
        for r in out:
            if (r.sequence_id * 512 + r.offset + r.length / 2) * rounds // n == w:
                here[source[r.doc_id]] += r.length
        for s, t in total.items():
            assert abs(here[s] - t / rounds) < 8


def test_targets_and_shared_queues(spark):
    rows = [(i, f"text number {i} of many", f"s{i % 40}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    verify(docs, length=64, window=128, targets={"s1": 10.0, "s2": 1.0})
    verify(docs, length=64, window=128)


@pytest.mark.parametrize("rounds", [1, 7, 64])
def test_schedule_is_deficit_round_robin(rounds):
    sizes = [5, 1000, 333, 1]
    plan = P.Schedule(sizes, sizes, rounds)
    deficit, served = np.zeros(4, int), np.zeros(4, int)
    for w in range(rounds):
        assert list(plan.served(w)) == list(served)
        deficit += np.array(sizes)  # in 1/rounds of a token
        give = deficit // rounds
        deficit -= give * rounds
        served = served + give
    assert list(served) == sizes


def test_empty(no_docs):
    assert P.pack(no_docs, PATH).count() == 0


def test_many_sources_keep_their_queues(spark):
    n = 4200  # of them 4,199 small ones
    rows = [(i, " ".join(["word"] * (1 + i % 3)), f"s{i}") for i in range(1, n)] + [(n + i, " ".join(["word"] * 50), "big") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)
    source = {i: s for i, _, s in rows}
    for targets, window in ((None, 4096), ({"big": 1.0, "s7": 3.0}, 512)):
        out = P.pack(docs, PATH, length=256, window=window, targets=targets).collect()
        sizes = Counter()
        for r in out:
            sizes["=" + source[r.doc_id]] += r.length
        queues, total = sorted(sizes), sum(sizes.values())
        rounds = -(-total // window)
        shares = [sizes[q] for q in queues]
        if targets:
            weight = [max(targets.get(q[1:], 0.0), 1e-6) for q in queues]
            shares = [max(1, round(x / sum(weight) * window * rounds)) for x in weight]
        plan = P.Schedule([sizes[q] for q in queues], shares, rounds)
        want, w = [], 0  # the queue of each token of the first windows
        while len(want) < 4 * window and w < rounds:
            before, after, _ = plan.window(w)
            for q in np.flatnonzero(after > before):
                want += [queues[q]] * int(after[q] - before[q])
            w += 1
        got = [None] * total
        for r in out:
            a = r.sequence_id * 256 + r.offset
            got[a:a + r.length] = ["=" + source[r.doc_id]] * r.length
        assert None not in got and got[:len(want)] == want
