import hashlib
import random
import re

from pyspark.sql import functions as F

from haulcube.llm import substring as S


def brute(rows, window=20):
    """Removed words by definition; rows that share an id don't cover each other."""
    rows = [(-(1 << 63) if i is None else i, i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    first = {}
    for key, _, w in rows:
        for p in range(len(w) - window + 1):
            x = tuple(w[p:p + window])
            first[x] = min(first.get(x, key), key)
    out = []
    for key, i, w in rows:
        gone, own = set(), set()
        for p in range(len(w) - window + 1):
            x = tuple(w[p:p + window])
            if first[x] < key or x in own:
                gone |= set(range(p, p + window))
            own.add(x)
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def check(docs, **kw):
    got = S.drop_repeats(docs, **kw).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("k")).collect()
    assert sorted(map(tuple, got), key=str) == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], **kw)


def test_given_and_odd_documents(small_docs, odd_docs):
    check(small_docs)
    check(odd_docs)


def test_branching_passages(spark):
    rnd = random.Random(3)
    passages = [[f"p{k}w{rnd.randrange(9)}" for _ in range(rnd.randrange(15, 60))] for k in range(12)]
    rows = []
    for i in range(120):
        words = []
        for _ in range(rnd.randrange(1, 7)):
            if rnd.random() < 0.7:
                p = rnd.choice(passages)
                a = rnd.randrange(len(p))
                words += p[a:a + rnd.randrange(60)] if rnd.random() < 0.5 else p
            words += [rnd.choice("ab") for _ in range(rnd.randrange(30))]
        rows.append((rnd.randrange(100), " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    check(docs)


def test_equal_keys_of_other_words_are_withdrawn(spark):
    """With one bit a word, keys collide: spans that differ at their source stay, true repeats go."""
    rnd = random.Random(5)
    fresh = lambda tag, n: [f"{tag}{i}" for i in range(n)]
    parity = {}
    for i in range(4000):
        parity.setdefault(S.xxhash.xxh64_intdigest(f"z{i}".encode()) & 1, []).append(f"z{i}")
    twin = [rnd.randrange(2) for _ in range(90)]
    one, two = ([rnd.choice(parity[b]) for b in twin] for _ in range(2))  # other words, all keys equal
    true = fresh("true", 70)
    rows = [(1, one), (2, two), (3, true + fresh("a", 5)), (4, fresh("b", 9) + true), (5, two[:40] + one[40:])]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_text) for r in S.drop_repeats(docs, hash_bits=1).collect()}
    held = brute([(i, " ".join(w)) for i, w in rows])
    assert {i: g[:2] for i, g in got.items() if i <= 3} == {i: (n, g) for i, n, g, _ in held if i <= 3}
    assert got[2][1] == 0 and got[2][2] == " ".join(two)
    for i, n, g, _ in held:  # never more than the truth
        assert got[i][0] == n and got[i][1] <= g
    check(docs)  # all 64 bits: the truth itself


def test_chunks_of_one_text_and_of_many(spark, small_docs, monkeypatch):
    monkeypatch.setattr(S, "_CHUNK", 50)
    check(small_docs.where("length(text) < 3000"))


def test_other_windows(small_docs):
    check(small_docs, window=9)


def test_empty(no_docs):
    assert S.drop_repeats(no_docs).count() == 0
