from pyspark.sql import functions as F

from haulcube.llm import simhash as S

from .brute import components as brute_components
from .brute import fingerprint as brute_fp


def test_matches_brute_force(small_docs, odd_docs):
    for docs in (small_docs, odd_docs):
        rows = [(r.doc_id, brute_fp(r.text)) for r in docs.select("doc_id", "text").collect()]
        got = S.near_duplicates(docs).collect()
        assert sorted(map(tuple, got), key=str) == brute_components(rows)


def test_one_document_of_each_group_stays(small_docs, odd_docs):
    for docs in (small_docs, odd_docs):
        kept = S.drop_near_duplicates(docs)
        assert kept.columns == docs.columns
        ids = sorted((r.doc_id for r in kept.collect()), key=str)
        rows = [(r.doc_id, brute_fp(r.text)) for r in docs.select("doc_id", "text").collect()]
        numbered = brute_components([(k, f) for k, (_, f) in enumerate(rows)])  # the row number names the group
        groups = {}
        for k, _, c in numbered:
            groups.setdefault(c, []).append(rows[k][0])
        assert ids == sorted((min((i for i in g if i is not None), default=None) for g in groups.values()), key=str)


def test_empty(no_docs):
    assert S.drop_near_duplicates(no_docs).count() == 0
    assert S.near_duplicates(no_docs).count() == 0


def test_links_with_hot_buckets(spark):
    import random
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(300)}
    base = rnd.getrandbits(64)
    for _ in range(400):  # a dense group that shares most bits
        fps.add(base ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    for f in list(fps)[:80]:
        fps.add(f ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in sorted(fps)]
    for bits in (0, 1, 2):
        for bucket in (4, 64, 10_000):
            df = spark.createDataFrame([(x,) for x in signed], "fp long")
            edges = S.links(df, bits, bucket)
            comp = {r.node & (2**64 - 1): r.root for r in S.components(edges).collect()} if edges.take(1) else {}
            got = {}
            for f in fps:
                got.setdefault(comp.get(f, ("own", f)), set()).add(f)
            want = {}
            for i, (_, _, c) in enumerate(brute_components(list(enumerate(sorted(fps))), bits)):
                want.setdefault(c, set())
            rows = list(enumerate(sorted(fps)))
            for i, fp, c in brute_components(rows, bits):
                want[c].add(int(fp, 16))
            assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values())), (bits, bucket)


def test_chain_condition_never_rejects_a_link(spark):
    import itertools
    xs = [0] + [1 << i for i in range(64)] + [(1 << a) | (1 << b) for a, b in itertools.combinations(range(64), 2)]
    df = spark.createDataFrame([(x - (1 << 64) if x >> 63 else x,) for x in xs], "x long")
    for row in df.select(F.greatest(*(S._chains_hold(F.col("x"), 2, F.lit(i)).cast("int") for i in range(3))).alias("ok")).distinct().collect():
        assert row.ok == 1
