import random

from haulcube.llm import line_dedup as L

from .brute import line_dedup as brute


def check(docs, **kw):
    got = sorted(((r._row.doc_id, r.new_text, r.n_lines, r.n_removed) for r in L.dedup_lines(docs, **kw).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], **kw)
    return got


def test_odd_documents(odd_docs):
    check(odd_docs)
    kept = L.without_repeated_lines(odd_docs)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()
    assert all(r.n_chars == len(r.text) for r in kept.collect() if r.text is not None)


def test_edits(spark):
    rnd = random.Random(11)
    base = [[f"w{rnd.randrange(40)}" for _ in range(rnd.choice([1, 3, 4, 5, 6, 7, 8, 9, 12, 30]))] for _ in range(25)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(rnd.randrange(6)):
            w = list(rnd.choice(base))
            for _ in range(rnd.choice([0, 0, 1, 1, 2])):
                p = rnd.randrange(len(w) + 1)
                kind = rnd.randrange(3)
                w = w[:p] + (["new"] if kind < 2 else []) + w[p + (kind > 0):]
            text.append("  ".join(w))
        rows.append((rnd.randrange(45), "\n".join(text)))
    got = check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert sum(g for *_, g in got) > 20


def test_border_of_short_lines(spark):
    """Lines one word above and below the floor, across documents and inside one; two edits stay."""
    for floor in (5, 8):
        rows = []
        for n in (floor - 1, floor, floor + 1):
            line = [f"n{n}w{i}" for i in range(n)]
            edits = [line, line[:2] + ["x"] + line[3:], line[:-1], ["y"] + line, line[:1] + ["p"] + line[2:3] + ["q"] + line[4:]]
            rows += [(10 * n + k, " ".join(w)) for k, w in enumerate(edits)]
            rows.append((10 * n + 9, "\n".join("in " + " ".join(w) for w in edits)))
        check(spark.createDataFrame(rows, "doc_id long, text string"), min_words=floor)
    kept = [("a b c d 2020", 5), ("a b c 2020", 4)]
    for line, n in kept:
        docs = spark.createDataFrame([(1, line), (2, line.replace("2020", "2021"))], "doc_id long, text string")
        assert sorted(r.n_removed for r in L.dedup_lines(docs).collect()) == [0, int(n >= 5)]


def test_two_edits_stay_apart():
    a = "a b c d e f g h i j".split()
    assert L.within_one_edit(a, a[:3] + a[4:]) and L.within_one_edit(a, a[:3] + ["x"] + a[4:]) and L.within_one_edit(a, a + ["x"])
    assert not L.within_one_edit(a, a[1:] + ["x"]) and not L.within_one_edit(a, a[:3] + a[4:7] + a[8:])


def test_empty(no_docs):
    assert L.dedup_lines(no_docs).count() == 0 and L.without_repeated_lines(no_docs).columns == no_docs.columns
