from haulcube.llm import decontaminate as D

from .brute import contaminated as brute


def check(docs, items):
    got = sorted(map(tuple, D.leaks(docs, items).collect()))
    want = brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want
    return got


def test_given_tables(spark, small_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = check(small_docs, items)
    kept = D.drop_contaminated(small_docs, items)
    assert got and kept.count() == small_docs.count() - len({g[0] for g in got}) and kept.columns == small_docs.columns


def test_partial_passages_and_odd_rows(spark, odd_docs):
    long = [f"w{i}x" for i in range(400)]
    items = [(1, " ".join(long[60:90])), (2, " ".join(long[60:85] + [f"q{i}" for i in range(5)])), (3, " ".join(long[60:80] + [f"q{i}" for i in range(10)])),
             (4, "one"), (5, None), (6, " \n "), (7, "W5X w6x W7x"), (8, " ".join(long)), (8, " ".join(long)), (9, " ".join(["again"] * 9))]
    got = check(odd_docs, spark.createDataFrame(items, "item_id long, text string"))
    assert {(5, 1), (5, 8), (4, 4), (5, 7), (10, 9)} <= {g[:2] for g in got} and not any(g[1] == 3 for g in got)


def test_empty(spark, no_docs, small_docs):
    items = spark.createDataFrame([], "item_id long, text string")
    assert D.leaks(small_docs, items).count() == 0 and D.drop_contaminated(small_docs, items).count() == small_docs.count()
    some = spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string")
    assert D.leaks(no_docs, some).count() == 0


def test_no_python_on_the_path(spark, small_docs):
    items = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    plan = D.leaks(small_docs, items)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_null_ids_are_judged_by_text(spark):
    item = " ".join(f"k{i}" for i in range(12))
    docs = spark.createDataFrame([(None, "x " + item), (None, "y " + item), (None, "clean text of several words"), (1, item), (2, None), (None, None)], "doc_id long, text string")
    docs = docs.unionByName(docs.where("text like 'x%'"))
    items = spark.createDataFrame([(None, item), (None, "other item that nobody holds at all"), (7, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.leaks(docs, items).collect()), key=str)
    assert got == sorted([(None, None), (None, 7)] * 2 + [(1, None), (1, 7)], key=str)
    assert sorted((r.text or "" for r in D.drop_contaminated(docs, items).collect())) == ["", "", "clean text of several words"]
    named = spark.createDataFrame([("urn:1", item), ("urn:2", "clean")], "doc_id string, text string")
    assert [(r.doc_id, r.item_id) for r in D.leaks(named, items.where("item_id = 7")).collect()] == [("urn:1", 7)]
