import zlib

from haulcube.llm import quality_model as M


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    out = {r.doc_id: r for r in M.classify(docs, labels).collect()}
    assert len(out) == docs.count()
    for i, r in out.items():
        assert r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    test = [(out[r.doc_id].score, r.quality) for r in labels.collect() if out[r.doc_id].held_out]
    assert sum((s >= 0.5) == q for s, q in test) / len(test) > 0.93
    good, bad = [s for s, q in test if q], [s for s, q in test if not q]
    auc = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / len(good) / len(bad)
    assert auc > 0.93, auc


def test_compiled_rules_equal_the_lasso_model(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    stats = M.statistics(docs)
    train = M.training_rows(stats, labels)
    assert not any(zlib.crc32(str(r.id).encode()) % 3 == 1 for r in train.collect())
    model = M.fit(train)
    import math
    for r, in train.sample(0.2, 1).select(M.F.struct("*", model.score().alias("score"))).collect():
        z = model.intercept + sum(w for rule, w in zip(model.rules, model.weights) if all(a < r[M.FEATURES[f]] <= b for f, a, b in rule))
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9


def test_odd_rows_and_missing_labels(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(i, i % 2 if i < 9 else None) for i in range(12)], "doc_id long, quality int")
    rows = M.classify(odd_docs, labels).collect()
    assert len(rows) == odd_docs.count() and all(0 <= r.score <= 1 for r in rows)
    assert M.classify(no_docs, labels).count() == 0
    none = labels.limit(0)
    assert {r.score for r in M.classify(odd_docs, none).collect()} == {0.5}
