import corpus_pipeline as C
from haulcube.llm import quality_rules

from .brute import components, contaminated, fingerprint, line_dedup, verify_packing

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    stage = {name: f for name, f in C.STAGES}
    assert list(stage) == ["quality_rules", "line_dedup", "simhash_near_dedup", "decontamination", "packing"]

    first = C.written(stage["quality_rules"](spark, docs, SF), "t")
    kept = {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
    assert rows(first) == rows(docs.where(docs.doc_id.isin(kept))) and first.columns == columns

    second = C.written(stage["line_dedup"](spark, first, SF), "t")
    want = {i: t for i, t, _, _ in line_dedup([(r.doc_id, r.text) for r in first.collect()])}
    assert second.columns == columns
    assert {r.doc_id: (r.text, r.n_chars) for r in second.collect()} == {i: (t, len(t)) for i, t in want.items()}

    third = C.written(stage["simhash_near_dedup"](spark, second, SF), "t")
    groups = components([(r.doc_id, fingerprint(r.text)) for r in second.collect()])
    keep = {i for i, _, c in groups if i == c}
    assert rows(third) == rows(second.where(second.doc_id.isin(keep))) and third.columns == columns

    fourth = C.written(stage["decontamination"](spark, third, SF), "t")
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {i for i, *_ in contaminated([(r.doc_id, r.text) for r in third.collect()], items)}
    assert rows(fourth) == rows(third.where(~third.doc_id.isin(bad))) and fourth.columns == columns

    verify_packing(fourth, stage["packing"](spark, fourth, SF).collect(), 2048)


def test_run_returns_the_last_stage(spark):
    out = C.run(spark, SF)
    assert out.count() > 0 and {"doc_id", "start", "ids", "sequence_id", "offset"} <= set(out.columns)


def test_odd_rows_pass_every_stage(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for _, f in C.STAGES[:-1]:
            out = C.written(f(spark, docs, SF), "t")
            assert out.columns == docs.columns
            docs = out
        assert C.STAGES[-1][1](spark, docs, SF).count() >= 0
