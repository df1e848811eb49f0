import re

from pyspark.sql import functions as F

from haulcube.llm import quality_rules as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    starts = {}
    for i in range(len(words) - 7):
        starts.setdefault(tuple(words[i:i + 8]), []).append(i)
    covered = {i + k for at in starts.values() if len(at) > 1 for i in at for k in range(8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def compare(docs):
    got = sorted(map(tuple, Q.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                                                 "base_failed").collect()), key=str)
    want = sorted(((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    assert got == want


def test_counts(small_docs, odd_docs):
    compare(small_docs)
    compare(odd_docs)


def test_empty(no_docs):
    assert Q.judge(no_docs).count() == 0 and Q.reject(no_docs).columns == no_docs.columns


def test_reject_keeps_columns_and_rows(odd_docs):
    kept = Q.reject(odd_docs)
    assert kept.columns == odd_docs.columns
    want = Q.judge(odd_docs.select("doc_id", "text", "source")).where("kept").count()
    assert kept.count() == want > 0


def test_bad_host_is_stricter(spark):
    good = " ".join(f"word{i}" for i in range(40))
    soft = " ".join(f"word{i}###" for i in range(40))
    rows = [(i, "one two", "bad") for i in range(200)] + [(1000, good, "bad"), (1001, soft, "bad")]
    rows += [(2000 + i, good + f" {i}x", "fine") for i in range(200)] + [(3000, soft, "fine")]
    rows += [(4000 + i, good, f"host{i}") for i in range(20)]
    out = {r.doc_id: r.kept for r in Q.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert out[1000] and not out[1001] and out[3000] and out[2000]


def test_prior_shrinks_small_hosts(spark):
    rows = [(True, False, "one")] + [(i % 10 == 0, False, f"h{i % 7}") for i in range(700)]
    m = spark.createDataFrame(rows, "base_failed boolean, soft_failed boolean, _host string")
    v = {r["_host"]: r for r in Q.host_verdicts(m).collect()}
    assert v["one"].fail_rate < 0.3 and not v["one"].host_bad
    assert abs(v["h0"].fail_rate - v["h0"].x / v["h0"].n) < 0.05


def test_no_python_on_the_path(small_docs):
    plan = Q.measure(small_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas")) and F
