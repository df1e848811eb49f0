import hashlib
import re

from haulcube.llm import secrets as S
from haulcube.session import scratch_dir

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def brute(text):
    """Base spans by definition."""
    text = text or ""
    out = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), 1, "access", m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, "hex", m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    out.sort()
    joined = ",".join(f"{k}:{a}:{b}" for a, _, k, b in out)
    n = [sum(k == x for _, _, k, _ in out) for x in S.BASE]
    return (*n, hashlib.sha256(joined.encode()).hexdigest(), joined)


def check(docs):
    rows = S.digest(S.find_secrets(docs)).collect()
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256,
                   ",".join(x for x in r.spans.split(",") if x.split(":")[0] in S.BASE)) for r in rows), key=str)
    assert got == sorted(((r.doc_id, *brute(r.text)) for r in docs.select("doc_id", "text").collect()), key=str)
    return rows


def test_given_and_odd_documents(small_docs, odd_docs):
    check(small_docs)
    check(odd_docs)


def test_edge_cases(spark):
    texts = ["\U0001F600 password = 'abcdef' tail", "token:token\"=\"abcdefgh", "secret:token=abcdefgh", "API_KEY=\"x.y_z/1\" apikey : 12345",
             "AKIA" + "A" * 15 + " AKIA" + "9" * 16 + "xAKIAAKIA" + "Z" * 14, "0" * 23 + "g" + "a" * 24 + "G" + "f" * 50, "password==abc=def token",
             "é" * 5 + "deadbeef" * 3 + "password: " + "deadbeef" * 4, "token:\ntoken: abcdef", "ghp_" + "Z9" * 20, "passwd=abc passwd=abcdef",
             "-----BEGIN RSA PRIVATE KEY----- eyJ" + "a" * 12 + ".eyJ" + "b" * 12 + "." + "c" * 12 + " xoxb-1234567890-abc"]
    rows = check(spark.createDataFrame(list(enumerate(texts)) + [(99, texts[0]), (99, texts[0])], "doc_id long, text string"))
    spans = {r.doc_id: r.spans for r in rows}
    assert spans[9] == "github:0:44" and [x.split(":")[0] for x in spans[11].split(",")] == ["private_key", "jwt", "slack"]


def test_ledger_scans_only_unseen_pairs(spark):
    path = scratch_dir(spark, "test-ledger")
    first = spark.createDataFrame([(1, "password=abcdef"), (2, "password=abcdef"), (3, "clean")], "doc_id long, text string")
    more = spark.createDataFrame([(4, "password=abcdef"), (5, "token=zzzzzzzz")], "doc_id long, text string")
    assert [len(r.spans) for r in sorted(S.find_secrets(first, ledger_path=path).collect())] == [1, 1, 0]
    assert spark.read.parquet(path).count() == 2
    assert [len(r.spans) for r in sorted(S.find_secrets(more, ledger_path=path).collect())] == [1, 1]
    assert spark.read.parquet(path).count() == 3
    S.find_secrets(more, ledger_path=path, rule_version="2").collect()
    assert spark.read.parquet(path).where("rule_version = '2'").count() == 2


def test_empty(no_docs):
    assert S.find_secrets(no_docs).count() == 0


def test_text_ids_and_repeated_ledger_pairs(spark):
    path = scratch_dir(spark, "test-ledger")
    df = spark.createDataFrame([("a/b.py", "password=abcdef"), ("https://x", "password=abcdef"), (None, "password=abcdef"), ("", "clean")], "doc_id string, text string")
    for _ in range(2):
        got = S.find_secrets(df, ledger_path=path).collect()
        assert sorted(((r.doc_id or "-", len(r.spans)) for r in got)) == [("-", 0), ("-", 1), ("a/b.py", 1), ("https://x", 1)]
        spark.read.parquet(path).write.mode("append").parquet(path + "-twice")
        spark.read.parquet(path + "-twice").write.mode("append").parquet(path)
    assert spark.read.parquet(path).count() > 2


def test_no_python_on_the_path(small_docs):
    plan = S.find_secrets(small_docs)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
