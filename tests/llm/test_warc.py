import gzip
import hashlib
import os
import random
import zlib

import pytest

from haulcube.llm import warc as W
from haulcube.session import scratch_dir


def roundtrip(spark, pages, **kw):
    folder = scratch_dir(spark, "warc-test")
    manifest = W.write_archives(pages, folder, **kw)
    rows = W.read_archives(spark, folder, manifest).collect() if manifest.count() else []
    assert not [r for r in rows if r.kind == "gap"]
    return folder, rows


def brute(rows, least=1000):
    best = {}
    for i, _, p in rows:
        p = (p or "").encode()
        if len(p) >= least and i is not None:
            best[p] = max(best.get(p, i), i)
    out = []
    for i, _, p in rows:
        p = (p or "").encode()
        to = best.get(p) if len(p) >= least and best.get(p) != i and i is not None else None
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def ident(name):
    x = name.removeprefix("urn:page:")
    return None if x == "None" else int(x)


def test_round_trip(spark):
    big, other = "é" * 600, "x" * 1000
    rows = [(1, "http://a/", big), (2, None, big), (3, "http://c/ d\n", big), (4, "u", "x" * 999), (5, "u", "x" * 999), (6, "u", None), (7, "u", ""),
            (8, "u", other), (9, "u", other), (9, "u", other), (None, "u", other), (10, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 80)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as largest", "'z' as payload")
    _, got = roundtrip(spark, pages.repartition(3), file_bytes=2000)
    # a null id takes part in no revisit
    assert sorted(((ident(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and ident(r.refers_to)) for r in got), key=str) == brute(rows)
    payloads = {ident(r.record_id): bytes(r.payload) for r in got if r.record_type == "response"}
    assert payloads[3] == big.encode() and payloads[6] == b"" and payloads[10].decode() == rows[-1][2]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    _, got = roundtrip(spark, pages)
    want = brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert sorted(((ident(r.record_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to and ident(r.refers_to)) for r in got), key=str) == want


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert roundtrip(spark, pages)[1] == []


def test_stale_files_of_other_attempts_are_left_out(spark):
    pages = spark.createDataFrame([(1, "u", "text")], "page_id long, url string, html string")
    folder, _ = roundtrip(spark, pages)
    local = folder.replace("file:", "")
    name = next(n for n in os.listdir(local) if n.endswith(".gz"))
    with open(f"{local}/{name}", "rb") as f, open(f"{local}/warc-000000-00000-999.warc.gz", "wb") as g:
        g.write(f.read())
    manifest = spark.createDataFrame([(name,)], "file string")
    assert W.read_archives(spark, folder, manifest).count() == 1 and W.read_archives(spark, folder).count() == 2


def events(data):
    out = list(W.salvage(data))
    at = 0
    for kind, a, b, _ in out:  # every byte belongs to a record or a gap
        assert a <= at <= b
        at = max(at, b)
    assert at == len(data)
    return [x[3]["record_id"][9:] for x in out if x[0] == "record"], [x[1:] for x in out if x[0] == "gap"]


def test_salvage_recovers_later_records():
    members = [W.member(W.record(i, f"http://x/{i}", os.urandom(300) + b"text" * 200, None)) for i in range(8)]
    ends = [sum(map(len, members[:i + 1])) for i in range(8)]
    data = b"".join(members)
    assert events(data) == ([str(i) for i in range(8)], [])
    broken = bytearray(data)
    broken[ends[2] + 200] ^= 0xFF  # inside member 3
    got, gaps = events(bytes(broken))
    assert got == ["0", "1", "2", "4", "5", "6", "7"] and gaps[0][:2] == (ends[2], ends[3])
    got, gaps = events(data[:ends[6] + 50])  # cut in member 7
    assert got == [str(i) for i in range(7)] and gaps == [(ends[6], ends[6] + 50, "member is cut")]
    got, gaps = events(data[:ends[0]] + b"\x1f\x8b\x08junk" * 5 + data[ends[0]:])
    assert got == [str(i) for i in range(8)] and gaps[0][:2] == (ends[0], ends[0] + 35)


def test_salvage_of_plain_records_and_bad_digests():
    recs = [W.record(i, None, b"payload %d" % i * 30, None) for i in range(4)]
    bad = recs[1].replace(b"payload 1pay", b"payload 2pay", 1)
    got, gaps = events(recs[0] + bad + recs[2] + b"noise" + recs[3])
    assert got == ["0", "2", "3"] and [g[2] for g in gaps] == ["block digest differs", "no version line"]
    got, gaps = events(gzip.compress(recs[0] + bad + recs[2]) + recs[3])
    assert got == ["0", "2", "3"] and len(gaps) == 1
    rnd = random.Random(1)
    data = b"".join(map(W.member, recs))
    for _ in range(200):  # damage anywhere never stops the reader
        x = bytearray(data)
        for _ in range(3):
            x[rnd.randrange(len(x))] = rnd.randrange(256)
        events(bytes(x))


def test_long_urls_are_read_back(spark):
    rows = [(1, " " * 200_000, "x" * 1000), (2, "u" * 200_000, "x" * 1000), (3, "http://c/", "x" * 1000)]
    folder = scratch_dir(spark, "warc-test")
    manifest = W.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = {ident(r.record_id): r for r in W.read_archives(spark, folder, manifest, whole=True).collect()}
    assert {i: (r.kind, r.target_uri, r.record_type) for i, r in got.items()} == {
        1: ("record", "%20" * 200_000, "revisit"), 2: ("record", "u" * 200_000, "revisit"), 3: ("record", "http://c/", "response")}


def test_whole_archives_hold_what_the_manifest_says(spark):
    pages = spark.createDataFrame([(i, "u", f"text {i}") for i in range(5)], "page_id long, url string, html string")
    folder, _ = roundtrip(spark, pages.coalesce(1))
    name = next(n for n in os.listdir(folder.replace("file:", "")) if n.endswith(".gz"))
    for n, wanted in [(name, 6), ("warc-missing.warc.gz", 5)]:
        with pytest.raises(Exception, match="5 records read, 6 written|are missing"):
            W.read_archives(spark, folder, spark.createDataFrame([(n, wanted)], "file string, records long"), whole=True).collect()


def test_salvage_keeps_the_records_before_a_fault():
    recs = [W.record(i, f"http://x/{i}", random.Random(i).randbytes(30) + b"text" * 50, None) for i in range(200)]
    data, ids = gzip.compress(b"".join(recs)), [str(i) for i in range(200)]
    wrong = bytearray(data)
    wrong[-8] ^= 1  # the checksum: every record is whole
    got, gaps = events(bytes(wrong) + W.member(recs[0]))
    assert got == [*ids, "0"] and [g[:2] for g in gaps] == [(0, len(data))]
    z, most = zlib.decompressobj(31), bytearray(data)
    most[len(data) // 2:] = b"\xff" * (len(data) - len(data) // 2)
    readable = len(z.decompress(data[:len(data) // 2]))  # a fault right after these bytes
    got, gaps = events(bytes(most))
    whole = sum(sum(map(len, recs[:i + 1])) <= readable for i in range(200))
    assert got[:whole] == ids[:whole] and whole > 50 and len(gaps) == 1
