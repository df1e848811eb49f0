"""WARC writer with payload de-duplication and a salvage reader (operator 4).

`write_archives` writes one record per page, each in a gzip member of its own, into files of about
`file_bytes` under a shared folder (any file system pyarrow can open).  Of pages with equal payloads of at
least `min_dedup` bytes the one with the largest id is a response and the others revisit it.  Every task
attempt writes files of its own and returns their names; only the names of committed attempts reach the
manifest, so lost executors and repeated tasks leave no duplicate records.

`read_archives` lists nothing on the driver: the files of the folder are read whole (their size is bounded
by the writer), kept if the manifest names them, and parsed.  A record is checked by its gzip checksum,
version line, Content-Length and SHA-1 digests; after a failed check the reader searches for the next
valid gzip member or version line, recovers the records after it and logs the bytes in between as a
quarantined gap.  With `whole` the reader raises instead if a file of the manifest is missing, has a gap or
holds another number of records than the manifest says.

Defined results: a null payload is empty; a null url writes no target header; rows that share the largest
id of their payload are all responses; null ids take part in no revisit; ids must be integers; empty tables give empty archives.
"""
from __future__ import annotations

import base64
import hashlib
import io
import re
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_side, written

DATE = "2000-01-01T00:00:00Z"
FILE_BYTES = 8 << 20
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
_MEMBER = b"\x1f\x8b\x08"


def _sha1(data: bytes) -> bytes:
    return b"sha1:" + base64.b32encode(hashlib.sha1(data).digest())


def record(page_id, url: str | None, payload: bytes, refers_to, digest: bytes | None = None) -> bytes:
    """One WARC record: a response, or a revisit of another page's payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [b"WARC/1.1", b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"), b"WARC-Record-ID: <urn:page:%s>" % str(page_id).encode(),
            b"WARC-Date: " + DATE.encode(), b"Content-Type: application/http; msgtype=response",
            b"WARC-Payload-Digest: " + _sha1(payload), b"WARC-Block-Digest: " + _sha1(block)]
    if url is not None:
        head.append(b"WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url).encode())
    if refers_to is not None:
        head += [b"WARC-Refers-To: <urn:page:%d>" % refers_to,
                 b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(b"Content-Length: %d" % len(block))
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes, level: int = 5) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def qualified(spark, folder: str) -> str:
    """The folder with the scheme of the file system that Spark resolves it to, so that tasks write where Spark reads."""
    folder = folder.rstrip("/")
    if "://" in folder or folder.startswith("file:"):
        return folder
    mark = f"{folder}/_scheme"
    spark.range(1).coalesce(1).write.mode("overwrite").parquet(mark)
    return spark.read.parquet(mark).inputFiles()[0].rsplit("/_scheme/", 1)[0]


def _open_out(path: str):
    from pyarrow import fs
    store, name = fs.FileSystem.from_uri(re.sub("^file:/+", "file:///", path))
    store.create_dir(name.rsplit("/", 1)[0], recursive=True)
    return store.open_output_stream(name, compression=None)


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                   min_dedup: int = 1000, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the archives; returns the manifest (file, records, bytes), a written table."""
    payload = F.encode(F.coalesce(F.col(payload_col), F.lit("")), "UTF-8")
    src = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), payload.alias("payload"))
    digest = F.when(F.octet_length("payload") >= min_dedup, F.sha1("payload"))
    groups = (src.select("id", digest.alias("digest")).where("digest is not null").groupBy("digest")
              .agg(F.max("id").alias("largest"), F.count("*").alias("n")).where("n > 1").select("digest", "largest"))
    groups = small_side(written(groups, "warc-groups"))
    refers = F.when(F.col("largest") != F.col("id"), F.col("largest"))
    src = src.withColumn("digest", digest).join(groups, "digest", "left").select("id", "url", "payload", refers.alias("refers_to"))
    folder = qualified(pages.sparkSession, folder)

    def run(batches):
        from pyspark import TaskContext
        task = TaskContext.get()
        held, n, number, done = io.BytesIO(), 0, 0, []

        def flush():
            name = f"warc-{task.partitionId():06d}-{number:05d}-{task.taskAttemptId()}.warc.gz"
            with _open_out(f"{folder}/{name}") as f:
                f.write(held.getvalue())
            done.append((name, n, held.tell()))
        for batch in batches:
            for i, url, data, to in zip(*batch.columns):
                held.write(member(record(i.as_py(), url.as_py(), data.as_buffer().to_pybytes(), to.as_py())))
                n += 1
                if held.tell() >= file_bytes:
                    flush()
                    held, n, number = io.BytesIO(), 0, number + 1
        if n:
            flush()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], names=["file", "records", "bytes"])
    return written(src.mapInArrow(run, "file string, records long, bytes long"), "warc-manifest")


class Damaged(Exception):
    """A failed check and the place where it was noticed."""


def parse(data, at: int):
    """(end, record dict) of the record that starts at `at` in uncompressed bytes; raises Damaged."""
    if not _VERSION.match(data, at):
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", at)  # a url, so a header, has no size limit
    if stop < 0:
        raise Damaged("unterminated header")
    head = {}
    for line in data[at:stop].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("bad header line")
        head[name.strip().lower()] = value.strip()
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        raise Damaged("bad content length")
    start, end = stop + 4, stop + 4 + int(size)
    if data[end:end + 4] != b"\r\n\r\n":
        raise Damaged("block is cut or has a wrong length")
    block = data[start:end]
    if b"warc-block-digest" in head and head[b"warc-block-digest"] != _sha1(block):
        raise Damaged("block digest differs")
    kind = head.get(b"warc-type", b"").decode("latin-1")
    http, gap, payload = block.partition(b"\r\n\r\n") if kind in ("response", "revisit") else (b"", b"", block)
    declared = head.get(b"warc-payload-digest", b"")
    if kind == "response" and declared and declared != _sha1(payload):
        raise Damaged("payload digest differs")
    length = re.search(rb"(?im)^content-length:\s*(\d+)", http) if kind == "revisit" else None
    name = head.get(b"warc-record-id", b"").decode("utf-8", "replace").strip("<>")
    to = head.get(b"warc-refers-to", b"").decode("utf-8", "replace").strip("<>")
    try:
        sha = base64.b32decode(declared[5:]).hex() if declared.startswith(b"sha1:") else hashlib.sha1(payload).hexdigest()
    except ValueError:
        raise Damaged("bad payload digest") from None
    return end + 4, {"record_type": kind, "record_id": name, "refers_to": to or None, "target_uri": head[b"warc-target-uri"].decode("utf-8", "replace")
                     if b"warc-target-uri" in head else None, "payload_digest": sha,
                     "payload_bytes": int(length[1]) if length else len(payload), "payload": payload}


def _before_fault(z, step) -> bytes:
    """What `step` gives before zlib raises: to the byte, unless the last byte shares a compressed byte with the fault."""
    out = []
    for size in (4096, 64, 1):  # zlib drops the output of the call that raises, so the calls get smaller
        for at in range(0, len(step), size):
            kept = z.copy()
            try:
                out.append(z.decompress(step[at:at + size]))
            except zlib.error:
                z, step = kept, step[at:at + size]
                break
    try:
        while step or out[-1]:
            out.append(z.decompress(step, 1))
            step = z.unconsumed_tail
    except zlib.error:
        pass
    return b"".join(out)


def _inflate(data, at: int):
    """(end, bytes, fault) of the gzip member at `at`; on a fault the bytes are what stands before it."""
    z, out, view = zlib.decompressobj(31), [], memoryview(data)
    while not z.eof and at < len(data):
        step, kept = view[at:at + 65536], z.copy()
        try:
            out.append(z.decompress(step))
        except zlib.error as e:
            return at, b"".join([*out, _before_fault(kept, step)]), str(e)
        at += len(step)
    return at - len(z.unused_data), b"".join(out), None if z.eof else "member is cut"


def _plain(data, base=None):
    """Events of uncompressed bytes; `base`: (start, end) of the gzip member they came from."""
    at, n = 0, len(data)
    while at < n:
        try:
            end, found = parse(data, at)
            yield ("record", *(base or (at, end)), found)
            at = end
        except Damaged as e:
            nxt = next((m.start() for m in _VERSION.finditer(data, at + 1) if _valid(data, m.start())), n)
            yield ("gap", *(base or (at, nxt)), str(e))
            at = nxt


def _valid(data, at: int) -> bool:
    try:
        parse(data, at)
        return True
    except Damaged:
        return False


def _starts_well(data, at: int) -> bool:
    """A gzip member at `at` whose bytes begin with a version line."""
    try:
        return bool(_VERSION.match(zlib.decompressobj(31).decompress(memoryview(data)[at:at + 4096], 64)))
    except zlib.error:
        return False


def _next_start(data, at: int) -> int:
    """The next valid gzip member or version line at or after `at`."""
    n = len(data)
    zipped = data.find(_MEMBER, at)
    while 0 <= zipped and not _starts_well(data, zipped):
        zipped = data.find(_MEMBER, zipped + 1)
    plain = next((m.start() for m in _VERSION.finditer(data, at) if _valid(data, m.start())), -1)
    return min((x for x in (zipped, plain) if x >= 0), default=n)


def salvage(data: bytes):
    """Yield ("record", start, end, dict) and ("gap", start, end, reason) for the bytes of one archive."""
    at, n = 0, len(data)
    while at < n:
        if data.startswith(_MEMBER, at):
            end, raw, fault = _inflate(data, at)
            if fault is None:
                yield from _plain(raw, (at, end))
            else:
                stop = _next_start(data, at + 1)
                for event in _plain(raw, (at, stop)):  # whole, verified records of a damaged member
                    if event[0] == "record":
                        yield event
                yield "gap", at, stop, fault
                end = stop
            at = end
        elif _VERSION.match(data, at) and _valid(data, at):
            end, found = parse(data, at)
            yield "record", at, end, found
            at = end
        else:
            try:
                parse(data, at)
                reason = "no member or version line"
            except Damaged as e:
                reason = str(e)
            stop = _next_start(data, at + 1)
            yield "gap", at, stop, reason
            at = stop


_SCHEMA = ("file string, kind string, start long, end long, reason string, record_type string, record_id string, refers_to string, "
           "target_uri string, payload_digest string, payload_bytes long, payload binary")
_FIELDS = ["record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, with_payload: bool = True,
                  whole: bool = False) -> DataFrame:
    """One row per record and per quarantined gap (kind "record" or "gap") of the archives in `folder`.

    With `whole`, anything that the manifest names and the archives don't hold is an error.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(folder)
    files = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    if whole:
        wanted = manifest.select("file", "records")
        lost = [r.file for r in wanted.join(files.select("file"), "file", "left_anti").limit(10).collect()]
        if lost:
            raise ValueError(f"files of the manifest are missing: {lost}")
        files = files.join(small_side(wanted), "file")
    elif manifest is not None:
        files = files.join(small_side(manifest.select("file")), "file", "left_semi")

    def run(batches):
        for batch in batches:
            for at, (name, data) in enumerate(zip(batch.column(0), batch.column(1))):
                rows, found = [], 0
                for kind, start, end, what in salvage(data.as_buffer().to_pybytes()):
                    found += kind == "record"
                    if whole and kind == "gap":
                        raise ValueError(f"{name}: gap at {start}-{end}: {what}")
                    values = [what[f] for f in _FIELDS] if kind == "record" else [None] * len(_FIELDS)
                    if not with_payload:
                        values[-1] = None
                    rows.append((name.as_py(), kind, start, end, what if kind == "gap" else None, *values))
                    if len(rows) >= 500:
                        yield _batch(rows)
                        rows = []
                if rows:
                    yield _batch(rows)
                if whole and found != batch.column(2)[at].as_py():
                    raise ValueError(f"{name}: {found} records read, {batch.column(2)[at]} written")
    return files.mapInArrow(run, _SCHEMA)


def _batch(rows):
    types = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(), pa.string(),
             pa.int64(), pa.binary()]
    names = ["file", "kind", "start", "end", "reason", *_FIELDS]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)


def page_number(col: str):
    """The page id in a record name; null if the page had none."""
    return F.regexp_extract(col, r"^urn:page:(-?\d+)$", 1).try_cast("long")
