"""Line deduplication by a deletion-neighbourhood join (operator 3).

Lines end at a newline; a line is its words joined by one space, and a line without words is always
kept.  A line is removed if an earlier line (smaller id, or same document and earlier line) has the same
words, or - for lines of at least `min_words` words - differs by one word inserted, removed or replaced.
The default is the shortest line in which one word is no more than a fifth.  Lines are judged on the input,
not on what is left.

Every line emits its deletion neighbourhood as hashed keys: the line without its i-th word, for every i,
and the line itself.  Equal keys join: two lines of n words that agree without word i differ by a
replacement, a line that equals another one without a word by an insertion.  The earliest line of a key
is the source of all others (a star, never all pairs), and each (line, source) pair is verified by its
edit distance on the words before the line goes.

Two lines within one word share the first or the last half of their words, so the neighbourhood is only
emitted for lines that share a half with a different line (a fixed-size bitmap of the shared halves
prunes the second reading; it never loses a pair).

Defined results: a null text stays null; rows that share an id (or have a null id) are versions of one
document and are judged against other ids and themselves only; a null id comes first; an emptied
document stays as an empty text; empty tables give empty results; extra columns are passed through; ids
must be integers.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, id_key, may_contain, membership_bits, mix64, replace_text, written

MIN_WORDS = 5
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)


def within_one_edit(a: list, b: list) -> bool:
    """Edit distance of two word lists is at most one."""
    if abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)):] == b[i + 1:]


def _hash(line: bytes):
    return xxhash.xxh64_intdigest(line, 1), xxhash.xxh64_intdigest(line, 2)


def _halves(words: list[bytes]) -> list[int]:
    """Hashes of the first and last halves that any line within one edit shares one of."""
    n = len(words)
    first = {n // 2, (n - 1) // 2}
    last = {n - n // 2, n - 1 - (n - 1) // 2}
    return [xxhash.xxh64_intdigest(b" ".join(words[:k]), 3) for k in first] + [xxhash.xxh64_intdigest(b" ".join(words[n - k:]), 4) for k in last]


def neighbourhood(words: list[bytes]):
    """(keys, places): hashes of the line without its i-th word, i = 0.., and of the whole line (place -1)."""
    n = len(words)
    wh = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, n)
    up = np.full(n, _BASE, np.uint64)
    up[0] = 1
    up = np.multiply.accumulate(up)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(wh * up, out=prefix[1:])
    without = prefix[:n] + (prefix[n] - prefix[1:]) * np.uint64(_INV)
    size = np.full(n + 1, n - 1, np.uint64)
    size[n] = n
    return mix64(np.append(without, prefix[n]) ^ mix64(size)), np.append(np.arange(n), -1)


def _lines(value):
    """Distinct lines (word lists) of a text in order of appearance."""
    seen = {}
    if value.is_valid:
        for line in value.as_buffer().to_pybytes().split(b"\n"):
            words = line.split()
            if words:
                seen.setdefault(b" ".join(words), words)
    return seen


def _line_keys(docs: DataFrame, min_words: int) -> DataFrame:
    """(k, tag, v): per distinct line of a text its hash pair with the id, and its halves with its hash."""
    def run(batches):
        for batch in batches:
            k, tag, v = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                key &= 2**64 - 1
                for line, words in _lines(value).items():
                    h, h2 = _hash(line)
                    k.append(h)
                    tag.append(h2 | 1)
                    v.append(key)
                    if len(words) >= min_words:
                        part = _halves(words)
                        k += part
                        tag += [0] * len(part)
                        v += [h] * len(part)
                if len(k) > 100_000:
                    yield pa.RecordBatch.from_arrays([as_long(np.array(x, np.uint64)) for x in (k, tag, v)], names=["k", "tag", "v"])
                    k, tag, v = [], [], []
            if k:
                yield pa.RecordBatch.from_arrays([as_long(np.array(x, np.uint64)) for x in (k, tag, v)], names=["k", "tag", "v"])
    return docs.mapInArrow(run, "k long, tag long, v long")


def _shared_lines(docs: DataFrame, repeated: np.ndarray, halves: np.ndarray, min_words: int) -> DataFrame:
    """(h, tag, id, line) of the lines that are repeated or share a half with a different line; the text only of the latter."""
    shared = docs.sparkSession.sparkContext.broadcast((repeated, halves))  # bitmaps of a fixed size

    def hits(again, near, ids, texts, pairs, at, parts):
        h = np.array([x for x, _ in pairs], np.uint64)
        some = np.zeros(len(pairs), bool)
        some[np.array(at, np.int64)[may_contain(near, np.array(parts, np.uint64))]] = True
        keep = np.flatnonzero(may_contain(again, h) | some)
        tags = np.array([x | 1 for _, x in pairs], np.uint64)
        return pa.RecordBatch.from_arrays(
            [as_long(h[keep]), as_long(tags[keep]), pa.array(np.array(ids, np.int64)[keep]),
             pa.array([texts[i].decode() if some[i] else None for i in keep.tolist()], pa.string())], names=["h", "tag", "id", "line"])

    def run(batches):
        again, near = shared.value
        for batch in batches:
            held = [], [], [], [], []
            ids, texts, pairs, at, parts = held
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                for line, words in _lines(value).items():
                    if len(words) >= min_words:
                        part = _halves(words)
                        at += [len(ids)] * len(part)
                        parts += part
                    ids.append(key)
                    texts.append(line)
                    pairs.append(_hash(line))
                if len(ids) > 20_000:
                    yield hits(again, near, *held)
                    for x in held:
                        x.clear()
            if ids:
                yield hits(again, near, *held)
    return docs.mapInArrow(run, "h long, tag long, id long, line string")


def _variants(lines: DataFrame) -> DataFrame:
    """(r, place, h, id): the deletion neighbourhood of every distinct line (h, id, line)."""
    def run(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, 1000):
                rows = batch.slice(a, 1000)
                found = [neighbourhood(value.as_buffer().to_pybytes().split()) for value in rows.column(2)]
                one = pa.array(np.repeat(np.arange(len(found)), [len(k) for k, _ in found]))
                yield pa.RecordBatch.from_arrays(
                    [as_long(np.concatenate([k for k, _ in found])), pa.array(np.concatenate([p for _, p in found]).astype(np.int32)),
                     rows.column(0).take(one), rows.column(1).take(one)], names=["r", "place", "h", "id"])
    return lines.mapInArrow(run, "r long, place int, h long, id long")


def _verified(pairs: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            ok = [within_one_edit(a.as_py().split(" "), b.as_py().split(" ")) for a, b in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["h", "first"]).filter(pa.array(ok, pa.bool_()))
    return pairs.select("h", "first", "line", "src_line").mapInArrow(run, "h long, first long")


def _near_firsts(lines: DataFrame) -> DataFrame:
    """(h, first): the smallest id that holds a line within one edit of line h, if smaller than h's own; `lines` is written."""
    variants = written(_variants(lines), "line-variants")
    cut = F.col("place") >= 0
    # a replacement: equal without the same word; the earliest line of the key is the source of the others
    same = (variants.where(cut).groupBy("r", "place").agg(F.min("id").alias("first"), F.min("h").alias("h0"), F.max("h").alias("h1"))
            .where("h0 <> h1").select("r", "place", "first"))
    # an insertion: a line equals another one without a word; each side's earliest line is the other side's source
    pair = (variants.groupBy("r").agg(F.min(F.when(~cut, F.col("id"))).alias("whole"), F.min(F.when(cut, F.col("id"))).alias("cut"))
            .where("whole is not null and cut is not null"))
    same, pair = written(same, "line-replaced"), written(pair, "line-inserted")
    met = variants.where(cut).join(same, ["r", "place"]).select("r", "h", "id", "first", F.col("place").alias("src_place"), F.lit(0).alias("kind"))
    longer = variants.where(cut).join(pair, "r").select("r", "h", "id", F.col("whole").alias("first"), F.lit(-1).alias("src_place"), F.lit(1).alias("kind"))
    shorter = variants.where(~cut).join(pair, "r").select("r", "h", "id", F.col("cut").alias("first"), F.lit(None).cast("int").alias("src_place"), F.lit(2).alias("kind"))
    met = written(met.unionByName(longer).unionByName(shorter).where("id >= first"), "line-met")
    later = met.where("id > first").select("r", "kind", "src_place", "h", "first")
    # the source: the line that the first id has on the other side of the key
    source = variants.join(later.select("r", "kind", "src_place", F.col("first").alias("id")).distinct(), ["r", "id"]).where(
        F.when(F.col("kind") == 0, F.col("place") == F.col("src_place")).when(F.col("kind") == 1, F.col("place") == -1).otherwise(F.col("place") >= 0))
    source = source.groupBy("r", "kind", F.coalesce("src_place", F.lit(-2)).alias("sp"), F.col("id").alias("first")).agg(F.min("h").alias("src"))
    linked = (later.withColumn("sp", F.coalesce("src_place", F.lit(-2))).join(source, ["r", "kind", "sp", "first"]).where("h <> src")
              .select("h", "first", "src").distinct())
    texts = lines.select("h", "line")
    pairs = linked.join(texts, "h").join(texts.select(F.col("h").alias("src"), F.col("line").alias("src_line")), "src")
    return _verified(pairs).groupBy("h").agg(F.min("first").alias("first"))


def decisions(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(id, lines): hashes of the lines of each id that an earlier id has, too; `docs` has (id, t), no null id."""
    counted = _line_keys(docs, min_words).groupBy("k", "tag").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    repeats = written(counted.where("lo <> hi"), "line-repeats")
    exact_first = repeats.where("tag <> 0").select(F.col("k").alias("h"), "tag", F.col("lo").alias("first"))
    halves = repeats.where("tag = 0").select("k")
    rows = written(_shared_lines(docs, membership_bits(exact_first, "h"), membership_bits(halves, "k"), min_words), "line-shared")
    exact = rows.join(exact_first, ["h", "tag"]).where("id > first").select("id", "h")
    distinct = written(rows.where("line is not null").groupBy("h").agg(F.min("id").alias("id"), F.min("line").alias("line"))
                       .select("h", "id", "line"), "line-distinct")
    near = written(_near_firsts(distinct), "line-near")
    close = rows.where("line is not null").join(near, "h").where("id > first").select("id", "h")
    return exact.unionByName(close).groupBy("id").agg(F.collect_set("h").alias("lines"))


def strip_text(raw: bytes, gone, min_words: int = MIN_WORDS):
    """(kept text, lines with words, removed lines) of one text, given the hashes of lines that an earlier id has."""
    gone = set(gone)
    lines = [(line, line.split()) for line in raw.split(b"\n")]
    distinct = {}
    for _, words in lines:
        if words:
            distinct.setdefault(b" ".join(words), words)
    near = _near_inside([w for w in distinct.values() if len(w) >= min_words])
    seen, kept, n_lines, n_removed = set(), [], 0, 0
    for line, words in lines:
        if not words:
            kept.append(line)
            continue
        n_lines += 1
        text = b" ".join(words)
        drop = text in seen or text in near
        if gone and not drop:
            h = _hash(text)[0]
            drop = (h - (1 << 64) if h >> 63 else h) in gone
        seen.add(text)
        if drop:
            n_removed += 1
        else:
            kept.append(line)
    return b"\n".join(kept), n_lines, n_removed


def _near_inside(lines: list[list[bytes]]) -> set[bytes]:
    """The distinct lines of one text that are within one edit of a line before them.

    Such lines share one of their halves (see `_halves`).
    """
    if len(lines) < 2:
        return set()
    found, halves, by_key = set(), {}, {}
    for i, words in enumerate(lines):
        n = len(words)
        for k in {n // 2, (n - 1) // 2}:
            halves.setdefault((0, *words[:k]), []).append(i)
        for k in {n - n // 2, n - 1 - (n - 1) // 2}:
            halves.setdefault((1, *words[n - k:]), []).append(i)
    for i in sorted({i for same in halves.values() if len(same) > 1 for i in same}):
        words = lines[i]
        keys, places = neighbourhood(words)
        for key, place in zip(keys.tolist(), places.tolist()):
            # one earlier line per place stands for the rest: those without the same word, and the whole line against the cut ones
            partners = by_key.setdefault(key, {})
            others = [partners.get(-1), partners.get(place)] if place >= 0 else [partners.get("cut")]
            if any(o is not None and within_one_edit(words, o) for o in others):
                found.add(b" ".join(words))
            partners.setdefault(place, words)
            if place >= 0:
                partners.setdefault("cut", words)
    return found


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """(_row, new_text, n_lines, n_removed) for every row; `_row` is the input row."""
    src = docs.select(F.struct(*docs.columns).alias("_row"), id_key(F.col(id_col).cast("long")).alias("id"), F.col(text_col).alias("t"))
    found = written(decisions(src.select("id", "t"), min_words), "line-decisions")
    joined = src.join(found, "id", "left").select("_row", "t", "lines")
    out = (joined.select("_row").schema.add("new_text", "string").add("n_lines", "long").add("n_removed", "long"))

    def run(batches):
        for batch in batches:
            texts, counts, removed = [], [], []
            for value, lines in zip(batch.column(1), batch.column(2)):
                if not value.is_valid:
                    text, n, gone = None, 0, 0
                else:
                    hashes = lines.values.to_pylist() if lines.is_valid else ()
                    text, n, gone = strip_text(value.as_buffer().to_pybytes(), hashes, min_words)
                texts.append(None if text is None else text.decode())
                counts.append(n)
                removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int64()),
                                              pa.array(removed, pa.int64())], names=["_row", "new_text", "n_lines", "n_removed"])
    return joined.mapInArrow(run, out)


def without_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with the repeated lines taken out of the text."""
    return replace_text(dedup_lines(docs, id_col, text_col, min_words), docs.columns, text_col, F.col("new_text"))
