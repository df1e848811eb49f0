"""Repeated-passage removal by De Bruijn compaction (operator 10).

A window is `window` (20) consecutive words of one document.  A word is removed if a window covers it
whose word sequence also starts earlier (smaller id, or same document and earlier start); windows are
judged on the input.

The token k-mers (windows) are the edges of a De Bruijn graph.  Consecutive windows that share one
minimizer (the least hash among their 6-word pieces) form a path; where every occurrence of a minimizer
carries the same path, the path does not branch and is compacted to a single edge, so one join decides
all its windows.  Only branching minimizers are opened into single windows, and only once per distinct
path.

Steps: (1) count minimizers; (2) a fixed-size bitmap of the repeated ones prunes the second reading, an
exact join follows; (3) a path is decided by its head (the occurrence with the smallest id), the windows
of branching heads by the smallest id of the window, and every decision carries the coordinate of its
source (id, hash of the text, word number); (4) the decisions of each document are joined back to its text, and
neighbouring windows with one alignment to one source become a span; (5) spans are cut at every 64th word of
their source, equal pieces collapse, and one join with the source's words compares them word by word;
what differs is withdrawn.  Repeats inside one document are found and compared with the text at hand.  Hashes
only propose: no word is removed unless its span was compared, and a collision can at most leave a
repeated word in place.

Defined results: a null or short text has no windows and loses nothing; rows that share an id (or have a
null id) are versions of one document and never cover each other, though each covers itself; a null id
comes before all others; empty tables give empty results; extra columns are ignored; ids must be integers.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, id_key, in_batches, may_contain, membership_bits, mix64, words_of, written

WINDOW, PIECE = 20, 6
BLOCK = 64  # words of a source that are compared at once
_CHUNK = 200_000  # words that are hashed together; a longer text is a chunk of its own
_BASE = 0x9E3779B97F4A7C15  # odd, so invertible modulo 2**64
_DECISION = "array<struct<k:long,src:long,sv:long,q:long>>"
_CLAIM = "struct<src:long,sv:long,block:long,lo:int,words:string>"
_CLAIM_TYPE = pa.list_(pa.struct([("src", pa.int64()), ("sv", pa.int64()), ("block", pa.int64()), ("lo", pa.int32()), ("words", pa.string())]))


def _powers(n: int):
    """Powers of the base and of its inverse modulo 2**64, for texts of up to n words."""
    inv = pow(_BASE, -1, 1 << 64)
    up, down = np.empty(n + 1, np.uint64), np.empty(n + 1, np.uint64)
    up[0] = down[0] = 1
    if n:
        up[1:], down[1:] = np.uint64(_BASE), np.uint64(inv)
        up, down = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return up, down


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Position of the first least value of every stretch of `width` values."""
    at, have = np.arange(len(x)), 1
    while have < width:
        step = min(have, width - have)
        right = x[step:] < x[:-step]
        x, at = np.where(right, x[step:], x[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return at


class _Chunk:
    """The windows and paths of some texts, hashed together.

    words: all words; offset[r]: number of the first word of text r; w: word numbers where a window starts, h its
    hash; path j covers windows start[j]..stop[j]-1 of w, all with the minimizer m[j]; s[j] is the hash of its words.
    """

    def __init__(self, texts: list[list[bytes]], powers, window: int, piece: int, hash_bits: int):
        counts = np.fromiter(map(len, texts), np.int64, len(texts))
        self.offset = np.concatenate(([0], np.cumsum(counts)))
        self.words = [x for words in texts for x in words]
        self.window, n = window, len(self.words)
        self.doc = np.repeat(np.arange(len(texts)), counts)
        ends = self.doc[window - 1:]
        self.w = np.flatnonzero(self.doc[:len(ends)] == ends)
        empty = np.zeros(0, np.uint64)
        self.h = self.m = self.s = empty
        self.start = self.stop = np.zeros(0, np.int64)
        if not len(self.w):
            return
        wh = np.fromiter(map(xxhash.xxh64_intdigest, self.words), np.uint64, n)
        if hash_bits < 64:
            wh &= np.uint64((1 << hash_bits) - 1)
        up, down = powers
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(wh * up[:n], out=prefix[1:])

        def span(a, b):  # hash of words a..b-1, the same wherever they stand
            return mix64((prefix[b] - prefix[a]) * down[a])

        p = mix64((prefix[piece:] - prefix[:-piece]) * down[:n - piece + 1])
        self.h = span(self.w, self.w + window)
        best = _least(p, window - piece + 1)[self.w]
        self.start = np.flatnonzero(np.concatenate(([True], best[1:] != best[:-1])))
        self.stop = np.append(self.start[1:], len(best))
        first = self.w[self.start]
        self.m = p[best[self.start]]
        self.s = mix64(span(first, self.w[self.stop - 1] + window) + (best[self.start] - first).astype(np.uint64))

    def distinct(self) -> np.ndarray:
        """The first path of every (text, m, s)."""
        doc = self.doc[self.w[self.start]] if len(self.start) else self.start
        order = np.lexsort((self.s, self.m, doc))
        same = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        same[1:] = (doc[a] == doc[b]) & (self.m[a] == self.m[b]) & (self.s[a] == self.s[b])
        return np.sort(order[~same])


def _chunks(batches, window, piece, hash_bits):
    """(batch, first row, chunk) for the texts of batches whose second column is the text."""
    powers = _powers(_CHUNK)

    def chunk(texts, n):
        nonlocal powers
        if n >= len(powers[0]):
            powers = _powers(2 * n)
        return _Chunk(texts, powers, window, piece, hash_bits)
    for batch in batches:
        texts, n, first = [], 0, 0
        for r, value in enumerate(batch.column(1)):
            words = words_of(value)
            if texts and n + len(words) > _CHUNK:
                yield batch, first, chunk(texts, n)
                texts, n, first = [], 0, r
            texts.append(words)
            n += len(words)
        if texts:
            yield batch, first, chunk(texts, n)


def minimizers(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, hash_bits: int = 64) -> DataFrame:
    """(m, s): the distinct paths of every text; `docs` has columns (id, t, v)."""
    def run(batches):
        def rows():
            for _, _, c in _chunks(batches, window, piece, hash_bits):
                j = c.distinct()
                if len(j):
                    yield as_long(c.m[j]), as_long(c.s[j])
        yield from in_batches(rows(), ["m", "s"])
    return docs.mapInArrow(run, "m long, s long")


def _repeated_paths(docs: DataFrame, repeats: np.ndarray, branching: np.ndarray, window: int, piece: int, hash_bits: int) -> DataFrame:
    """(m, s, id, v, p, hs): paths whose minimizer may be repeated, from word p; hs holds the window hashes if it may branch."""
    shared = docs.sparkSession.sparkContext.broadcast((repeats, branching))  # two bitmaps of a fixed size

    def run(batches):
        many, split = shared.value

        def rows():
            for batch, first, c in _chunks(batches, window, piece, hash_bits):
                j = c.distinct()
                j = j[may_contain(many, c.m[j])]
                if not len(j):
                    continue
                opened = may_contain(split, c.m[j])
                lists = [c.h[a:b].view(np.int64) if o else None for a, b, o in zip(c.start[j], c.stop[j], opened)]
                at = c.w[c.start[j]]
                row = pa.array(first + c.doc[at])
                yield (as_long(c.m[j]), as_long(c.s[j]), batch.column(0).take(row), batch.column(2).take(row),
                       pa.array(at - c.offset[c.doc[at]]), pa.array(lists, pa.list_(pa.int64())))
        yield from in_batches(rows(), ["m", "s", "id", "v", "p", "hs"], 20_000)
    return docs.mapInArrow(run, "m long, s long, id long, v long, p long, hs array<long>")


def decisions(docs: DataFrame, window: int = WINDOW, piece: int = PIECE, hash_bits: int = 64) -> DataFrame:
    """(id, paths, windows): content keys that another document with a smaller id has, too, each with the coordinate
    (src, sv, q) where it stands there: id, hash of the text and word number.  `docs` has (id, t, v)."""
    seen = minimizers(docs, window, piece, hash_bits)
    counted = seen.groupBy("m").agg(F.count("*").alias("n"), F.min("s").alias("s0"), F.max("s").alias("s1"))
    repeated = written(counted.where("n > 1").select("m", (F.col("s0") != F.col("s1")).alias("branches")), "kmer-repeats")
    found = _repeated_paths(docs, membership_bits(repeated, "m"), membership_bits(repeated.where("branches"), "m"), window, piece, hash_bits)
    paths = written(found.withColumn("id", id_key("id")).join(repeated, "m"), "kmer-paths")

    heads = written(paths.groupBy("m", "s").agg(F.min(F.struct("id", "p", "v")).alias("f"))
                    .select("m", "s", F.col("f.id").alias("src"), F.col("f.v").alias("sv"), F.col("f.p").alias("q")), "kmer-heads")
    later = (paths.select("m", "s", "id").join(heads, ["m", "s"]).where("id > src")
             .select("id", F.col("m").bitwiseXOR(F.col("s")).alias("k"), "src", "sv", "q"))
    edges = written(paths.where("branches").join(heads, ["m", "s"]).where("id = src and v = sv and p = q")
                    .select("m", "id", "v", "p", F.posexplode("hs").alias("i", "h"))
                    .select("m", "h", "id", "v", (F.col("p") + F.col("i")).alias("p")), "kmer-edges")
    shared = (edges.groupBy("m", "h").agg(F.min("id").alias("src"), F.max("id").alias("last")).where("src < last").drop("last"))
    met = written(edges.join(shared, ["m", "h"]), "kmer-shared")
    sources = (met.where("id = src").groupBy("m", "h").agg(F.min(F.struct("p", "v")).alias("f"))
               .select("m", "h", F.col("f.v").alias("sv"), F.col("f.p").alias("q")))
    single = (met.where("id > src").select("m", "h", "id", "src").join(sources, ["m", "h"])
              .select("id", F.col("m").bitwiseXOR(F.col("h")).alias("k"), "src", "sv", "q"))
    row, none = F.struct("k", "src", "sv", "q"), F.lit(None).cast("struct<k:long,src:long,sv:long,q:long>")
    tagged = later.select("id", row.alias("p"), none.alias("w")).unionByName(single.select("id", none.alias("p"), row.alias("w")))
    return tagged.groupBy("id").agg(F.collect_list("p").alias("paths"), F.collect_list("w").alias("windows"))


def _lookup(doc, key, at_doc, at_key) -> np.ndarray:
    """For each (at_doc, at_key) the number of an equal (doc, key), or -1."""
    n = len(doc)
    d, k = np.concatenate((doc, at_doc)), np.concatenate((key, at_key))
    order = np.lexsort((np.arange(len(d)), k, d))
    new = np.ones(len(order), bool)
    new[1:] = (d[order[1:]] != d[order[:-1]]) | (k[order[1:]] != k[order[:-1]])
    lead = order[np.flatnonzero(new)][np.cumsum(new) - 1] if len(order) else order
    out = np.empty(len(d), np.int64)
    out[order] = np.where(lead < n, lead, -1)
    return out[n:]


def _listed(column, first: int, rows: int):
    """Text number within the chunk and the fields of a list<struct> column's rows first..first+rows-1."""
    part = column.slice(first, rows)
    sizes = np.diff(part.offsets.to_numpy()) if rows else np.zeros(0, np.int64)
    if part.null_count:
        sizes = np.where(part.is_valid().to_numpy(zero_copy_only=False), sizes, 0)
    flat = part.flatten()
    return np.repeat(np.arange(rows), sizes), [x.to_numpy(zero_copy_only=False) for x in flat.flatten()]


def _own_repeats(c: _Chunk) -> np.ndarray:
    """Windows (as a mask of w) whose words start earlier in the same text, compared word by word."""
    doc = c.doc[c.w]
    both = np.repeat(c.m, c.stop - c.start) ^ mix64(c.h)
    order = np.argsort(both + doc.astype(np.uint64) * np.uint64(_BASE), kind="stable")
    a, b = order[:-1], order[1:]
    same = (both[a] == both[b]) & (doc[a] == doc[b])
    out = np.zeros(len(c.w), bool)
    if not same.any():
        return out
    back = np.full(len(c.w), -1)
    back[b[same]] = c.w[a[same]]
    at = np.flatnonzero(back >= 0)
    gap = c.w[at] - back[at]
    cut = np.flatnonzero(np.concatenate(([True], (c.w[at[1:]] != c.w[at[:-1]] + 1) | (gap[1:] != gap[:-1]))))
    for lo, hi in zip(cut, np.append(cut[1:], len(at))):
        here, there, n = c.w[at[lo]], back[at[lo]], hi - lo + c.window - 1
        if c.words[here:here + n] == c.words[there:there + n]:
            out[at[lo:hi]] = True
        else:
            for i in at[lo:hi]:
                out[i] = c.words[c.w[i]:c.w[i] + c.window] == c.words[back[i]:back[i] + c.window]
    return out


def _judged(c: _Chunk, paths, windows, bad):
    """Removed words of a chunk as a mask, and per text the claims (src, sv, block, lo, words) it rests on.

    paths, windows: (text, [k, src, sv, q]) as decided; bad: per text the claims that were found wrong.
    """
    rows = len(c.offset) - 1
    claims = [[] for _ in range(rows)]
    gone = np.zeros(len(c.words) + 1, np.int64)
    if len(c.w):
        doc = c.doc[c.w]
        src, sv, q = (np.zeros(len(c.w), np.int64) for _ in range(3))
        hit = np.zeros(len(c.w), bool)
        for inside, (of, (k, *coordinate)) in ((False, windows), (True, paths)):  # a path's claim goes before a window's
            if not len(of):
                continue
            has = np.isin(doc[c.start], of)
            j = np.flatnonzero(has)
            size = c.stop[j] - c.start[j]
            first = np.repeat(c.start[j], size)
            i = first + np.arange(len(first)) - np.repeat(np.cumsum(size) - size, size)
            if inside:
                found = np.repeat(_lookup(of, k.view(np.uint64), doc[c.start[j]], c.m[j] ^ c.s[j]), size)
            else:
                found = _lookup(of, k.view(np.uint64), doc[i], np.repeat(c.m[j], size) ^ c.h[i])
            ok = found >= 0
            i, found, into = i[ok], found[ok], (i - first)[ok] if inside else 0
            hit[i] = True
            src[i], sv[i], q[i] = coordinate[0][found], coordinate[1][found], coordinate[2][found] + into
        covered = _own_repeats(c)
        at = np.flatnonzero(hit)
        if len(at):
            gap = c.w[at] - q[at]
            a, b = at[1:], at[:-1]
            new = (c.w[a] != c.w[b] + 1) | (doc[a] != doc[b]) | (src[a] != src[b]) | (sv[a] != sv[b]) | (gap[1:] != gap[:-1])
            cut = np.flatnonzero(np.concatenate(([True], new)))
            for lo, hi in zip(cut.tolist(), np.append(cut[1:], len(at)).tolist()):
                i0, n = int(at[lo]), hi - lo + c.window - 1
                here, there, r = int(c.w[i0]), int(q[i0]), int(doc[i0])
                source, wrong, fine = (int(src[i0]), int(sv[i0])), bad[r], np.ones(n, bool)
                done = 0
                while done < n:
                    block, low = divmod(there + done, BLOCK)
                    step = min(BLOCK - low, n - done)
                    claim = (*source, block, low, b" ".join(c.words[here + done:here + done + step]).decode())
                    if claim in wrong:
                        fine[done:done + step] = False
                    else:
                        claims[r].append(claim)
                    done += step
                if fine.all():
                    covered[i0:i0 + hi - lo] = True
                else:  # windows whose every word was found equal
                    left = np.concatenate(([0], np.cumsum(fine)))
                    covered[i0:i0 + hi - lo] |= left[c.window:] - left[:-c.window] == c.window
        np.add.at(gone, c.w[covered], 1)
        np.add.at(gone, c.w[covered] + c.window, -1)
    return np.cumsum(gone[:-1]) > 0, claims


def _removed(rows: DataFrame, window: int, piece: int, hash_bits: int) -> DataFrame:
    """(id, v, n_words, n_removed, kept_text, claims) of rows (id, t, v, paths, windows, bad)."""
    def run(batches):
        for batch, first, c in _chunks(batches, window, piece, hash_bits):
            n = len(c.offset) - 1
            wrong = [{tuple(x.values()) for x in value or ()} for value in batch.column(5).slice(first, n).to_pylist()]
            gone, claims = _judged(c, _listed(batch.column(3), first, n), _listed(batch.column(4), first, n), wrong)
            lost = np.diff(np.concatenate(([0], np.cumsum(gone)))[c.offset])
            kept = []
            for a, b, k in zip(c.offset[:-1].tolist(), c.offset[1:].tolist(), lost.tolist()):
                words = c.words[a:b]
                kept.append(b" ".join([words[i] for i in np.flatnonzero(~gone[a:b])] if k else words).decode())
            claims = [[dict(zip(("src", "sv", "block", "lo", "words"), x)) for x in some] for some in claims]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, n), batch.column(2).slice(first, n), pa.array(np.diff(c.offset)), pa.array(lost),
                 pa.array(kept, pa.string()), pa.array(claims, _CLAIM_TYPE)],
                names=["id", "v", "n_words", "n_removed", "kept_text", "claims"])
    return rows.mapInArrow(run, f"id long, v long, n_words long, n_removed long, kept_text string, claims array<{_CLAIM}>")


def _wrong_claims(docs: DataFrame, judged: DataFrame) -> DataFrame:
    """(src, sv, block, lo, words): claims whose words do not stand at their source."""
    claims = judged.select(F.explode("claims").alias("c")).select("c.*").distinct()
    wanted = judged.select(F.explode("claims").alias("c")).select(F.col("c.src").alias("_src"), F.col("c.sv").alias("v")).distinct()
    sources = docs.withColumn("_src", id_key("id")).join(wanted, ["_src", "v"], "left_semi").dropDuplicates(["_src", "v"]).select("_src", "t", "v")

    def run(batches):
        def rows():
            for batch in batches:
                for r, value in enumerate(batch.column(1)):
                    words = words_of(value)
                    blocks = [b" ".join(words[a:a + BLOCK]).decode() for a in range(0, len(words), BLOCK)]
                    row = pa.array(np.full(len(blocks), r))
                    yield batch.column(0).take(row), batch.column(2).take(row), pa.array(np.arange(len(blocks))), pa.array(blocks, pa.string())
        yield from in_batches(rows(), ["src", "sv", "block", "there"], 20_000)
    there = sources.mapInArrow(run, "src long, sv long, block long, there string")
    equal = F.expr("words = there or words = array_join(slice(split(there, ' '), lo + 1, size(split(words, ' '))), ' ')")
    return claims.join(there, ["src", "sv", "block"], "left").where(~F.coalesce(equal, F.lit(False))).select("src", "sv", "block", "lo", "words")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, piece: int = PIECE,
                 hash_bits: int = 64) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept_text (kept words joined by one space).

    `hash_bits`: bits of a word's hash that are used; with few of them equal keys stop meaning equal words, and
    only the comparison at the source decides.
    """
    text = F.col(text_col)
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("t"), F.xxhash64(text).alias("v"))
    found = written(decisions(src, window, piece, hash_bits), "kmer-decisions")
    with_decisions = (src.withColumn("_key", id_key("id")).join(found.withColumnRenamed("id", "_key"), "_key", "left")
                      .select("id", "t", "v", *(F.coalesce(c, F.array().cast(_DECISION)).alias(c) for c in ("paths", "windows"))))
    no_bad = F.array().cast(f"array<{_CLAIM}>").alias("bad")
    judged = written(_removed(with_decisions.select("*", no_bad), window, piece, hash_bits), "kmer-judged")
    wrong = written(_wrong_claims(src, judged), "kmer-wrong")
    out = ["id", "n_words", "n_removed", "kept_text"]
    if wrong.isEmpty():
        return judged.select(*out).withColumnRenamed("id", id_col)
    key = [id_key("id").alias("_key"), "v"]
    hit = (judged.select(*key, F.explode("claims").alias("c")).select("_key", "v", "c.*").distinct()
           .join(wrong, ["src", "sv", "block", "lo", "words"]))
    bad = written(hit.groupBy("_key", "v").agg(F.collect_list(F.struct("src", "sv", "block", "lo", "words")).alias("bad")), "kmer-withdrawn")
    again = with_decisions.withColumn("_key", id_key("id")).join(bad, ["_key", "v"]).select("id", "t", "v", "paths", "windows", "bad")
    rest = judged.withColumn("_key", id_key("id")).join(bad, ["_key", "v"], "left_anti")
    return rest.select(*out).unionByName(_removed(again, window, piece, hash_bits).select(*out)).withColumnRenamed("id", id_col)
