"""Periodic runs of words by recompression (operator 11).

A run is a stretch of consecutive words with smallest period q (words q apart are identical) that is at least
`min_exponent` periods and `min_length` words long and that no neighbouring word extends keeping the period.

Texts are put together in batches of words, each text between separators that occur once.  Recompression turns
a batch into a run-length grammar: block compression replaces every maximal block a^k by one symbol (a, k), then
pair compression deals the alphabet into a left and a right half and replaces every adjacent pair (left, right);
the two alternate until little is left.  Both are local: equal stretches are parsed alike except at their ends, so
the longest common extension of two places climbs the levels while both stand at the begin of a parent and
descends once from the first differing symbols, with one comparison a level.

Candidates lie on a harmonic grid: the matching places of a run with period q and exponent e are at least (e - 1) q
consecutive ones, so one of the places 0, (e - 1) q, 2 (e - 1) q, ... of the text is among them.  There are n ln n / (e - 1)
of them over all periods; those whose own and neighbouring words match are extended in both directions by the
grammar.  A stretch found for several periods keeps the smallest.

Defined results: a null or empty text has no words and no runs; rows are judged alone, whatever their id, so ties,
repeated rows and null ids are kept; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, words_col, words_of

#: Words put together in one grammar; a longer text stands alone.
BATCH_WORDS = 40_000
#: Candidates looked at together.
CHUNK = 1_000_000


class Grammar:
    """Levels of a recompressed sequence whose first and last symbols occur once.

    Level l has the symbols sym[l]; first[l][p] is the first child (at level l) of symbol p of level l + 1, parent[l] the
    inverse; blocks[l] tells block levels from pair levels.  `mirror()` is the same grammar read from the end.
    """

    def __init__(self, sequence: np.ndarray, enough: int):
        self.sym, self.first, self.parent, self.blocks = [np.ascontiguousarray(sequence, np.int64)], [], [], []
        self._next, seed, idle = int(sequence.max()) + 1, 0, 0
        while len(self.sym[-1]) > enough and idle < 64:
            self._compress_blocks()
            seed += 1
            idle = 0 if self._compress_pairs(seed) else idle + 1

    def _push(self, heads: np.ndarray, symbols: np.ndarray, blocks: bool):
        n = len(self.sym[-1])
        self.first.append(np.append(heads, n))
        self.parent.append(np.repeat(np.arange(len(heads)), np.diff(self.first[-1])))
        self.sym.append(symbols)
        self.blocks.append(blocks)

    def _named(self, symbols: np.ndarray, which: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """`symbols` with new symbols at `which`, equal for equal keys."""
        distinct, names = np.unique(keys, return_inverse=True)
        symbols[which] = self._next + names
        self._next += len(distinct)
        return symbols

    def _compress_blocks(self):
        s = self.sym[-1]
        heads = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        if len(heads) == len(s):
            return
        size = np.diff(np.append(heads, len(s)))
        many = np.flatnonzero(size > 1)
        self._push(heads, self._named(s[heads], many, s[heads[many]] * (len(s) + 1) + size[many]), True)

    def _compress_pairs(self, seed: int) -> bool:
        s = self.sym[-1]
        left = (mix64(s.astype(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) & np.uint64(1)).astype(bool)
        one, other = left[:-1] & ~left[1:], ~left[:-1] & left[1:]
        begins = np.flatnonzero(one if one.sum() >= other.sum() else other)
        if not len(begins):
            return False
        head = np.ones(len(s), bool)
        head[begins + 1] = False
        heads = np.flatnonzero(head)
        self._push(heads, self._named(s[heads], np.searchsorted(heads, begins), s[begins] * self._next + s[begins + 1]), False)
        return True

    def mirror(self) -> Grammar:
        out = object.__new__(Grammar)
        out.blocks, out.sym = self.blocks, [s[::-1] for s in self.sym]
        out.first = [f[-1] - f[::-1] for f in self.first]
        out.parent = [p[-1] - p[::-1] for p in self.parent]
        return out

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """How many symbols from i and from j on are equal, for arrays of places with i != j."""
        begin, i, j = i, i.copy(), j.copy()
        met, act = np.zeros(len(i), np.int64), np.arange(len(i))
        for level, (s, first, parent) in enumerate(zip(self.sym, self.first, self.parent)):
            a, b = i[act], j[act]
            same = s[a] == s[b]
            met[act[~same]] = level
            act, a, b = act[same], a[same], b[same]
            if not len(act):
                break
            pa_, pb = parent[a], parent[b]
            apart = np.flatnonzero((first[pa_] != a) | (first[pb] != b))
            if len(apart):
                a2, b2 = a[apart], b[apart]
                step = np.minimum(first[pa_[apart] + 1] - a2, first[pb[apart] + 1] - b2)
                a2, b2 = a2 + step, b2 + step
                a[apart], b[apart], pa_[apart], pb[apart] = a2, b2, parent[a2], parent[b2]
            met_here = (first[pa_] != a) | (first[pb] != b)
            i[act], j[act] = a, b
            met[act[met_here]] = level
            act = act[~met_here]
            i[act], j[act] = pa_[~met_here], pb[~met_here]
        top = self.sym[-1]
        met[act] = len(self.sym) - 1
        while len(act):
            act = act[top[i[act]] == top[j[act]]]
            i[act] += 1
            j[act] += 1
        for level in range(len(self.first) - 1, -1, -1):
            act = np.flatnonzero(met > level)
            if not len(act):
                continue
            s, first = self.sym[level], self.first[level]
            p, q = i[act], j[act]
            a, b = first[p], first[q]
            step = np.minimum(first[p + 1] - a, first[q + 1] - b) if self.blocks[level] else 1
            step = np.where(s[a] == s[b], step, 0)
            i[act], j[act] = a + step, b + step
        return i - begin


def batch_runs(texts: list[np.ndarray], min_exponent: int, min_length: int) -> list[np.ndarray]:
    """For each text (word codes) an array of rows (start, length, period), by start, then period."""
    sizes = np.array([len(t) for t in texts], np.int64)
    codes = int(max((t.max() for t in texts if len(t)), default=-1)) + 1
    marks = np.arange(codes, codes + len(texts) + 1)
    seq = np.concatenate([x for m, t in zip(marks, texts) for x in (np.array([m], np.int64), t)] + [marks[-1:]]).astype(np.int64)
    base = np.cumsum(sizes + 1) - sizes
    longest = sizes // min_exponent
    longest[sizes < min_length] = 0
    grammar = back = None
    found = np.empty((0, 3), np.int64)  # begin, end, period
    # runs known so far: a place inside one, and the place q on, meet again in that run if its period divides q
    until, period = np.zeros(len(seq), np.int64), np.ones(len(seq), np.int64)
    low = 1
    while low <= longest.max(initial=0):
        high = 8 * low  # small periods first
        for x, q in _grid(base, sizes, np.minimum(longest, high - 1), low, min_exponent - 1):
            keep = seq[x] == seq[x + q]
            x, q = x[keep], q[keep]
            wide = np.maximum(min_length, min_exponent * q) - q > 1
            near = (seq[x - 1] == seq[x + q - 1]) | (seq[x + 1] == seq[x + q + 1])
            keep = (near | ~wide) & ~((x + q < until[x]) & (q % period[x] == 0))
            x, q = x[keep], q[keep]
            if not len(x):
                continue
            if grammar is None:
                grammar = Grammar(seq, 2 * len(texts) + 2)
                back = grammar.mirror()
            last = len(seq) - 1
            begin = x - back.extension(last - (x - 1), last - (x + q - 1))
            end = x + q + grammar.extension(x, x + q)
            keep = end - begin >= np.maximum(min_length, min_exponent * q)
            new = np.unique(np.stack([begin[keep], end[keep], q[keep]], 1), axis=0)
            for b, e, p in new.tolist():
                inside = until[b:e] < e
                until[b:e][inside], period[b:e][inside] = e, p
            found = np.concatenate([found, new])
        low = high
    order = np.lexsort((found[:, 2], found[:, 1], found[:, 0]))
    found = found[order]
    if len(found):
        found = found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))]
    found = found[np.lexsort((found[:, 2], found[:, 0]))]
    where = np.searchsorted(base, found[:, 0], "right") - 1
    rows = np.stack([found[:, 0] - base[where], found[:, 1] - found[:, 0], found[:, 2]], 1)
    cut = np.searchsorted(where, np.arange(len(texts) + 1))
    return [rows[a:b] for a, b in zip(cut[:-1], cut[1:])]


def _grid(base, sizes, longest, low, stride):
    """Chunks of (place, period): places every stride * q from the begin of each text, periods low..longest."""
    count = np.maximum(longest - low + 1, 0)
    text = np.repeat(np.arange(len(base)), count)
    q = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count) + low
    places = (sizes[text] - 1 - q) // (stride * q) + 1
    ends = np.cumsum(places)
    a = 0
    while a < len(q):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + CHUNK, "right")))
        n = places[a:b]
        per = np.repeat(q[a:b], n)
        k = np.arange(len(per)) - np.repeat(np.cumsum(n) - n, n)
        yield np.repeat(base[text[a:b]], n) + stride * per * k, per
        a = b


def _codes(words: list[bytes], table: dict[bytes, int]) -> np.ndarray:
    known = table.setdefault
    return np.array([known(w, len(table)) for w in words], np.int64)


RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def find_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_exponent: int = 4, min_length: int = 6) -> DataFrame:
    """One row per document: id, n_words, runs (start, length, period; by start, then period), and kept_text: the words joined by
    one space without those that a run holds after its first period."""
    kind = docs.schema[id_col].dataType.simpleString()
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))

    def run(batches):
        def flush(ids, held):
            table: dict[bytes, int] = {}
            rows = batch_runs([_codes(w, table) for w in held], min_exponent, min_length)
            kept = []
            for words, runs in zip(held, rows):
                if len(runs):
                    delta = np.zeros(len(words) + 1, np.int64)
                    np.add.at(delta, runs[:, 0] + runs[:, 2], 1)
                    np.add.at(delta, runs[:, 0] + runs[:, 1], -1)
                    words = [w for w, d in zip(words, np.cumsum(delta[:-1]).tolist()) if not d]
                kept.append(b" ".join(words).decode())
            flat = np.concatenate(rows)
            offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], fields=list(RUN)))
            return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array([len(w) for w in held], pa.int64()), runs, pa.array(kept, pa.string())],
                                              names=["id", "n_words", "runs", "kept_text"])
        ids, held, n = [], [], 0
        for batch in batches:
            for r, value in enumerate(batch.column(1)):
                words = words_of(value)
                if held and n + len(words) > BATCH_WORDS:
                    yield flush(ids, held)
                    ids, held, n = [], [], 0
                ids.append(batch.column(0).slice(r, 1))
                held.append(words)
                n += len(words) + 1
        if held:
            yield flush(ids, held)
    schema = f"id {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, kept_text string"
    return src.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def with_planted_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text): in a tenth of the documents (by the crc32 of the id, null ids never) the words from a place on repeat with a period.

    With h the crc32, g = h div 10 and n words, word i >= a becomes word a + (i - a) % p, a = g % n, p = 1 + (n - a) div (3 + g % 8).
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    h = F.crc32(F.col("id").cast("string").cast("binary"))
    chosen = rows.select("id", "t", h.alias("h")).select("id", "t", F.expr("h div 10").alias("g"), F.when(F.expr("h % 10 = 0"), words_col(F.col("t"))).alias("w"))
    chosen = chosen.select("id", "t", "g", "w", F.expr("if(size(w) > 0, g % size(w), 0L)").alias("a"))
    chosen = chosen.select("id", "t", "w", "a", F.expr("1 + (size(w) - a) div (3 + g % 8)").alias("p"))
    repeated = F.expr("concat_ws(' ', transform(w, (x, i) -> if(i < a, x, get(w, cast(a + (i - a) % p as int)))))")
    return chosen.select(F.col("id").alias(id_col), F.when(F.coalesce(F.size("w"), F.lit(0)) > 0, repeated).otherwise(F.col("t")).alias(text_col))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Number of runs, the longest run (ties: smallest start, then period) and hashes of all runs and of the kept words."""
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    rows = found.select(id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
                        F.sha2("kept_text", 256).alias("collapsed_sha256"))
    return rows.select(id_col, "n_runs", (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"), (-F.col("best.period")).alias("period"),
                       F.expr("1000 * best.length div -best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
