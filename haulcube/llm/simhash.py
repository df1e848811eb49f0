"""SimHash near-duplicates with pigeonring filtering (operator 9).

Fingerprint: words of the lower-cased (A-Z only) text, `shingle` consecutive words joined by one
space, repeats included; a bit is 1 if set in over half of the XXH64 (seed 42) values.  A text with
fewer words uses the whole sequence; a text without words (or a null text) has fingerprint zero and
is linked like any other.  Two fingerprints link if at most `max_bits` bits differ; the component id
is the smallest id reachable.

Links are found on *distinct* fingerprints.  The 64 bits form a ring of `max_bits + 1` segments.  By
the pigeonring principle some start has every chain of consecutive segments within its proportional
budget: the first segment has no difference and the first two together at most one (for two bits), so
one half of the second segment is unchanged, too.  The join key is (start, first segment, that half);
the remaining chain checks and the full Hamming test follow.  A key shared by more than `bucket`
distinct fingerprints is not expanded into pairs: its members meet in their one-bit neighbourhoods
(equal after flipping at most one bit on either side, i.e. distance <= 2), which is exact and linear.
Components come from min-label propagation with pointer jumping over written tables.

Defined results: a null id never names a component (only null ids: a null component); repeated rows
share everything; ids must be integers; empty tables give empty results; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_long, small_side, written


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, rows: bool = False) -> DataFrame:
    """(id, fp long) for every row; with `rows`, the row itself as the struct `_row`, too."""
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("t"),
                      *([F.struct(*docs.columns).alias("_row")] if rows else []))
    out = src.select("id").schema.add("fp", "long")
    if rows:
        out = out.add(src.schema["_row"])

    def run(batches):
        shifts = np.arange(64, dtype=np.uint64)
        for batch in batches:
            fp = np.zeros(batch.num_rows, dtype=np.uint64)
            for r, text in enumerate(batch.column(1)):
                words = text.as_buffer().to_pybytes().lower().split() if text.is_valid else []
                if not words:
                    continue
                if len(words) <= shingle:
                    h = np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], dtype=np.uint64)
                else:
                    n = len(words) - shingle + 1
                    joined = map(b" ".join, zip(*(words[k:] for k in range(shingle))))
                    h = np.fromiter((xxhash.xxh64_intdigest(s, 42) for s in joined), np.uint64, n)
                counts = np.zeros(64, dtype=np.int64)
                for a in range(0, len(h), 8192):
                    bits = np.unpackbits(h[a:a + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                    counts += bits.sum(axis=0, dtype=np.int32)
                fp[r] = np.bitwise_or.reduce(np.where(2 * counts > len(h), np.uint64(1) << shifts, np.uint64(0)))
            yield pa.RecordBatch.from_arrays([batch.column(0), as_long(fp)] + ([batch.column(2)] if rows else []), names=out.names)
    return src.mapInArrow(run, out)


def _segments(max_bits: int):
    """(shift, width) of the ring's segments."""
    m = max_bits + 1
    cuts = [64 * i // m for i in range(m + 1)]
    return [(cuts[i], cuts[i + 1] - cuts[i]) for i in range(m)]


def _piece(fp, shift: int, width: int):
    return F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))


def _chains_hold(x, max_bits: int, start):
    """Pigeonring test on x = a XOR b: from `start`, the first l segments differ by at most floor(l * max_bits / m)."""
    segs = _segments(max_bits)
    m = len(segs)
    test = F.lit(False)
    for i in range(m):
        ok, total = F.lit(True), F.lit(0)
        for step in range(1, m + 1):
            shift, width = segs[(i + step - 1) % m]
            total = total + F.bit_count(_piece(x, shift, width))
            ok = ok & (total <= step * max_bits // m)
        test = test | ((start == i) & ok)
    return test


def _keys(fps: DataFrame, max_bits: int) -> DataFrame:
    """(start, half, a, b, fp): chain keys of each distinct fingerprint."""
    segs = _segments(max_bits)
    m, fp = len(segs), F.col("fp")
    keys = []
    for i in range(m):
        first = _piece(fp, *segs[i])
        if max_bits == 2:
            # two segments together hold at most floor(2 * 2 / 3) = 1 difference: one half of the second is equal
            shift, width = segs[(i + 1) % m]
            low = width // 2
            for half, (s, w) in enumerate(((shift, low), (shift + low, width - low))):
                keys.append(F.struct(F.lit(i).alias("start"), F.lit(half).alias("half"), first.alias("a"),
                                     _piece(fp, s, w).alias("b")))
        else:
            keys.append(F.struct(F.lit(i).alias("start"), F.lit(0).alias("half"), first.alias("a"),
                                 F.lit(0).cast("long").alias("b")))
    return fps.select(F.explode(F.array(*keys)).alias("k"), "fp").select("k.*", "fp")


def links(fps: DataFrame, max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """Links (a < b in no particular meaning) between distinct fingerprints; star links inside hot buckets.

    `fps`: a written table of distinct fingerprints.  Every pair within `max_bits` is connected, directly
    or through a star of fingerprints that are themselves within `max_bits` of its centre.
    """
    if max_bits not in (0, 1, 2):
        raise ValueError("max_bits must be 0, 1 or 2")
    if max_bits == 0:  # distinct fingerprints never link
        return fps.select(F.col("fp").alias("u"), F.col("fp").alias("v")).where(F.lit(False))
    key = ["start", "half", "a", "b"]
    keys = _keys(fps, max_bits)
    sizes = written(keys.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1"), "simhash-buckets")
    shared = written(keys.join(sizes, key), "simhash-keys")
    cold = shared.where(F.col("n") <= bucket)
    right = cold.select(*key, F.col("fp").alias("fp2"))
    x = F.col("fp").bitwiseXOR(F.col("fp2"))
    pairs = (cold.join(right, key).where("fp < fp2")
             .where(_chains_hold(x, max_bits, F.col("start")) & (F.bit_count(x) <= max_bits))
             .select(F.col("fp").alias("u"), F.col("fp2").alias("v")))
    # Hot buckets: a and b are within 2 bits iff flipping at most one bit in each makes them equal; a meeting
    # point is shared by at most 65 distinct fingerprints.  (For one bit only the unflipped side may meet.)
    hot = shared.where(F.col("n") > bucket).select("fp").distinct()
    flips = F.concat(F.array(F.lit(0).cast("long")),
                     F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("shiftleft", F.lit(1).cast("long"), i)))
    met = hot.select("fp", F.explode(flips).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("p"))
    if max_bits == 2:
        stars = met.groupBy("p").agg(F.min("fp").alias("u"), F.collect_list("fp").alias("m")).where(F.size("m") > 1)
        stars = stars.select("u", F.explode("m").alias("v")).where("u <> v")
    else:
        stars = met.join(hot.select(F.col("fp").alias("p")), "p").where("fp < p").select(F.col("fp").alias("u"), F.col("p").alias("v"))
    return pairs.unionByName(stars).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): connected components of an undirected link table, by min-label hooking and pointer jumping.

    Rounds grow with the logarithm of the longest path; every round ends in a written table.
    """
    both = written(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))), "cc-edges")
    label = written(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("root")).select(F.col("u").alias("node"), "root"),
                    "cc-labels")
    while True:
        # hook: each root learns the smallest root next to its members
        near = (both.join(label.select(F.col("node").alias("v"), F.col("root").alias("rv")), "v")
                .groupBy("u").agg(F.min("rv").alias("rv")))
        hooks = written(label.join(near.withColumnRenamed("u", "node"), "node")
                 .groupBy("root").agg(F.min("rv").alias("to"))
                 .select(F.col("root").alias("r0"), F.least("r0", "to").alias("to")), "cc-hooks")
        # jump: node -> hooked root -> that root's own label
        up = label.select(F.col("node").alias("to"), F.col("root").alias("up"))
        new = (label.join(hooks, label["root"] == hooks["r0"], "left")
               .select("node", "root", F.least(F.coalesce("to", "root"), "root").alias("to")).join(up, "to", "left")
               .select("node", F.least(F.coalesce("up", "to"), "to").alias("root"), F.col("root").alias("old")))
        new = written(new, "cc-labels")
        if new.where("root <> old").isEmpty():
            return new.select("node", "root")
        label = new.select("node", "root")


def _groups(fps: DataFrame, max_bits: int, bucket: int) -> DataFrame:
    """(fp, root): the group of every distinct fingerprint of the written table `fps`."""
    distinct = written(fps.select("fp").distinct(), "simhash-distinct")
    comp = components(links(distinct, max_bits, bucket))
    return written(distinct.join(comp, distinct["fp"] == comp["node"], "left").select("fp", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                    max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id."""
    fps = written(fingerprints(docs, id_col, text_col, shingle), "simhash-fp")
    roots = _groups(fps, max_bits, bucket)
    first = fps.groupBy("fp").agg(F.min("id").alias("first"))
    ids = roots.join(first, "fp").groupBy("root").agg(F.min("first").alias("component_id"))
    of = written(roots.join(ids, "root").select("fp", "component_id"), "simhash-comp")
    return fps.join(of, "fp").select(F.col("id").alias(id_col), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3,
                         max_bits: int = 2, bucket: int = 64) -> DataFrame:
    """`docs` with one row of each group: the smallest id (null ids last), of equal ids any one."""
    rows = written(fingerprints(docs, id_col, text_col, shingle, rows=True).withColumn("rid", F.monotonically_increasing_id()), "simhash-rows")
    fps = rows.select("id", "fp", "rid")
    roots = _groups(fps, max_bits, bucket)
    rank = F.struct(F.col("id").isNull().alias("last"), "id", "rid")
    best = fps.groupBy("fp").agg(F.min(rank).alias("best"))
    keep = roots.join(best, "fp").groupBy("root").agg(F.min("best").alias("best"))
    keep = written(roots.join(keep, "root").select("fp", F.col("best.rid").alias("keep")), "simhash-keep")
    gone = small_side(written(fps.join(keep, "fp").where("rid <> keep").select(F.col("rid").alias("_gone")), "simhash-gone"))
    return rows.join(gone, rows["rid"] == gone["_gone"], "left_anti").select("_row.*")
