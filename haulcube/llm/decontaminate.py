"""Benchmark decontamination by size-partitioned MinHash containment search (operator 1), DataFrame functions only.

A test item leaks into a document if the document holds at least `threshold` (0.8) of the item's distinct
shingles of five words (lower-cased, words as everywhere here; an item of fewer words is one shingle of
its own length).  Jaccard similarity is useless between a short item and a long text, so the search is
one-sided: items are partitioned by size, each partition has one sketch length, and a document is a
candidate if it holds any of the item's least-hashed shingles.

Sketch length: an item of q shingles may miss at most floor((1 - threshold) * q) of them, so with
floor((1 - threshold) * hi) + 1 least hashes, hi the largest size of its partition, at least one is held
by every document that reaches the threshold: the search has no false negatives.  Candidates are
verified by exact containment on the shingles themselves.

The sketches are broadcast if their counted size allows, otherwise the join is shuffled.  Documents are
exploded into shingle hashes in the scan and only the hits leave it.

Defined results: null or wordless items never match; null or wordless texts match nothing; repeated rows
give one row per (doc_id, item_id), on the union of the rows that share an id; rows and items with a null id are told
apart by their texts, and each distinct text is judged alone; empty tables give empty
results; extra columns are ignored (`drop_contaminated` keeps them).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, words_col, written

SHINGLE, THRESHOLD = 5, 0.8
#: Upper ends of the size partitions: powers of two, so that a sketch is at most twice as long as needed.
_PARTITION = "least(bigint(pow(2, ceil(log2(q)))), bigint(1) << 40)"


def _shingles(words: str, k):
    """All k-word shingles of the array column `words` as strings."""
    w = F.col(words)
    n = F.size(w) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))
                  ).otherwise(F.array().cast("array<string>"))


def _normal(col: str):
    return F.translate(F.col(col), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def item_shingles(items: DataFrame, item_col: str = "item_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(item, k, s, q): distinct shingles of every item, their length in words and their number."""
    w = items.select(F.col(item_col).alias("item"), words_col(_normal(text_col)).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(shingle))
    pieces = F.transform(F.sequence(F.lit(0), F.size("w") - k), lambda i: F.array_join(F.slice(F.col("w"), i + 1, F.least(F.size("w"), F.lit(shingle))), " "))
    flat = w.select("item", k.alias("k"), F.explode(pieces).alias("s")).distinct()
    return flat.join(flat.groupBy("item", "k").agg(F.count("*").alias("q")), ["item", "k"])


def sketches(shingles: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(item, k, h): the least hashes of every item; their number depends on the item's size partition."""
    from pyspark.sql import Window
    hi = F.expr(_PARTITION)
    length = F.floor((1 - threshold) * hi + 1e-9) + 1
    rank = F.row_number().over(Window.partitionBy("item", "k").orderBy("h", "s"))
    return (shingles.select("item", "k", "s", F.xxhash64("s").alias("h"), length.alias("length")).withColumn("r", rank)
            .where("r <= length").select("item", "k", "h"))


def _doc_hashes(docs: DataFrame, k: int) -> DataFrame:
    """(id, h): hashes of all k-word shingles; `docs` has (id, w)."""
    w = F.col("w")
    n = F.size(w) - k + 1
    hashes = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.xxhash64(F.concat_ws(" ", *(F.get(w, i + j) for j in range(k))))))
    return docs.select("id", F.explode(hashes).alias("h"))


def _key(col: str, text_col: str):
    """An id as a join key: null ids are told apart by their texts."""
    return F.struct(F.col(col).alias("id"), F.when(F.col(col).isNull(), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)).alias("text"))


def _leaks(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, item_col: str, item_text_col: str, shingle: int, threshold: float) -> DataFrame:
    """(id, item, q, n) for every contaminated pair; id and item are keys (`_key`)."""
    docs = docs.select(_key(id_col, text_col).alias("id"), F.col(text_col).alias("t"))
    items = items.select(_key(item_col, item_text_col).alias("item"), F.col(item_text_col).alias("t"))
    wanted = written(item_shingles(items, "item", "t", shingle), "bench-shingles")
    sketch = written(sketches(wanted, threshold), "bench-sketches")
    lengths = [r.k for r in wanted.select("k").distinct().collect()]  # at most `shingle` values
    src = docs.select("id", words_col(_normal("t")).alias("w"))
    found = docs.select("id").where(F.lit(False)).join(items.select("item").where(F.lit(False)), F.lit(False)).select(
        "id", "item", F.lit(0).cast("long").alias("q"), F.lit(0).cast("long").alias("n"))
    for k in sorted(lengths):
        index = small_side(written(sketch.where(F.col("k") == k).select("item", "h"), "bench-index"))
        hits = _doc_hashes(src, k).join(index, "h").select("id", "item", F.lit(k).alias("k")).distinct()
        candidates = written(hits, "bench-candidates")
        # verify: exact shingles of the candidate documents, first narrowed to shingles of any item
        ids = small_side(written(candidates.select("id").distinct(), "bench-ids"))
        held = docs.join(ids, "id", "left_semi").select("id", words_col(_normal("t")).alias("w"))
        held = held.select("id", F.explode(F.array_distinct(_shingles("w", k))).alias("s"))
        full = small_side(written(wanted.where(F.col("k") == k).select("item", "s", "q"), "bench-full"))
        counts = (held.join(full, "s").groupBy("id", "item", "q").agg(F.count_distinct("s").alias("n"))
                  .join(candidates.select("id", "item"), ["id", "item"], "left_semi").where(F.col("n") >= threshold * F.col("q")))
        found = found.unionByName(counts) if k != min(lengths) else counts
    return found


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, item_id, n_shingles, n_held, containment) for every contaminated pair."""
    found = _leaks(docs, items, id_col, text_col, item_col, item_text_col, shingle, threshold)
    return found.select(F.col("id.id").alias(id_col), F.col("item.id").alias(item_col), F.col("q").cast("long").alias("n_shingles"),
                        F.col("n").cast("long").alias("n_held"), (F.col("n") / F.col("q")).alias("containment"))


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                      item_text_col: str = "text", shingle: int = SHINGLE, threshold: float = THRESHOLD) -> DataFrame:
    """`docs` without the rows whose id (null ids: whose text) has a leak."""
    found = _leaks(docs, items, id_col, text_col, item_col, item_text_col, shingle, threshold)
    bad = small_side(written(found.select(F.col("id").alias("_bad")).distinct(), "bench-bad"))
    return docs.join(bad, _key(id_col, text_col) == F.col("_bad"), "left_anti")
