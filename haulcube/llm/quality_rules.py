"""Host-level quality rules (operator 5), DataFrame functions only.

Per text: base counts, a hard rule (`base_failed`: under 20 words, or over 30 % of the words inside
8-word windows found twice or more) and softer rules (symbols, repeated lines, word length).  Rule
failures are summed per host (`source`), each host's failure rate is shrunk towards the mean of all
hosts by a beta prior whose strength is fitted to the spread of the rates (method of moments), and the
host verdict is joined back: on a host whose shrunk rate exceeds `host_rate`, a document that breaks
any soft rule is rejected as well.  A document that passes every rule is kept on any host.

Windows are compared by a 64-bit hash of their eight words.  Defined results: null text has no words
(base_failed); a null source is a host of its own; repeated rows count separately; empty tables give
empty results; extra columns are ignored (`reject` keeps them).
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_CLASS, WORD_CLASS, small_side, words_col, written

SYMBOLS = "#*$%&|<>"
WHITE = " \t\n\x0b\x0c\r"
#: Soft rules: symbols per word, share of repeated lines, mean word length.
MAX_SYMBOLS_PER_WORD, MAX_DUP_LINE_SHARE, WORD_LENGTH = 0.1, 0.3, (3.0, 12.0)
HOST_RATE = 0.3


def _repeat_words(h: str, n: int = 8):
    """Words covered by an n-word window whose hash occurs twice or more; h names the array of word hashes.

    Sorting (hash, position) pairs keeps it O(n log n) for any text length.
    """
    col = F.col(h)
    return F.when(F.size(F.array_distinct(col)) == F.size(col), F.lit(0).cast("long")).otherwise(
        _covered(F.col("_sorted"), n))


def _covered(sorted_pairs, n: int):
    same = lambda x, j: (F.get(sorted_pairs, j + 1)["h"] == x["h"]) | (F.get(sorted_pairs, j - 1)["h"] == x["h"])
    at = F.array_sort(F.transform(F.filter(sorted_pairs, lambda x, j: F.coalesce(same(x, j), F.lit(False))), lambda x: x["i"]))
    # each start covers n words, less what the next start covers again
    return F.aggregate(at, F.struct(F.lit(0).cast("long").alias("s"), F.lit(-n).alias("last")),
                       lambda a, p: F.struct((a["s"] + F.least(F.lit(n), p - a["last"])).alias("s"), p.alias("last")),
                       lambda a: a["s"])


def measure(docs: DataFrame, text_col: str = "text", source_col: str = "source", keep: list[str] | None = None) -> DataFrame:
    """Counts and rule outcomes of every row beside the columns named in `keep` (default: all)."""
    cols = docs.columns if keep is None else keep
    base = docs.select(F.struct(*cols).alias("_row") if cols else F.struct(F.lit(1)).alias("_row"),
                       F.col(source_col).alias("_host"), F.coalesce(F.col(text_col), F.lit("")).alias("_t"))
    words = base.select("_row", "_host", "_t", words_col(F.col("_t")).alias("_w"))
    # a materialised array of word hashes; windows combine eight of them
    hashed = words.select("_row", "_host", "_t", F.size("_w").cast("long").alias("n_words"),
                          F.transform("_w", lambda w: F.xxhash64(w)).alias("_wh"))
    win = hashed.select("_row", "_host", "_t", "n_words",
                        F.when(F.col("n_words") >= 8, F.transform(
                            F.sequence(F.lit(0), (F.col("n_words") - 8).cast("int")),
                            lambda i: F.xxhash64(*(F.get(F.col("_wh"), i + k) for k in range(8)))))
                        .otherwise(F.array().cast("array<bigint>")).alias("_win"))
    pairs = win.select("*", F.when(F.size(F.array_distinct("_win")) < F.size("_win"), F.array_sort(
        F.transform("_win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_sorted"))
    t = F.col("_t")
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS))
    counted = pairs.select(
        "_row", "_host", "n_words",
        F.length(F.translate(t, WHITE, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(F.col("_sorted").isNull(), F.lit(0).cast("long")).otherwise(_covered(F.col("_sorted"), 8)).alias("n_repeat_words"))
    counted = counted.select(
        "_row", "_host", "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size("_lines").cast("long").alias("n_lines"), "n_repeat_words")
    n = F.col("n_words")
    length = F.col("word_chars") / F.greatest(n, F.lit(1))
    soft = ((F.col("n_symbols") > MAX_SYMBOLS_PER_WORD * n) | (F.col("n_dup_lines") > MAX_DUP_LINE_SHARE * F.col("n_lines"))
            | (length < WORD_LENGTH[0]) | (length > WORD_LENGTH[1]))
    failed = (n < 20) | (100 * F.col("n_repeat_words") > 30 * n)
    return counted.select("*", failed.alias("base_failed"), soft.alias("soft_failed"))


def host_verdicts(measured: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """One row per host: documents, rule failures, shrunk failure rate, `host_bad`."""
    fails = (F.col("base_failed") | F.col("soft_failed")).cast("long")
    hosts = written(measured.groupBy("_host").agg(F.count("*").alias("n"), F.sum(fails).alias("x")), "quality-hosts")
    x, n = F.col("x"), F.col("n")
    total = hosts.agg((F.sum(x) / F.sum(n)).alias("m"), (F.sum(x * x / n) / F.sum(n)).alias("sq"), (F.count("*") / F.sum(n)).alias("inv"))
    m = F.col("m")
    # between-host variance = spread of the rates (weighted by documents) less its sampling part;
    # strength a + b = m (1 - m) / variance - 1
    spread = F.greatest(F.col("sq") - m * m - m * (1 - m) * F.col("inv"), F.lit(1e-6))
    mean = total.select("m").scalar()
    strength = total.select(F.greatest(m * (1 - m) / spread - 1, F.lit(1.0))).scalar()
    shrunk = (x + mean * strength) / (n + strength)
    return hosts.select("_host", "n", "x", shrunk.alias("fail_rate")).withColumn("host_bad", F.col("fail_rate") > host_rate)


def _judged(measured: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Adds `kept`: only the bad hosts are joined back."""
    bad = small_side(written(verdicts.where("host_bad").select(F.col("_host").alias("_bad"), F.lit(True).alias("_is_bad")), "bad-hosts"))
    out = measured.join(bad, F.col("_host").eqNullSafe(F.col("_bad")), "left")
    strict = F.coalesce(F.col("_is_bad"), F.lit(False)) & F.col("soft_failed")
    return out.withColumn("host_bad", F.coalesce("_is_bad", F.lit(False))).withColumn("kept", ~F.col("base_failed") & ~strict)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: counts, base_failed, soft_failed, host_bad, kept."""
    measured = written(measure(docs, text_col, source_col, [id_col]), "quality-measures")
    return _judged(measured, host_verdicts(measured)).select(
        F.col(f"_row.{id_col}").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "soft_failed", "host_bad", "kept")


def reject(docs: DataFrame, text_col: str = "text", source_col: str = "source") -> DataFrame:
    """`docs` without the rejected rows, same columns.

    The measured rows are written once: the rules run a single time for the host rates and the rows, and the
    `kept` filter isn't pushed into them.
    """
    measured = written(measure(docs, text_col, source_col), "quality-rows")
    return _judged(measured, host_verdicts(measured)).where("kept").select("_row.*")
