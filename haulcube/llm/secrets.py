"""Secret scan over an incremental blob ledger (operator 8), DataFrame functions only.

Every version of a path is content-addressed: its blob is the SHA-256 of the text.  The ledger is a table
of (blob, rule_version) pairs already scanned with their findings; a run scans each distinct blob whose
pair it has not seen once, appends to the ledger, and joins the findings back to all paths and versions
that hold the blob.

Rules (kind, pattern, least length and group it applies to) are matched leftmost and non-overlapping per
kind, then short matches are dropped.  Positions count code points: the pieces between the matches
(`split`) and the matches themselves add up to them, in a window over (blob, kind).

Defined results: a null text is the empty blob; repeated rows share the blob and are listed each; null
paths are kept, paths may have any type; a pair that stands in the ledger more than once counts once; empty tables give empty results; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from haulcube.session import scratch_dir

from .common import written

#: kind -> (pattern, group whose length counts, least length); the first three are the base rules.
RULES = {
    "assign": (r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 6),
    "access": (r"AKIA[A-Z0-9]{16,}", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
    "private_key": (r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 0),
    "github": (r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    "slack": (r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", 0, 0),
}
BASE = ("assign", "access", "hex")
RULE_VERSION = "1"
#: A text without this literal text (or class) has no match of the kind; a cheap test before the two passes.
HINTS = {"access": "AKIA", "private_key": "PRIVATE KEY", "github": "gh", "slack": "xox", "jwt": "eyJ"}


def _matches(text, kind: str):
    """Array of (gap, size, ok) of one kind: code points before the match, in it, and whether it is long enough."""
    pattern, group, least = RULES[kind]
    rx = F.lit(pattern)
    found = F.regexp_extract_all(text, rx, F.lit(0))
    gaps = F.split(text, pattern, -1)
    ok = (lambda m: F.length(m) >= least) if group == 0 else (lambda m: F.length(F.regexp_extract(m, pattern, group)) >= least)
    rows = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), F.length(m).alias("size"), ok(m).alias("ok")))
    test = text.rlike(pattern)
    if kind in HINTS:
        test = text.contains(HINTS[kind]) & test
    return F.when(test, rows)


def scan(blobs: DataFrame) -> DataFrame:
    """(blob, spans) of every row of `blobs` (blob, t) that has any span; spans are (start, rank, kind, end), sorted."""
    kinds = list(RULES)
    per_kind = F.array(*(F.struct(F.lit(r).alias("rank"), F.lit(k).alias("kind"), _matches(F.col("t"), k).alias("found")) for r, k in enumerate(kinds)))
    flat = (blobs.select("blob", F.monotonically_increasing_id().alias("row"), F.explode(per_kind).alias("x")).where(F.size("x.found") > 0)
            .select("row", "blob", "x.rank", "x.kind", F.posexplode("x.found").alias("i", "f")).select("row", "blob", "rank", "kind", "i", "f.*"))
    order = Window.partitionBy("blob", "row", "rank").orderBy("i")
    end = F.sum(F.col("gap") + F.col("size")).over(order)
    spans = flat.withColumn("end", end).where("ok").select("blob", F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "kind", "end").alias("s"))
    return spans.groupBy("blob").agg(F.sort_array(F.collect_set("s")).alias("spans"))


def _ledger(spark, path: str, schema: str) -> DataFrame:
    """The ledger's rows; an absent ledger is empty."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


LEDGER = "blob string, spans array<struct<start: bigint, rank: int, kind: string, end: bigint>>, rule_version string"


def update_ledger(versions: DataFrame, ledger_path: str, rule_version: str = RULE_VERSION) -> int:
    """Scan the blobs of `versions` (id, blob, t) that the ledger lacks for this rule version; number of new blobs."""
    spark = versions.sparkSession
    known = _ledger(spark, ledger_path, LEDGER).where(F.col("rule_version") == rule_version).select("blob")
    # one version stands for each unseen blob
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("")).alias("key")
    unseen = versions.select(key, "blob").groupBy("blob").agg(F.min("key").alias("key")).join(known, "blob", "left_anti")
    unseen = written(unseen, "secret-unseen")
    n = unseen.count()
    if n:
        texts = versions.select(key, "blob", "t").join(unseen, ["blob", "key"])
        found = scan(texts.select("blob", "t"))
        unseen.select("blob").join(found, "blob", "left").select("blob", "spans", F.lit(rule_version).alias("rule_version")).write.mode("append").parquet(ledger_path)
    return n


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", ledger_path: str | None = None,
                 rule_version: str = RULE_VERSION) -> DataFrame:
    """One row per document version: id, blob, spans (start, rank, kind, end)."""
    spark = docs.sparkSession
    ledger_path = ledger_path or scratch_dir(spark, "secret-ledger")
    text = F.coalesce(F.col(text_col), F.lit(""))
    versions = docs.select(F.col(id_col).alias("id"), F.sha2(text, 256).alias("blob"), text.alias("t"))
    update_ledger(versions, ledger_path, rule_version)
    paths = versions.select("id", "blob")
    known = _ledger(spark, ledger_path, LEDGER).where((F.col("rule_version") == rule_version) & F.col("spans").isNotNull()).select("blob", "spans")
    known = known.dropDuplicates(["blob"])  # two runs at once may both have appended a pair
    empty = F.array().cast("array<struct<start: bigint, rank: int, kind: string, end: bigint>>")
    return paths.join(known, "blob", "left").select(F.col("id").alias(id_col), "blob", F.coalesce("spans", empty).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    def number(rank):
        return F.size(F.filter("spans", lambda s: s["rank"] == rank)).cast("long")
    counts = [number(r).alias(f"n_{k}") for r, k in enumerate(BASE)]
    return found.select(id_col, *counts, F.sha2(joined(F.filter("spans", lambda s: s["rank"] < len(BASE))), 256).alias("base_sha256"),
                        joined(F.col("spans")).alias("spans"))
