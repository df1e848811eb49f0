"""URL filtering by association rules (operator 2).

Curated rules (host, path, verdict) come first: a rule fits its host and all subdomains if the url's path
starts with the rule's; the longest wins.  All other urls are judged by mined rules: every labelled url is
a transaction of its tokens and its label, FP-growth finds the frequent combinations, and rules
"tokens -> bad" are kept at `min_confidence`, a support of `min_support` of the transactions and `min_urls` urls, unless a
rule on fewer tokens is as confident.  Rules are matched through an inverted index: each rule is filed
under its rarest token, the token lists of the urls are joined on it, and the whole rule is then checked.

Tokens: the labels of the host and their parts between hyphens, path segments (numbers and the file name's
stem numbers left out), the extension and the names of query parameters.

Defined results: a null url, or one without "://", has empty host and path and no tokens, and is allowed
unless a rule has an empty host; labels with a null verdict are left out; without labels, or with one kind
only, nothing is mined; repeated rows are judged alike; extra columns are passed through by `judge`.
"""
from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_side, written

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BAD = "label=bad"
MIN_SUPPORT, MIN_CONFIDENCE = 0.002, 0.7
#: A rule rests on at least so many labelled urls and has at most so many tokens.
MIN_URLS, MAX_ITEMS = 5, 4


def host_and_path(url):
    """(host, path) columns of a url column."""
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)
    return F.translate(host, UPPER, LOWER), path


def curated(host, path, rules):
    """(rule, verdict) columns of the longest fitting rule; `rules` is a short list of (host, path, verdict)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for h, p, v in sorted(rules, key=lambda r: (len(r[0]) + len(r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, F.lit(h + p)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(url):
    """Sorted distinct tokens of a url column."""
    host, path = host_and_path(url)
    labels = F.split(host, r"\.")
    parts = F.flatten(F.transform(labels, lambda x: F.split(x, "-")))
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.split(query, "&"), lambda x: F.concat(F.lit("?"), F.regexp_extract(x, "^[^=]*", 0)))
    segments = F.transform(F.split(F.translate(path, UPPER, LOWER), r"[/.]"), lambda x: F.concat(F.lit("/"), x))
    all_of = F.concat(labels, parts, segments, names)
    return F.array_sort(F.array_distinct(F.filter(all_of, lambda x: ~x.rlike(r"^[/?]?\d*$"))))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS,
         max_items: int = MAX_ITEMS) -> DataFrame:
    """Written table (rule_id, items, key, confidence, support) of `labelled` (url, bad boolean).

    A rule holds on `min_urls` labelled urls at least and has at most `max_items` tokens.  Tokens on fewer urls leave the
    transactions, and of tokens that stand on exactly the same urls one stays, so that a url of many parameters spans no more sets than it must.
    """
    spark = labelled.sparkSession
    empty = spark.createDataFrame([], "rule_id long, items array<string>, key string, confidence double, support double")
    rows = labelled.where("bad is not null").select("bad", tokens(F.col("url")).alias("items")).where(F.size("items") > 0)
    rows = written(rows.withColumn("t", F.monotonically_increasing_id()), "url-transactions")
    if rows.select("bad").distinct().count() < 2:
        return empty
    flat = rows.select("t", "bad", F.explode("items").alias("item"))
    seen = flat.groupBy("item").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("t")).alias("a"), F.bit_xor(F.xxhash64("t", F.lit(1))).alias("b")).where(F.col("n") >= min_urls)
    # among tokens of the same urls the shortest stands for all
    seen = written(seen.groupBy("n", "a", "b").agg(F.min(F.struct(F.length("item").alias("l"), "item")).alias("m")).select("m.item", "n"), "url-tokens")
    items = flat.join(small_side(seen.select("item")), "item").groupBy("t").agg(F.collect_list("item").alias("items"), F.first("bad").alias("bad"))
    sets = written(items.select(F.when(F.col("bad"), F.array_append("items", BAD)).otherwise(F.col("items")).alias("items")), "url-sets")
    total, held = rows.count(), max(sets.count(), 1)
    model = FPGrowth(itemsCol="items", minSupport=max(min_support * total, min_urls) / held, minConfidence=min_confidence).fit(sets)
    rules = model.associationRules.where(F.array_contains("consequent", BAD) & (F.size("antecedent") <= max_items)).select(
        F.array_sort("antecedent").alias("items"), "confidence", F.round(F.col("support") * held).cast("long").alias("n"))
    # the rule itself, not only its antecedent, holds on min_urls bad urls
    rules = written(rules.where(F.col("n") >= min_urls).select("items", "confidence", (F.col("n") / total).alias("support")), "url-rules")
    # prune: a rule goes if a rule on a proper subset of its tokens (at most 2^max_items) is as confident
    less = rules.select("items", "confidence", F.explode(F.sequence(F.lit(1), F.shiftleft(F.lit(1), max_items) - 1)).alias("mask")).where("mask < shiftleft(1, size(items)) - 1")
    less = less.select("items", "confidence", F.expr("filter(items, (x, i) -> shiftright(mask, i) & 1 = 1)").alias("subset"))
    general = rules.select(F.col("items").alias("subset"), F.col("confidence").alias("c2"))
    beaten = less.join(general, "subset").where("c2 >= confidence").select("items").distinct()
    rules = rules.join(beaten, "items", "left_anti")
    # the index key is the rarest token among the transactions
    keys = (rules.select("items", F.explode("items").alias("item")).join(seen, "item").groupBy("items")
            .agg(F.min_by("item", F.struct("n", "item")).alias("key")))
    return written(rules.join(keys, "items").select(F.xxhash64("items").alias("rule_id"), "items", "key", "confidence", "support"), "url-index")


def blocked_token_sets(token_sets: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct token lists of `token_sets` (tokens) on which any mined rule matches."""
    index = small_side(index.select("items", "key"))
    return (token_sets.distinct().select("tokens", F.explode("tokens").alias("key")).join(index, "key")
            .where(F.size(F.array_except("items", "tokens")) == 0).select("tokens").distinct())


def judge(pages: DataFrame, labelled: DataFrame, rules, url_col: str = "url", min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE, min_urls: int = MIN_URLS, max_items: int = MAX_ITEMS) -> DataFrame:
    """(_row, host, path, rule, verdict) for every row; `_row` is the input row."""
    index = mine(labelled, min_support, min_confidence, min_urls, max_items)
    src = pages.select(F.struct(*pages.columns).alias("_row"), F.col(url_col).alias("u"))
    blocked = written(blocked_token_sets(src.select(tokens(F.col("u")).alias("tokens")), index), "url-blocked")
    host, path = host_and_path(F.col("u"))
    src = src.select("_row", host.alias("host"), path.alias("path"), tokens(F.col("u")).alias("tokens"))
    rule, verdict = curated(F.col("host"), F.col("path"), rules)
    out = src.join(small_side(blocked.withColumn("hit", F.lit(True))), "tokens", "left")
    mined = F.when(F.col("hit"), F.lit("block")).otherwise(F.lit("allow"))
    return out.select("_row", "host", "path", rule.alias("rule"), F.coalesce(verdict, mined).alias("verdict"))
