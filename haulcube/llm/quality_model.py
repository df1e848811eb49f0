"""Quality classifier as a sparse rule ensemble (operator 6).

Statistics of every whole text are Spark column expressions.  A small random forest is fitted to the
labelled rows; every path from a root becomes a conjunctive rule over the statistics, a lasso logistic
regression weighs the rules, and the rules with a weight are compiled into one Spark column expression.

Training rows: those with a label whose crc32(id as text) mod 3 is not 1, at most about `max_train` of
them (by a hash of the id; the statistics, the rules and the scores cover all rows).  Language, source,
id and labels are never inputs of a score.

Defined results: null and empty texts get the statistics zero and a score like any other; null labels are
left out; repeated rows score alike; without labels of both kinds the score is the share of label 1
(0.5 without labels); empty tables give empty results; extra columns are ignored.
"""
from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD_CLASS, words_col, written

UPPER, DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
SYMBOLS, MARKS, STOPS = "#*$%&|<>", "!?", ".,;:"
FEATURES = ["n_words", "mean_word", "symbols", "marks", "stops", "upper", "digits", "distinct", "dup_lines", "line_words", "repeats", "short_words"]
MAX_TRAIN = 50_000


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, one double per name in FEATURES) for every row."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    w = base.select("id", "t", words_col(F.col("t")).alias("w"))
    t, length = F.col("t"), F.length("t")
    n = F.greatest(F.size("w"), F.lit(1))

    def share(chars, by):
        return (length - F.length(F.translate(t, chars, ""))) / by
    lines = w.select("*", F.filter(F.split(t, "\n"), lambda x: x.rlike(WORD_CLASS)).alias("l"),
                     F.length(F.translate(t, " \t\n\x0b\x0c\r", "")).alias("chars"))
    c, m = F.greatest(F.col("chars"), F.lit(1)), F.greatest(F.size("l"), F.lit(1))
    # neighbours that are equal: words repeated in a row
    repeats = F.size(F.filter(F.arrays_zip(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))).alias("a"), F.slice("w", 2, F.greatest(F.size("w") - 1, F.lit(0))).alias("b")),
                              lambda x: x["a"] == x["b"]))
    out = {"n_words": F.log1p(F.size("w").cast("double")), "mean_word": F.col("chars") / n, "symbols": share(SYMBOLS, n), "marks": share(MARKS, n),
           "stops": share(STOPS, n), "upper": share(UPPER, c), "digits": share(DIGITS, c), "distinct": F.size(F.array_distinct("w")) / n,
           "dup_lines": (F.size("l") - F.size(F.array_distinct("l"))) / m, "line_words": F.log1p(F.size("w") / m), "repeats": repeats / n,
           "short_words": F.size(F.filter("w", lambda x: F.length(x) <= 2)) / n}
    return lines.select("id", *(out[k].cast("double").alias(k) for k in FEATURES))


def paths(forest) -> list[tuple]:
    """Distinct conjunctions ((feature, low, high), ...) of all nodes below the roots: low < x <= high per feature."""
    found = set()

    def walk(node, box):
        if box:
            found.add(tuple(sorted((f, a, b) for f, (a, b) in box.items())))
        if node.getClass().getSimpleName() == "InternalNode":
            split = node.split()
            f, x = split.featureIndex(), split.threshold()
            a, b = box.get(f, (float("-inf"), float("inf")))
            walk(node.leftChild(), {**box, f: (a, min(b, x))})
            walk(node.rightChild(), {**box, f: (max(a, x), b)})
    for tree in forest.trees:
        walk(tree._java_obj.rootNode() if hasattr(tree, "_java_obj") and tree._java_obj is not None else tree._call_java("rootNode"), {})
    return sorted(found)


def condition(rule):
    """A conjunctive rule as a boolean column."""
    out = F.lit(True)
    for f, a, b in rule:
        x = F.col(FEATURES[f])
        if a > float("-inf"):
            out = out & (x > a)
        if b < float("inf"):
            out = out & (x <= b)
    return out


def training_rows(stats: DataFrame, labels: DataFrame, id_col: str = "doc_id", label_col: str = "quality", max_train: int = MAX_TRAIN) -> DataFrame:
    """Statistics and label of the rows that may be learned from, about `max_train` at most."""
    fold = F.crc32(F.col("id").cast("string")) % 3
    given = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("double").alias("label")).where("label is not null and id is not null").where(fold != 1)
    n = given.count()
    if n > max_train:
        given = given.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * max_train / n))
    return stats.join(given, "id")


class RuleEnsemble:
    """Fitted rules and weights; `score()` is a column expression over the statistics."""

    def __init__(self, rules, weights, intercept):
        self.rules, self.weights, self.intercept = rules, weights, intercept

    def score(self):
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(condition(rule), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit(train: DataFrame, trees: int = 12, depth: int = 3, penalty: float = 0.001, seed: int = 7) -> RuleEnsemble:
    train = written(train.select(*FEATURES, "label"), "rule-train")
    counts = {r.label: r["count"] for r in train.groupBy("label").count().collect()}  # two classes
    if len(counts) < 2:
        only = next(iter(counts), None)
        return RuleEnsemble([], [], 0.0 if only is None else (20.0 if only else -20.0))
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, seed=seed, subsamplingRate=0.7, featureSubsetStrategy="onethird", maxBins=64).fit(
        train.select(array_to_vector(F.array(*FEATURES)).alias("features"), "label"))
    rules = paths(forest)
    table = written(train.select(array_to_vector(F.array(*(condition(r).cast("double") for r in rules))).alias("features"), "label"), "rule-matrix")
    lasso = LogisticRegression(elasticNetParam=1.0, regParam=penalty, maxIter=60, standardization=True).fit(table)
    kept = [(r, w) for r, w in zip(rules, lasso.coefficients.toArray()) if w]
    return RuleEnsemble([r for r, _ in kept], [w for _, w in kept], lasso.intercept)


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **kw) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    stats = written(statistics(docs, id_col, text_col), "rule-statistics")
    model = fit(training_rows(stats, labels, id_col, label_col), **kw)
    score = stats.select(F.col("id").alias(id_col), F.coalesce(F.crc32(F.col("id").cast("string")) % 3 == 1, F.lit(False)).alias("held_out"),
                         model.score().alias("score"))
    return score.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
