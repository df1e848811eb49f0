"""Personal data by bootstrapped contextual extraction (operator 13).

Base kinds (email, ip, card, phone) are found by their forms and checks; they are the seeds.  Other strings of a like form are
candidates: number chains and dotted numbers that fail the checks, words with an `@`.  Every occurrence has up to three lexical
patterns: the two words before, the word on either side, the two words after (lower case, digits as 0, no marks at the ends).

Patterns and instances (distinct values) form a bipartite graph, scored in rounds by Spark: a pattern's confidence in a kind is
the weight of its instances of that kind against those of other kinds, of no fitting form or unknown; an instance's score is the noisy-or
of its confident patterns, seeds stay at 1.  Patterns of `min_support` instances with a confidence of `least` or more discover
the candidates that they stand around, and these support further patterns in the next round.

Patterns with fewer than `min_support` distinct instances can't become confident and leave the graph first.  Texts are read
once; what is kept of them are spans and the contexts of the candidates.  Instances are distinct values, so copies of a text count once.

Positions count code points, ends are exclusive.  A context reaches `CONTEXT` code points to either side.  All searches take time linear in the text.

Defined results: a null or empty text has no spans; rows are judged by themselves, so null ids, ties and repeated rows are kept; an empty
table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_table, written

KINDS = ("email", "ip", "card", "phone")
CONTEXT = 100
MIN_SUPPORT, LEAST, ROUNDS = 4, 0.8, 4
#: Weight of an instance of unknown kind against a pattern, and of the prior.
UNKNOWN, PRIOR = 0.2, 0.5

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_WORD = re.compile(r"[^ \t-\r]+")
_MARKS = ".,;:!?()[]{}\"'<>|"
_ZERO = str.maketrans("123456789", "0" * 9)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        x = int(d) * (1 + k % 2)
        total += x - 9 * (x > 9)
    return total % 10 == 0


def _emails(t: str):
    """The local part is the run of its characters before an `@`; linear, unlike a search by expression."""
    end, at = 0, t.find("@")
    while at >= 0:
        a = at
        while a > end and t[a - 1] in _LOCAL:
            a -= 1
        m = _DOMAIN.match(t, at + 1) if a < at else None
        if m:
            end = m.end()
            yield a, end, True
        at = t.find("@", m.end() if m else at + 1)


def _addresses(t: str):
    for m in _DOTTED.finditer(t):
        if t.count(".", m.start(), m.end()) < 3:
            continue
        parts = [(p.start() + m.start(), p.end() + m.start(), p.group()) for p in re.finditer("[0-9]+", m.group())]
        for k in range(0, len(parts) - 3, 4):
            held = parts[k:k + 4]
            yield held[0][0], held[3][1], all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for _, _, x in held)


def _cards(t: str):
    for m in _CARD.finditer(t):
        digits = m.group().replace(" ", "").replace("-", "")
        yield m.start(), m.end(), 16 <= len(digits) <= 19 and luhn(digits)


def _phones(t: str):
    for m in _PHONE.finditer(t) if "+" in t else ():
        yield m.start(), m.end(), 8 <= sum(map(m.group().count, "0123456789")) <= 15


def base_spans(t: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """((kind's rank, start, end) by rank, then start; matches that fail their check)."""
    good, bad = [], []
    for rank, find in enumerate((_emails, _addresses, _cards, _phones)):
        for a, b, ok in find(t):
            if ok:
                good.append((rank, a, b))
            else:
                bad.append((a, b))
    return good, bad


def fitting(value: str) -> int:
    """Bit mask of the kinds whose form the string resembles."""
    if "@" in value:
        return 1
    if value.count(".") >= 3:
        return 2
    n = sum(map(value.count, "0123456789"))
    return 4 * (12 <= n <= 19) + 8 * (6 <= n <= 15)


def candidates(t: str, good, bad) -> list[tuple[int, int]]:
    """Spans of a like form that overlap no base span; a chain of digits next to a letter is none."""
    spans = {(a, b) for a, b in bad if fitting(t[a:b]) and not (t[a - 1:a].isalnum() or t[b:b + 1].isalnum())}
    at, end = t.find("@"), 0
    while at >= 0:
        a = max(end, *(t.rfind(c, end, at) + 1 for c in " \t\n\x0b\f\r"))
        m = _WORD.match(t, a)
        end = m.end()
        word = t[a:end].rstrip(_MARKS)
        b = a + len(word)
        a = b - len(word.lstrip(_MARKS))
        if b - a > 2:
            spans.add((a, b))
        at = t.find("@", end)
    out, taken, k = [], sorted((a, b) for _, a, b in good), 0
    for a, b in sorted(spans):
        while k < len(taken) and taken[k][1] <= a:
            k += 1
        if (k == len(taken) or taken[k][0] >= b) and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


def _side(words: list[str], k: int) -> str | None:
    words = [w for w in words if w][:k] if k > 0 else [w for w in words if w][k:]
    return " ".join(words).lower().translate(_ZERO) if len(words) == abs(k) else None


def patterns(t: str, a: int, b: int) -> list[str]:
    before = [w.strip(_MARKS) for w in _WORD.findall(t[max(0, a - CONTEXT):a])]
    after = [w.strip(_MARKS) for w in _WORD.findall(t[b:b + CONTEXT])]
    left, right = _side(before, -1), _side(after, 1)
    out = [(_side(before, -2), "{} _"), (left and right and f"{left} _ {right}", "{}"), (_side(after, 2), "_ {}")]
    return [form.format(x) for x, form in out if x]


SPAN = pa.struct([("rank", pa.int32()), ("start", pa.int64()), ("end", pa.int64())])
SEEN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("known", pa.int32()), ("fits", pa.int32()), ("patterns", pa.list_(pa.string()))])
SCHEMA = ("base array<struct<rank: int, start: long, end: long>>, "
          "seen array<struct<start: long, end: long, value: string, known: int, fits: int, patterns: array<string>>>")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base, seen): base spans and all instances with their patterns; `known` is the rank of a seed's kind."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                rows = batch.slice(at, 1024)
                base, seen = [], []
                for value in rows.column(1):
                    t = value.as_py() or ""
                    good, bad = base_spans(t)
                    held = [(a, b, rank) for rank, a, b in good] + [(a, b, None) for a, b in candidates(t, good, bad)]
                    base.append([{"rank": r, "start": a, "end": b} for r, a, b in good])
                    seen.append([{"start": a, "end": b, "value": t[a:b].lower(), "known": r, "fits": fitting(t[a:b]), "patterns": patterns(t, a, b)} for a, b, r in held])
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(base, pa.list_(SPAN)), pa.array(seen, pa.list_(SEEN))], names=["id", "base", "seen"])
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, {SCHEMA}")


def graph(seen: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """Edges (pattern, value, known, fits) of patterns with at least `min_support` distinct values."""
    rows = seen.select(F.explode("seen").alias("x")).select("x.value", "x.known", "x.fits", F.explode("x.patterns").alias("pattern"))
    edges = written(rows.groupBy("pattern", "value").agg(F.min("known").alias("known"), F.max("fits").alias("fits")), "pii-edges")
    enough = written(edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).select("pattern"), "pii-patterns")
    return written(edges.join(small_table(enough), "pattern"), "pii-graph")


def confident_patterns(edges: DataFrame, min_support: int = MIN_SUPPORT, least: float = LEAST, rounds: int = ROUNDS) -> DataFrame:
    """(pattern, rank, confidence, support) of the patterns that are confident after the rounds; rounds end early when nothing changes."""
    # seeds of any occurrence; a value that is a seed of two kinds counts as the first
    scores = written(edges.groupBy("value").agg(F.min("known").alias("rank")).where("rank is not null").select("value", "rank", F.lit(1.0).alias("score")), "pii-scores")
    ranks = F.explode(F.array(*map(F.lit, range(len(KINDS))))).alias("k")
    held, before = None, None
    for _ in range(rounds):
        known = edges.select("pattern", "value", "fits").join(small_table(scores), "value", "left")
        sums = known.groupBy("pattern").agg(
            F.count("*").alias("n"), *(F.sum(F.when(F.col("rank") == k, F.col("score"))).alias(f"w{k}") for k in range(len(KINDS))),
            *(F.count(F.when(F.col("rank") == k, 1)).alias(f"c{k}") for k in range(len(KINDS))),
            # unknown, but of a fitting form
            *(F.count(F.when(F.col("rank").isNull() & (F.col("fits").bitwiseAND(1 << k) > 0), 1)).alias(f"u{k}") for k in range(len(KINDS))))
        per = F.array(*(F.struct(F.coalesce(F.col(f"w{k}"), F.lit(0.0)).alias("w"), F.col(f"c{k}").alias("c"), F.col(f"u{k}").alias("u")) for k in range(len(KINDS))))
        per_kind = sums.select("pattern", "n", per.alias("per"), ranks).select("pattern", "n", "k", F.get("per", F.col("k")).alias("x"))
        against = (F.col("n") - F.col("x.c") - F.col("x.u")) + UNKNOWN * F.col("x.u") + (F.col("x.c") - F.col("x.w")) + PRIOR
        confidence = F.col("x.w") / (F.col("x.w") + against)
        held = written(per_kind.select("pattern", F.col("k").alias("rank"), confidence.alias("confidence"), F.col("x.c").alias("support"))
                       .where((F.col("support") >= min_support) & (F.col("confidence") >= least)), "pii-confident")
        found = edges.where("known is null").join(small_table(held), "pattern").where("fits & shiftleft(1, rank) > 0")
        found = found.groupBy("value", "rank").agg((1 - F.exp(F.sum(F.log(1 - F.col("confidence"))))).alias("score"))
        found = found.groupBy("value").agg(F.max_by("rank", F.struct("score", -F.col("rank"))).alias("rank"), F.max("score").alias("score"))
        new = scores.where("score = 1.0").unionByName(found.join(scores.where("score = 1.0").select("value"), "value", "left_anti"))
        scores = written(new, "pii-scores")
        now = scores.agg(F.count("*"), F.round(F.sum("score"), 9)).first()
        if now == before:
            break
        before = now
    return held


def find_identifiers(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, least: float = LEAST,
                     rounds: int = ROUNDS) -> DataFrame:
    """One row per document: id, spans (rank of the kind, start, end, base, pattern that discovered it), by kind, then start."""
    table = written(scan(docs, id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "pii-seen")
    strong = confident_patterns(graph(table, min_support), min_support, least, rounds)
    open_ = table.select("row", F.explode(F.filter("seen", lambda x: x["known"].isNull())).alias("x"))
    open_ = open_.select("row", "x.start", "x.end", "x.fits", F.explode("x.patterns").alias("pattern"))
    hits = open_.join(small_table(strong), "pattern").where("fits & shiftleft(1, rank) > 0")
    best = hits.groupBy("row", "start", "end").agg(F.max(F.struct("confidence", (-F.col("rank")).alias("rank"), "pattern")).alias("b"))
    span = F.struct((-F.col("b.rank")).alias("rank"), "start", "end", F.lit(False).alias("base"), F.col("b.pattern").alias("pattern"))
    more = best.select("row", span.alias("s")).groupBy("row").agg(F.collect_list("s").alias("more"))
    base = F.transform("base", lambda s: F.struct(s["rank"].alias("rank"), s["start"].alias("start"), s["end"].alias("end"), F.lit(True).alias("base"), F.lit(None).cast("string").alias("pattern")))
    out = table.select("row", "id", base.alias("base")).join(more, "row", "left")
    return out.select(F.col("id").alias(id_col), F.sort_array(F.when(F.col("more").isNull(), F.col("base")).otherwise(F.concat("base", "more"))).alias("spans"))


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts of the base kinds, the hash of the base spans and all spans as text."""
    names = F.array(*map(F.lit, KINDS))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["base"])

    def number(rank):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["rank"] == rank))).cast("long")
    counts = [number(r).alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return found.select(id_col, *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
