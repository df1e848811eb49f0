"""Conversation structure repair over a suffix-shared automaton (operator 12).

A conversation is well formed if the initials of its roles read (s?(ua)+)?.  Rows may be kept (0), given the role user or
assistant (2), deleted (3) or an empty row of either role inserted anywhere (2).  Every row has at most one fault, the first
that holds: blank (no word), duplicate (role and text of an earlier row), truncated (the last character of a word is not
one of .!?).  Blank and duplicate rows must be deleted; a truncated row that stays costs 1 more.

Only the signature of a conversation matters for its repair: one letter a row, for its role and fault.  The distinct
signatures, read from the end, form an automaton whose nodes are the distinct suffixes; conversations that end alike share
its nodes.  Signatures are range-partitioned and sorted by their reverse, so each task walks its part of the automaton in depth-first
order and holds one path of it: per node and grammar state the cost to go and the first edit of the best audit
suffix, computed once.  All edits of a state have different initials and each leads to one node and state, so the
ASCII-least of the cheapest audits takes the least initial at every step.

A conversation's rows meet in one row of the result (its repaired text is one string), nothing else is gathered.

Defined results: a null role or text counts as one space, a null turn comes first, rows of equal turn are ordered by role and
text; a null conversation id is a conversation; conversations without rows have zeros, an empty audit and the hash of
the empty string; an empty table gives an empty result; extra columns are ignored.
"""
from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_table, written

SPACES = " \t\n\x0b\f\r"
#: Grammar states: nothing yet, after the system row, after a user row, after an assistant row.
BEGIN, SYSTEM, USER, ASSISTANT = range(4)
#: (state, initial) -> next state
MOVES = {(BEGIN, "s"): SYSTEM, (BEGIN, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
FINAL = (BEGIN, ASSISTANT)
#: The role that may be inserted or given in a state.
WANTED = ("user", "user", "assistant", "user")
INSERT, REROLE, DELETE, TRUNCATED = 2, 2, 3, 1
#: Signature letters: s, u, a or o (any other role), upper case if truncated, x for a row that must go.
GONE = "x"


def _node(letter: str | None, rest):
    """(cost, edit) per state: `rest` is the node of the remaining suffix, `letter` None its end."""
    out = [None] * 4
    for state in range(4):
        options = []
        if letter is None:
            if state in FINAL:
                options.append((0, ""))
        else:
            cut = TRUNCATED if letter.isupper() else 0
            options.append((rest[state][0] + DELETE, "D"))
            if letter != GONE:
                kept = MOVES.get((state, letter.lower()))
                if kept is not None:
                    options.append((rest[kept][0] + cut, "K"))
                options.append((rest[MOVES[state, WANTED[state][0]]][0] + cut + REROLE, "R"))
        out[state] = min(options, default=None)
    # inserts lead to another state of the same node; no cheapest repair needs more than two in a row
    for _ in range(3):
        for state in range(4):
            to = out[MOVES[state, WANTED[state][0]]]
            if to is not None:
                option = (to[0] + INSERT, "I")
                out[state] = option if out[state] is None else min(out[state], option)
    return out


def _repair(path: list, signature: str):
    """(cost, audit, rows): rows are (index of the original row or None, new role or None) of the repaired conversation."""
    state, i, audit, rows = BEGIN, 0, [], []
    cost = path[-1][BEGIN][0]
    while True:
        edit = path[len(signature) - i][state][1]
        if edit == "":
            return cost, "".join(audit), rows
        audit.append(edit)
        if edit == "D":
            i += 1
            continue
        role = None if edit == "K" else WANTED[state]
        rows.append((None if edit == "I" else i, role))
        state = MOVES[state, (role or signature[i].lower())[0]]
        i += edit != "I"


def repairs(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit, repaired: array of (row, role)) of distinct signatures."""
    ordered = signatures.select("signature", F.reverse("signature").alias("r")).repartitionByRange("r").sortWithinPartitions("r")

    def run(batches):
        path, last = [_node(None, None)], ""
        for batch in batches:
            sigs, cost, audit, rows = batch.column(0).to_pylist(), [], [], []
            for sig, back in zip(sigs, batch.column(1).to_pylist()):
                k = 0
                while k < len(last) and k < len(back) and last[k] == back[k]:
                    k += 1
                del path[k + 1:]
                for letter in back[k:]:
                    path.append(_node(letter, path[-1]))
                last = back
                c, a, r = _repair(path, sig)
                cost.append(c)
                audit.append(a)
                rows.append([{"row": i, "role": role} for i, role in r])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(cost, pa.int64()), pa.array(audit, pa.string()),
                 pa.array(rows, pa.list_(pa.struct([("row", pa.int32()), ("role", pa.string())])))], names=["signature", "cost", "audit", "repaired"])
    return ordered.mapInArrow(run, "signature string, cost long, audit string, repaired array<struct<row: int, role: string>>")


def with_planted_faults(rows: DataFrame) -> DataFrame:
    """`conv_id, turn, role, text` and `kept`, damaged by crc32(conv_id:turn) % 20 (nulls: one space).

    0 drops the row (kept is false), 1 empties the text, 2 removes its .!?, 3 repeats the row, 4 sets the role user.
    """
    def shown(c):
        return F.coalesce(F.col(c).cast("string"), F.lit(" "))
    m = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    text = F.when(F.col("m") == 1, F.lit("")).when(F.col("m") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    out = rows.select("conv_id", "turn", shown("role").alias("role"), shown("text").alias("text"), m.alias("m"))
    out = out.select("conv_id", "turn", F.when(F.col("m") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"), text.alias("text"), "m")
    return out.select("conv_id", "turn", "role", "text", (F.col("m") != 0).alias("kept"), F.explode(F.expr("if(m = 3, array(0, 1), array(0))")).alias("copy")).drop("copy")


def conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
                  kept_col: str | None = None) -> DataFrame:
    """One row per conversation: conv, rows (turn, role, text, initial, fault) in order, signature.

    Rows whose `kept_col` is false only name their conversation.
    """
    kept = F.col(kept_col) if kept_col else F.lit(True)
    src = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit(" ")).alias("role"),
                      F.coalesce(F.col(text_col), F.lit(" ")).alias("text"), kept.alias("kept")).repartition("conv")
    again = F.row_number().over(Window.partitionBy("conv", "kept", "role", "text").orderBy(F.col("turn").asc_nulls_first())) > 1
    trimmed = F.rtrim("text", F.lit(SPACES))
    fault = (F.when(trimmed == "", "blank").when(F.col("again"), "duplicate").when(~F.right(trimmed, F.lit(1)).isin(".", "!", "?"), "truncated"))
    initial = F.when(F.col("role") == "", F.lit(" ")).otherwise(F.left("role", F.lit(1)))
    src = src.withColumn("again", again).select("conv", "kept", "turn", "role", "text", initial.alias("initial"), fault.alias("fault"))
    held = F.when(F.col("kept"), F.struct("turn", "role", "text", "initial", "fault"))
    got = src.groupBy("conv").agg(F.sort_array(F.collect_list(held)).alias("rows"))

    def letter(r):
        role = F.when(r["initial"].isin("s", "u", "a"), r["initial"]).otherwise("o")
        return F.when(r["fault"].isin("blank", "duplicate"), GONE).when(r["fault"] == "truncated", F.upper(role)).otherwise(role)
    return got.withColumn("signature", F.array_join(F.transform("rows", letter), ""))


def repair(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
           kept_col: str | None = None) -> DataFrame:
    """One row per conversation: id, rows (before), gaps, blank, duplicate, truncated, illegal, cost, audit,
    repaired (array of role and text)."""
    table = written(conversations(rows, conv_col, turn_col, role_col, text_col, kept_col), "conversations")
    fixes = written(repairs(table.select("signature").distinct()), "conversation-repairs")
    joined = table.join(small_table(fixes), "signature")
    turns = F.filter(F.transform("rows", lambda r: r["turn"]), lambda t: t.isNotNull())
    gaps = F.coalesce(F.array_max(turns) - F.array_min(turns) + 1 - F.size(F.array_distinct(turns)), F.lit(0))
    steps = F.expr("filter(transform(rows, (r, i) -> if(i = 0, null, concat(rows[i - 1].initial, r.initial))), x -> x not in ('su', 'ua', 'au'))")

    def number(fault):
        return F.size(F.filter("rows", lambda r: r["fault"] == fault)).cast("long").alias(fault)
    repaired = F.expr("""transform(repaired, x -> named_struct('role', coalesce(x.role, get(rows, x.row).role),
                                                               'text', coalesce(get(rows, x.row).text, '')))""")
    return joined.select(F.col("conv").alias(conv_col), "rows", gaps.cast("long").alias("gaps"), number("blank"), number("duplicate"), number("truncated"),
                         F.size(steps).cast("long").alias("illegal"), "cost", "audit", repaired.alias("repaired"))


def digest(found: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    lines = F.transform("repaired", lambda x: F.concat(x["role"], F.lit(":"), x["text"]))
    return found.select(conv_col, "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                        F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
