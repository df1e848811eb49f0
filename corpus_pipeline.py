"""Corpus pipeline over `documents`: quality rules -> line dedup -> near-dedup -> decontamination -> packing.

Each stage takes (spark, docs, sf_dir), works on every row its predecessor kept and returns the columns of
`documents`; the last returns one row per packed piece.  Stages are written as Parquet and read again.
Packing depends on how rows are dealt to tasks, so there is no SQL for the result; the tests hold it
against brute force.
"""
from __future__ import annotations

import public_tokenizers

from haulcube.llm import decontaminate, line_dedup, packing, quality_rules, simhash
from haulcube.llm.common import documents, written


def quality(spark, docs, sf_dir):
    """Documents that the quality rules reject go."""
    return quality_rules.reject(docs)


def lines(spark, docs, sf_dir):
    """Repeated lines go; emptied documents stay with an empty text."""
    return line_dedup.without_repeated_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each SimHash group stays."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item go."""
    items = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return decontaminate.drop_contaminated(docs, items)


def pack(spark, docs, sf_dir):
    """Pieces of sequences of at most 2048 tokens, with their ids."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality_rules", quality), ("line_dedup", lines), ("simhash_near_dedup", near_dedup),
          ("decontamination", decontamination), ("packing", pack)]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
