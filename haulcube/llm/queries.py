"""Registered queries of the training-data operators and their DuckDB oracles."""
from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from haulcube.session import scratch_dir

from . import conversations, decontaminate, line_dedup, oracles, packing, personal, quality_model, quality_rules, runs, secrets, simhash, substring, url_filter, warc
from .common import documents

#: (host, path, verdict)
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op3_line_dedup(spark, sf_dir):
    out = line_dedup.dedup_lines(documents(spark, sf_dir))
    return out.select(F.col("_row.doc_id").alias("doc_id"), "n_lines", "n_removed", F.sha2("new_text", 256).alias("kept_sha256"))


@query
def op5_quality_rules(spark, sf_dir):
    return quality_rules.judge(documents(spark, sf_dir))


@query
def op9_simhash(spark, sf_dir):
    return simhash.near_duplicates(documents(spark, sf_dir), shingle=3, max_bits=2)


@query
def op10_substring_dedup(spark, sf_dir):
    out = substring.drop_repeats(documents(spark, sf_dir))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query
def op7_packing(spark, sf_dir):
    out = packing.pack(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@query
def op1_decontamination(spark, sf_dir):
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


@query
def op8_secret_scan(spark, sf_dir):
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


@query
def op4_warc(spark, sf_dir):
    folder = scratch_dir(spark, "warc")
    manifest = warc.write_archives(spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet"), folder)
    rows = warc.read_archives(spark, folder, manifest, with_payload=False, whole=True).where("kind = 'record'")
    return rows.select(warc.page_number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                       warc.page_number("refers_to").alias("refers_to"))


@query
def op2_url_filter(spark, sf_dir):
    """Labels reach a url through the document number in its path."""
    pages = spark.read.parquet(f"{sf_dir.rstrip('/')}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")
    number = F.regexp_extract(F.coalesce("url", F.lit("")), r"://[^?#]*/(\d+)", 1).try_cast("long")
    labelled = pages.select("url", number.alias("doc_id")).join(labels, "doc_id").select("url", (F.col("quality") == 0).alias("bad"))
    out = url_filter.judge(pages, labelled, URL_RULES)
    return out.select(F.col("_row.page_id").alias("page_id"), "host", "path", "rule", "verdict")


@query
def op6_quality_classifier(spark, sf_dir):
    return quality_model.classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


@query
def op11_periodic_runs(spark, sf_dir):
    return runs.digest(runs.find_runs(runs.with_planted_repeats(documents(spark, sf_dir))))


@query
def op12_conversation_repair(spark, sf_dir):
    rows = conversations.with_planted_faults(spark.read.parquet(f"{sf_dir.rstrip('/')}/conversations.parquet"))
    return conversations.digest(conversations.repair(rows, kept_col="kept"))


@query
def op13_personal_data(spark, sf_dir):
    return personal.digest(personal.find_identifiers(documents(spark, sf_dir)))


ORACLES.update(
    op1_decontamination=oracles.OP1, op3_line_dedup=oracles.OP3, op4_warc=oracles.OP4, op5_quality_rules=oracles.OP5,
    op8_secret_scan=oracles.secrets_sql(secrets.RULES, secrets.BASE), op10_substring_dedup=oracles.OP10)
