"""Incremental ingestion of raw load files with Structured Streaming.

The original pipeline reads one large CSV in fixed-size chunks and cleans each
chunk independently.  On Spark the same shape is a file-source stream: every
micro-batch is a set of new files, the cleaning is stateless per row, and the
sink appends year-partitioned parquet.  ``availableNow`` processes everything
present and stops, which is how a batch backfill runs; without it the same
query keeps ingesting files as they land.  Progress lives in the checkpoint,
so a lost executor or a restarted driver resumes without duplicates.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import DATE_FORMATS, RAW_COLUMNS, clean_loads, reject_reason
from ..sources.io import RAW_SCHEMA_SENTINEL, SENTINEL, typed_raw

LINE = "_line"


def raw_stream(spark: SparkSession, src: str, header: bool = False, strict: bool = False,
               max_files_per_trigger: int | None = None) -> DataFrame:
    r = (spark.readStream.schema(RAW_SCHEMA_SENTINEL).option("header", header)
         .option("mode", "PERMISSIVE").option("ignoreLeadingWhiteSpace", False)
         .option("ignoreTrailingWhiteSpace", False))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return typed_raw(r.csv(src), strict)


def ingest(spark: SparkSession, src: str, out: str, checkpoint: str, available_now: bool = True,
           max_files_per_trigger: int | None = None, timeout_s: int | None = None):
    """Clean every new raw file into `out` (parquet partitioned by year)."""
    clean = clean_loads(raw_stream(spark, src, max_files_per_trigger=max_files_per_trigger))
    w = (clean.writeStream.format("parquet").outputMode("append")
         .option("checkpointLocation", checkpoint).partitionBy("year"))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    q = w.start(out)
    if available_now:
        q.awaitTermination(timeout_s)
    return q


def raw_line_stream(spark: SparkSession, src: str, header: bool = False, names=None,
                    max_files_per_trigger: int | None = None) -> DataFrame:
    """Raw text fields, matched by name, with `_line` (the line where its field count is wrong) and `source_file`.

    With ``header`` the names are those of the files in `src` at the start (or `names`); a file
    whose header differs fails the stream instead of being read into other columns.
    """
    if names is None:
        names = spark.read.option("header", True).csv(src).columns if header else RAW_COLUMNS
    schema = T.StructType([T.StructField(c, T.StringType()) for c in [*names, LINE]])
    r = (spark.readStream.schema(schema).option("header", header).option("enforceSchema", not header).option("mode", "PERMISSIVE")
         .option("columnNameOfCorruptRecord", LINE).option("columnPruning", False)
         .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False))
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    df = r.csv(src).withColumn("source_file", F.col("_metadata.file_path"))
    # a wrong line is parsed once more, with one field more: that field is set where the line is too long
    wide = ", ".join(f"`{c}` string" for c in [*names, SENTINEL])
    extra = F.from_csv(F.col(LINE), wide, {"mode": "PERMISSIVE"})[SENTINEL]
    absent = {c: F.lit(None).cast("string") for c in RAW_COLUMNS if c not in names}
    return df.withColumns(absent).select(*RAW_COLUMNS, LINE, (F.col(LINE).isNotNull() & extra.isNotNull()).alias("_too_long"), "source_file")


def ingest_split(spark: SparkSession, src: str, out: str, rejected: str, checkpoint: str, header: bool = False, names=None,
                 date_formats=DATE_FORMATS, max_files_per_trigger: int | None = None, timeout_s: int | None = None):
    """Clean every new raw file into `out` and write each dropped line with its reason to `rejected`.

    Every micro-batch fills its own folders (batch_id=N) in both tables and overwrites them when it is run again, so a
    restart in the middle of a batch adds and loses nothing; rows kept + rows rejected = rows read.
    """
    def write(batch: DataFrame, batch_id: int):
        rows = reject_reason(batch, date_formats, F.col("_too_long")).persist()
        try:
            kept = clean_loads(typed_raw(rows.where("reason is null")), date_formats)
            kept.write.mode("overwrite").partitionBy("year").parquet(f"{out}/batch_id={batch_id}")
            (rows.where("reason is not null").drop("_too_long")
             .write.mode("overwrite").parquet(f"{rejected}/batch_id={batch_id}"))
        finally:
            rows.unpersist()
    lines = raw_line_stream(spark, src, header, names, max_files_per_trigger)
    q = lines.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination(timeout_s)
    return q
