"""Readers and writers.

Every writer is a distributed Spark write (one file per task); every reader is
a lazy scan with an explicit schema.  JSON payloads (S12, S13) are documents
of bounded size: a large layer is written as many FeatureCollections, one per
bucket, so no single task or driver ever holds the whole layer.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.clean import RAW_COLUMNS, lenient_number

RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])
SENTINEL = "_extra"
RAW_SCHEMA_SENTINEL = T.StructType(RAW_SCHEMA.fields + [T.StructField(SENTINEL, T.StringType())])


def read_raw_csv(spark: SparkSession, path: str, header: bool = False, strict: bool = False) -> DataFrame:
    """S1 (+N1-N3): all fields as strings, PERMISSIVE; then lenient numeric casts.

    With ``header`` the ten columns are taken by their names in the file header, whatever
    their order and whatever else the file holds (an absent one is null); without, by position.
    Short lines are null-padded, over-long lines keep their first fields; with
    ``strict`` the over-long ones are dropped (a trailing sentinel column catches them).
    """
    schema = RAW_SCHEMA_SENTINEL
    if header:
        names = spark.read.option("header", True).csv(path).columns
        schema = T.StructType([T.StructField(c, T.StringType()) for c in names] + [T.StructField(SENTINEL, T.StringType())])
    df = (spark.read.schema(schema).option("header", header).option("mode", "PERMISSIVE")
          .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False)
          .csv(path))
    absent = [c for c in RAW_COLUMNS if c not in df.columns]
    return typed_raw(df.withColumns({c: F.lit(None).cast("string") for c in absent}) if absent else df, strict)


def typed_raw(df: DataFrame, strict: bool = False) -> DataFrame:
    """Lenient typing of an all-string raw frame (batch or streaming)."""
    if strict:
        df = df.filter(F.col(SENTINEL).isNull())
    return df.select(*[c for c in RAW_COLUMNS if c not in ("Material_Type_Code", "Tons_Collected", "Net_Weight")],
                     lenient_number("Material_Type_Code", "int").alias("Material_Type_Code"),
                     lenient_number("Tons_Collected", "double").alias("Tons_Collected"),
                     lenient_number("Net_Weight", "double").alias("Net_Weight")).select(*RAW_COLUMNS)


def write_lines(df: DataFrame, line: F.Column, path: str) -> str:
    df.select(line.alias("value")).write.mode("overwrite").text(path)
    return path


def write_parquet(df: DataFrame, path: str, partition_by=None) -> str:
    """Parquet, optionally partitioned (e.g. by year for pruning)."""
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*([partition_by] if isinstance(partition_by, str) else partition_by))
    w.parquet(path)
    return path


def write_csv(df: DataFrame, path: str) -> str:
    """CSV with header, one file per task."""
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def read_csv(spark: SparkSession, path: str, schema) -> DataFrame:
    """CSV with header and explicit schema; globs allowed in `path`."""
    return spark.read.schema(schema).option("header", True).csv(path)


def hash_sample(df: DataFrame, key: F.Column, percent: int = 10) -> DataFrame:
    """S4 (repeatable, engine-portable): keep rows whose md5-derived bucket < percent."""
    b = F.conv(F.substring(F.md5(key.cast("string")), 1, 8), 16, 10).cast("long") % 100
    return df.filter(b < percent)


# ---------------------------------------------------------------- GeoJSON
def polygons_to_geojson(df: DataFrame, id_col: str, props, rings: str = "rings",
                        features_per_doc: int = 5000) -> DataFrame:
    """Polygon rows -> FeatureCollection JSON documents of bounded size (one per bucket)."""
    coords = F.transform(F.col(rings), lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"])))
    feat = F.struct(F.lit("Feature").alias("type"),
                    F.struct(*[F.col(c) for c in [id_col] + list(props)]).alias("properties"),
                    F.struct(F.lit("Polygon").alias("type"), coords.alias("coordinates")).alias("geometry"))
    n = df.count()
    buckets = max(1, -(-n // features_per_doc))
    b = df.select(F.pmod(F.xxhash64(F.col(id_col)), F.lit(buckets)).alias("_b"), feat.alias("f"))
    docs = b.groupBy("_b").agg(F.struct(F.lit("FeatureCollection").alias("type"),
                                        F.collect_list("f").alias("features")).alias("doc"))
    return docs.select(F.to_json("doc").alias("value"), "_b")


def write_geojson(df: DataFrame, path: str, id_col: str, props, rings: str = "rings") -> str:
    docs = polygons_to_geojson(df, id_col, props, rings)
    docs.repartition(F.col("_b")).drop("_b").write.mode("overwrite").text(path)
    return path


def read_geojson(spark: SparkSession, path: str, id_col: str, props: dict, multi_line: bool = False) -> DataFrame:
    """FeatureCollections -> (id, props..., rings ARRAY<ARRAY<STRUCT<x,y>>>).

    One collection per line, any number of lines per file; ``multi_line`` reads files that hold a
    single collection over many lines (nothing after it would be read).
    """
    prop_schema = ", ".join([f"{id_col}: string"] + [f"{k}: {v}" for k, v in props.items()])
    schema = (f"type string, features array<struct<type: string, properties: struct<{prop_schema}>, "
              "geometry: struct<type: string, coordinates: array<array<array<double>>>>>>")
    raw = spark.read.schema(schema).option("multiLine", multi_line).json(path)
    f = raw.select(F.explode("features").alias("f"))
    rings = F.transform(F.col("f.geometry.coordinates"),
                        lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return f.select(F.col(f"f.properties.{id_col}").alias(id_col),
                    *[F.col(f"f.properties.{k}").alias(k) for k in props], rings.alias("rings"))


# ------------------------------------------------------- header + rows JSON
def header_rows_table(payload: DataFrame, body: str = "body", columns=None) -> DataFrame:
    """S13: '[["h1","h2",...], [v1, v2, ...], ...]' documents -> rows with named columns.

    Position 0 of each document is its header; fields are matched to names by
    position, so header order may differ between documents.
    """
    arr = payload.select(F.monotonically_increasing_id().alias("_doc"),
                         F.from_json(F.col(body), "array<array<string>>").alias("_a"))
    rows = arr.select("_doc", F.col("_a")[0].alias("_h"), F.posexplode("_a").alias("_r", "_v")).filter(F.col("_r") > 0)
    names = columns or []
    return rows.select(*[F.try_element_at(F.col("_v"), F.array_position(F.col("_h"), F.lit(c)).cast("int")).alias(c)
                         for c in names])
