"""Polygon layers derived from the given tables (no geometry files exist).

Sections: one square per distinct normalised section code of the suppliers
(a gap-free 10-wide grid with exact shared vertices); population = sum of
the suppliers' account balances.  Tracts: one rectangle per customer,
every other one clockwise.
Rings are ARRAY<ARRAY<STRUCT<x DOUBLE, y DOUBLE>>>, outer ring first, closed.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.codes import DROP_SECTIONS, normalise_code
from .analogue import SECTION_PREFIX, _pick
from .tables import table


def rect_ring(x0: Column, y0: Column, w, h) -> Column:
    """Closed counter-clockwise rectangle ring wrapped as a one-ring polygon."""
    def pt(x, y):
        return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))
    x1, y1 = x0 + w, y0 + h
    return F.array(F.array(pt(x0, y0), pt(x1, y0), pt(x1, y1), pt(x0, y1), pt(x0, y0)))


def supplier_sections(spark: SparkSession, sf: str) -> DataFrame:
    """(s_suppkey, Section_Code normalised, s_acctbal) by the analogue's rule."""
    sup = table(spark, sf, "supplier")
    nk = F.col("s_nationkey")
    raw = F.when(F.col("s_suppkey") % 53 == 0, F.lit("AFFBK")).otherwise(
        F.concat(_pick(SECTION_PREFIX, nk % 9), F.lpad(nk.cast("string"), 2, "0"),
                 (F.col("s_suppkey") % 5 + 1).cast("string")))
    return sup.select("s_suppkey", normalise_code(raw).alias("Section_Code"), "s_acctbal")


def section_layer(spark: SparkSession, sf: str) -> DataFrame:
    s = supplier_sections(spark, sf).filter(~F.col("Section_Code").isin(*DROP_SECTIONS))
    per = s.groupBy("Section_Code").agg(F.sum("s_acctbal").alias("population"))
    # global order over the distinct section list only (bounded by the code domain)
    per = per.withColumn("_i", F.dense_rank().over(Window.orderBy("Section_Code")) - 1)
    x0, y0 = (F.col("_i") % 10) * 10, F.floor(F.col("_i") / 10) * 10
    return per.select("Section_Code", "population", rect_ring(x0, y0, 10, 10).alias("rings"))


def tract_layer(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer")
    j = F.col("c_custkey")
    x0, y0 = (j % 20) * 5 + 1, F.floor(j / 20) * 5 + 2
    return c.select(F.lpad(j.cast("string"), 11, "0").alias("GEOID"),
                    (j + 100).cast("double").alias("population"),
                    F.transform(rect_ring(x0, y0, j % 3 + 3, j % 4 + 3),
                                lambda r: F.when(j % 2 == 1, F.reverse(r)).otherwise(r)).alias("rings"))


SECTIONS_SQL = f"""sup_sec AS (
  SELECT s_suppkey, s_acctbal, CASE WHEN s_suppkey % 53 = 0 THEN 'AFFBK' ELSE
    (CASE {' '.join(f"WHEN s_nationkey % 9 = {i} THEN '{p}'" for i, p in enumerate(SECTION_PREFIX))} END)
    || lpad(CAST(s_nationkey AS VARCHAR), 2, '0') || CAST(s_suppkey % 5 + 1 AS VARCHAR) END AS raw_code
  FROM supplier),
sections0 AS (
  SELECT s_suppkey, s_acctbal, {{norm}} AS Section_Code FROM sup_sec),
sections AS (
  SELECT Section_Code, sum(s_acctbal) AS population,
         CAST(dense_rank() OVER (ORDER BY Section_Code) - 1 AS INTEGER) AS idx
  FROM sections0 WHERE Section_Code NOT IN ({{drop}}) GROUP BY Section_Code)"""


def sections_sql() -> str:
    from ..functions.codes import drop_sections_sql, normalise_sql
    return SECTIONS_SQL.replace("{norm}", normalise_sql("raw_code")).replace("{drop}", drop_sections_sql())


TRACTS_SQL = """tracts AS (
  SELECT lpad(CAST(c_custkey AS VARCHAR), 11, '0') AS GEOID, CAST(c_custkey + 100 AS DOUBLE) AS population,
         CAST((c_custkey % 20) * 5 + 1 AS DOUBLE) AS x0, CAST(floor(c_custkey / 20) * 5 + 2 AS DOUBLE) AS y0,
         CAST((c_custkey % 20) * 5 + 1 + c_custkey % 3 + 3 AS DOUBLE) AS x1,
         CAST(floor(c_custkey / 20) * 5 + 2 + c_custkey % 4 + 3 AS DOUBLE) AS y1
  FROM customer)"""
