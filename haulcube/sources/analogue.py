"""The raw `loads` table expressed over the given TPC-H-like tables.

lineitem ⋈ supplier ⋈ nation gives one row per truck load with every
oddity the cleaning rules handle (placeholder and null ids, null and
unparsable dates, non-positive tons, non-primary codes, excluded sections,
codes in every normaliser branch).  The plan is one scan of lineitem with
two hash joins: nation is a fixed 25-row dimension (broadcast), supplier is
left to Spark's size-checked auto-broadcast or a shuffle join.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

# Fixed fixture values (analogue definition).
DISTRICT_PREFIX = ["BKE", "BKW", "BKN", "QS0", "QN0", "M10", "BXE", "SI0", "MN0"]
SECTION_PREFIX = ["BKE", "BKW", "BKN", "QS", "QN", "M1", "BXE", "SI", "MN"]


def _pick(options, idx):
    return F.element_at(F.array(*[F.lit(o) for o in options]), idx + 1)


def loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    sup = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nat = table(spark, sf_dir, "nation").select("n_nationkey")
    dims = sup.join(F.broadcast(nat), sup.s_nationkey == nat.n_nationkey)
    j = li.join(dims, li.l_suppkey == dims.s_suppkey)
    nk = F.col("n_nationkey")
    nk2 = F.lpad(nk.cast("string"), 2, "0")
    ok, pk, sk = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_suppkey")
    return j.select(
        F.when(ok % 97 == 0, F.lit("9999999")).when(ok % 89 == 0, F.lit(None))
         .otherwise(F.concat(F.lit("T"), (ok % 500).cast("string"))).alias("Truck_ID"),
        F.when(pk % 101 == 0, F.lit(None).cast("string"))
         .when(pk % 103 == 0, F.lit("not a date"))
         .otherwise(F.date_format("l_shipdate", "yyyy-MM-dd")).alias("Collection_Date"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit(" ")).alias("Shift_ID"),
        F.when(ok % 83 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit(" "), _pick(DISTRICT_PREFIX, nk % 9), nk2)).alias("District_Code"),
        F.when(sk % 53 == 0, F.lit("AFFBK"))
         .otherwise(F.concat(_pick(SECTION_PREFIX, nk % 9), nk2, (sk % 5 + 1).cast("string")))
         .alias("Section_Code"),
        pk.cast("string").alias("Route_Code"),
        F.when(F.col("l_linenumber") == 7, F.lit(2))
         .when(F.col("l_returnflag") == "A", F.lit(1))
         .when(F.col("l_returnflag") == "N", F.lit(31))
         .otherwise(F.lit(33)).alias("Material_Type_Code"),
        (F.col("l_quantity") - 2).alias("Tons_Collected"),
        (F.col("l_quantity") - 2 + F.col("l_discount") * 20).alias("Net_Weight"),
        F.lit(None).cast("string").alias("Dump_Time_Stamp"),
    )


def _pick_sql(options, idx):
    return "(CASE " + " ".join(f"WHEN {idx} = {i} THEN '{o}'" for i, o in enumerate(options)) + " END)"


LOADS_SQL = f"""loads AS (
  SELECT
    CASE WHEN l_orderkey % 97 = 0 THEN '9999999' WHEN l_orderkey % 89 = 0 THEN NULL
         ELSE 'T' || CAST(l_orderkey % 500 AS VARCHAR) END AS Truck_ID,
    CASE WHEN l_partkey % 101 = 0 THEN NULL WHEN l_partkey % 103 = 0 THEN 'not a date'
         ELSE strftime(l_shipdate, '%Y-%m-%d') END AS Collection_Date,
    CAST(l_linenumber AS VARCHAR) || ' ' AS Shift_ID,
    CASE WHEN l_orderkey % 83 = 0 THEN NULL
         ELSE ' ' || {_pick_sql(DISTRICT_PREFIX, 'n_nationkey % 9')} || lpad(CAST(n_nationkey AS VARCHAR), 2, '0') END AS District_Code,
    CASE WHEN l_suppkey % 53 = 0 THEN 'AFFBK'
         ELSE {_pick_sql(SECTION_PREFIX, 'n_nationkey % 9')} || lpad(CAST(n_nationkey AS VARCHAR), 2, '0')
              || CAST(l_suppkey % 5 + 1 AS VARCHAR) END AS Section_Code,
    CAST(l_partkey AS VARCHAR) AS Route_Code,
    CASE WHEN l_linenumber = 7 THEN 2 WHEN l_returnflag = 'A' THEN 1
         WHEN l_returnflag = 'N' THEN 31 ELSE 33 END AS Material_Type_Code,
    l_quantity - 2 AS Tons_Collected,
    l_quantity - 2 + l_discount * 20 AS Net_Weight,
    CAST(NULL AS VARCHAR) AS Dump_Time_Stamp
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
)"""
