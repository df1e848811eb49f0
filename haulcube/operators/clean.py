"""Cleaning of raw loads.

One narrow stage: every rule is a Column predicate or projection, so the whole
cleaning fuses into a single whole-stage-codegen span right after the scan and
the filters that only touch source columns are pushed towards the reader.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.codes import (DROP_SECTIONS, PLACEHOLDER_TRUCK, PRIMARY_STREAMS,
                               borough_of, normalise_trimmed, stream_name)
from ..functions.nullsafe import neq_keep_null, positive

# The ten columns of the raw files.
RAW_COLUMNS = ["Truck_ID", "Collection_Date", "Shift_ID", "District_Code", "Section_Code",
               "Route_Code", "Material_Type_Code", "Tons_Collected", "Net_Weight",
               "Dump_Time_Stamp"]
# tried in order; pass others when the raw files need them (a date in no given form is rejected as `bad_date`)
DATE_FORMATS = ("yyyy-MM-dd", "MM/dd/yyyy", "yyyy-MM-dd HH:mm:ss[.SSS]", "yyyy-MM-dd'T'HH:mm:ss[.SSS]", "MM/dd/yyyy hh:mm:ss a", "yyyyMMdd")


def trim_strings(df: DataFrame) -> DataFrame:
    """Btrim every string column, found from the schema."""
    return df.select([F.btrim(f.name).alias(f.name) if isinstance(f.dataType, T.StringType)
                      else F.col(f.name) for f in df.schema.fields])


def lenient_date(c, formats=DATE_FORMATS):
    """First format that parses wins; failures become null (never raise)."""
    if not isinstance(c, F.Column):
        c = F.col(c)
    if isinstance(formats, str):
        formats = (formats,)
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("date")


def lenient_number(c, to: str = "int", fill=None):
    """try_cast, failures null (optionally filled)."""
    out = F.col(c).cast("string").try_cast(to) if isinstance(c, str) else c.cast("string").try_cast(to)
    return F.coalesce(out, F.lit(fill)) if fill is not None else out


def clean_loads(raw: DataFrame, date_formats=DATE_FORMATS, null_code: str = "nan") -> DataFrame:
    """Raw loads -> clean loads with derived calendar columns (A2 schema)."""
    df = trim_strings(raw.select(*RAW_COLUMNS))
    d = lenient_date(F.col("Collection_Date"), date_formats)
    code = lenient_number(F.col("Material_Type_Code"), "int")
    df = (df.filter(neq_keep_null(F.col("Truck_ID"), PLACEHOLDER_TRUCK))      # P3 (N4)
            .filter(F.col("Collection_Date").isNotNull())                     # P4
            .withColumn("Collection_Date", d)
            .filter(F.col("Collection_Date").isNotNull())                     # P6
            .filter(positive(F.col("Tons_Collected")))                        # P8 (N6)
            .withColumn("Material_Type_Code", code)
            .filter(F.col("Material_Type_Code").isin(*PRIMARY_STREAMS)))      # P7, P9
    # F1 (N7): trim in one projection, apply the rules to that column in the next;
    # the rule chain reads its input ~20 times, so Catalyst keeps the two projections
    # apart and the trimmed value is computed once per row inside codegen.
    df = df.select(*[F.coalesce(F.btrim(F.col(c)), F.lit(null_code)).alias(c)
                     if c in ("District_Code", "Section_Code") else F.col(c) for c in df.columns])
    df = df.select(*[normalise_trimmed(F.col(c)).alias(c)
                     if c in ("District_Code", "Section_Code") else F.col(c) for c in df.columns])
    # P10 as an anti join with the fixed 26-code list (broadcast): unlike a filter it
    # is not pushed below the normaliser, so the rules run exactly once per row.
    # The list is an expression, not local rows: those would start Python on every executor.
    drops = df.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*(F.lit(x) for x in DROP_SECTIONS))).alias("_drop"))
    df = df.join(F.broadcast(drops), F.col("Section_Code") == F.col("_drop"), "left_anti")
    dt = F.col("Collection_Date")
    return df.select(
        *RAW_COLUMNS[:6],
        F.col("Material_Type_Code").cast("short").alias("Material_Type_Code"),
        "Tons_Collected", "Net_Weight", "Dump_Time_Stamp",
        borough_of(F.col("District_Code")).alias("borough"),                 # F2
        stream_name(F.col("Material_Type_Code")).alias("material_name"),     # J5
        F.year(dt).alias("year"), F.month(dt).alias("month"),                 # F5
        F.weekofyear(dt).alias("week"),                                       # F3 (ISO)
        F.weekday(dt).alias("day_of_week"),
    )


def reject_reason(raw: DataFrame, date_formats=DATE_FORMATS, too_long=None, null_code: str = "nan") -> DataFrame:
    """All-string raw rows with the column `reason`: the first rule of `clean_loads` that drops the row, null for a kept one.

    `too_long` is a boolean column that marks lines with too many fields; these come first.
    """
    text = {c: F.btrim(F.col(c)) for c in ("Truck_ID", "Collection_Date", "Section_Code")}
    rows = raw.withColumn("_section", F.coalesce(text["Section_Code"], F.lit(null_code)))
    rows = rows.withColumn("_section", normalise_trimmed(F.col("_section")))
    rules = [("too_many_fields", F.coalesce(too_long, F.lit(False)) if too_long is not None else F.lit(False)),
             ("placeholder_truck", ~neq_keep_null(text["Truck_ID"], PLACEHOLDER_TRUCK)),
             ("no_date", text["Collection_Date"].isNull()),
             ("bad_date", lenient_date(text["Collection_Date"], date_formats).isNull()),
             ("tons_not_positive", ~F.coalesce(positive(lenient_number("Tons_Collected", "double")), F.lit(False))),
             ("other_material", ~F.coalesce(lenient_number("Material_Type_Code", "int").isin(*PRIMARY_STREAMS), F.lit(False))),
             ("dropped_section", F.col("_section").isin(*DROP_SECTIONS))]
    return rows.withColumn("reason", F.coalesce(*[F.when(bad, F.lit(name)) for name, bad in rules])).drop("_section")


def clean_sql(src: str = "loads", null_code: str = "nan") -> str:
    from ..functions.codes import borough_sql, drop_sections_sql, normalise_sql
    dist = normalise_sql(f"coalesce(District_Code, '{null_code}')")
    sect = normalise_sql(f"coalesce(Section_Code, '{null_code}')")
    return f"""clean0 AS (
  SELECT trim(Truck_ID) AS Truck_ID,
         CAST(try_strptime(trim(Collection_Date), '%Y-%m-%d') AS DATE) AS Collection_Date,
         trim(Shift_ID) AS Shift_ID, {dist} AS District_Code, {sect} AS Section_Code,
         trim(Route_Code) AS Route_Code,
         TRY_CAST(CAST(Material_Type_Code AS VARCHAR) AS INTEGER) AS mt,
         Tons_Collected, Net_Weight, trim(Dump_Time_Stamp) AS Dump_Time_Stamp
  FROM {src}
  WHERE Truck_ID IS DISTINCT FROM '{PLACEHOLDER_TRUCK}' AND Collection_Date IS NOT NULL
),
clean AS (
  SELECT Truck_ID, Collection_Date, Shift_ID, District_Code, Section_Code, Route_Code,
         CAST(mt AS SMALLINT) AS Material_Type_Code, Tons_Collected, Net_Weight, Dump_Time_Stamp,
         {borough_sql('District_Code')} AS borough,
         CASE mt WHEN 1 THEN 'Refuse' WHEN 31 THEN 'Paper' WHEN 33 THEN 'MGP' END AS material_name,
         CAST(year(Collection_Date) AS INTEGER) AS year, CAST(month(Collection_Date) AS INTEGER) AS month,
         CAST(weekofyear(Collection_Date) AS INTEGER) AS week,
         CAST(isodow(Collection_Date) - 1 AS INTEGER) AS day_of_week
  FROM clean0
  WHERE Collection_Date IS NOT NULL AND Tons_Collected > 0 AND NOT isnan(Tons_Collected)
    AND mt IN (1, 31, 33) AND Section_Code NOT IN ({drop_sections_sql()})
)"""


def reject_sql(src: str, too_long: str, null_code: str = "nan") -> str:
    from ..functions.codes import drop_sections_sql, normalise_sql
    sect = normalise_sql(f"coalesce(Section_Code, '{null_code}')")
    return f"""judged AS (SELECT *, CASE WHEN {too_long} THEN 'too_many_fields'
  WHEN trim(Truck_ID) = '{PLACEHOLDER_TRUCK}' THEN 'placeholder_truck' WHEN Collection_Date IS NULL THEN 'no_date'
  WHEN try_strptime(trim(Collection_Date), '%Y-%m-%d') IS NULL THEN 'bad_date'
  WHEN Tons_Collected IS NULL OR isnan(Tons_Collected) OR Tons_Collected <= 0 THEN 'tons_not_positive'
  WHEN coalesce(TRY_CAST(CAST(Material_Type_Code AS VARCHAR) AS INTEGER), -1) NOT IN (1, 31, 33) THEN 'other_material'
  WHEN {sect} IN ({drop_sections_sql()}) THEN 'dropped_section' END AS reason FROM {src})"""
