"""Shared inputs of the registered queries: clean loads and weekly cubes.

Each is a lazy plan over the given parquet tables; nothing is collected.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.clean import clean_loads, clean_sql
from ..operators.weekly import weekly_cube, weekly_cube_sql
from ..sources.analogue import LOADS_SQL, loads


def clean_df(spark: SparkSession, sf: str) -> DataFrame:
    return clean_loads(loads(spark, sf))


def district_cube(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_cube(clean_df(spark, sf), "District_Code")


def section_cube(spark: SparkSession, sf: str) -> DataFrame:
    return weekly_cube(clean_df(spark, sf), "Section_Code")


CLEAN_CTE = LOADS_SQL + ",\n" + clean_sql("loads")
DCUBE_CTE = CLEAN_CTE + ",\n" + weekly_cube_sql("clean", "District_Code")
SCUBE_CTE = CLEAN_CTE + ",\n" + weekly_cube_sql("clean", "Section_Code", "cube")
SCUBE_ONLY = weekly_cube_sql("clean", "Section_Code", "scube")


def with_clean(select: str) -> str:
    return f"WITH {CLEAN_CTE}\n{select}"


def with_dcube(select: str, extra: str = "") -> str:
    return f"WITH {DCUBE_CTE}{(',' + extra) if extra else ''}\n{select}"


def with_scube(select: str) -> str:
    return f"WITH {SCUBE_CTE}\n{select}"


def sql(*ctes: str, select: str) -> str:
    """Compose an oracle: named CTE blocks (already 'name AS (...)') and a final SELECT."""
    parts = [c.strip().rstrip(",") for c in ctes if c and c.strip()]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + select
