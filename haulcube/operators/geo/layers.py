"""Polygon layer helpers."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed candidate id column names of a section layer, in priority order.
ID_CANDIDATES = ["Sections", "DSNY_Secti", "Section", "SEC_CODE", "SECTION", "DSECT"]


def discover_id(df: DataFrame, target: str = "Section_Code", candidates=ID_CANDIDATES) -> DataFrame:
    """First candidate id column present, else the first string column; renamed and trimmed."""
    col = next((c for c in candidates if c in df.columns), None)
    if col is None:
        col = next(f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType))
    return df.withColumn(col, F.btrim(F.col(col))).withColumnRenamed(col, target)
