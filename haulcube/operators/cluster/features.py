"""Feature matrices for clustering.

Kept long-form (group, week, z) for SQL-style operators; the per-group array
is assembled only at the ML edge, and its length is the number of weeks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ...functions.codes import STREAM_ORDER
from ..profile import zscore
from ..weekly import densify


def coverage_filter(df: DataFrame, group: str, time: str, value: str, coverage: float = 0.8) -> DataFrame:
    """Groups with value > 0 in at least int(coverage * distinct weeks) weeks."""
    n_weeks = df.select(F.count_distinct(time)).scalar()
    pos = df.groupBy(group).agg(F.count_if(F.col(value) > 0).alias("n_pos"))
    return pos.filter(F.col("n_pos") >= F.floor(n_weeks * F.lit(coverage)))


def feature_long(cube: DataFrame, group: str, value: str = "tons_refuse", time: str = "week_start",
                 coverage: float = 0.8) -> DataFrame:
    """M1 long form: densified, coverage-filtered, row z-scored (population std, 0-var -> 0)."""
    dense = densify(cube, group, time, value)
    keep = coverage_filter(dense, group, time, value, coverage).select(group)
    d = dense.join(keep, group, "left_semi")
    return d.select(group, time, zscore(value, [group], ddof=0).alias("z")).checkpoint(eager=True)


def to_arrays(long: DataFrame, group: str, time: str = "week_start", z: str = "z",
              out: str = "features") -> DataFrame:
    """Ordered per-group array of the long form (one row per group)."""
    s = F.sort_array(F.collect_list(F.struct(F.col(time).alias("t"), F.col(z).alias("v"))))
    return long.groupBy(group).agg(s.alias("_s")).select(group, F.col("_s.v").alias(out))


def feature_matrix(cube: DataFrame, group: str, value: str = "tons_refuse", coverage: float = 0.8) -> DataFrame:
    """M1: (group, features ARRAY<DOUBLE>)."""
    return to_arrays(feature_long(cube, group, value, coverage=coverage), group).checkpoint(eager=True)


def multistream_matrix(cube: DataFrame, group: str, coverage: float = 0.8, streams=STREAM_ORDER) -> DataFrame:
    """The stream matrices concatenated per group; groups kept by all streams."""
    cube = cube.select(group, "week_start", *streams).checkpoint(eager=True)  # read once per stream
    mats = [feature_matrix(cube, group, s, coverage).withColumnRenamed("features", f"_f{i}")
            for i, s in enumerate(streams)]
    out = mats[0]
    for m in mats[1:]:
        out = out.join(m, group)
    return out.select(group, F.concat(*[F.col(f"_f{i}") for i in range(len(streams))]).alias("features"))
