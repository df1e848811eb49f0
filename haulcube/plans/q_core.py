"""Flagship and cleaning queries."""
from __future__ import annotations

from ..functions.codes import MEASURES
from ..operators.weekly import MA_WINDOWS
from .base import clean_df, district_cube, section_cube, with_clean, with_dcube, with_scube
from .registry import query

CUBE_COLS = ["week_start"] + MEASURES + [f"{m}_ma_{s}" for s in MA_WINDOWS for m in MEASURES]


@query("a4_weekly_cube", with_dcube("SELECT * FROM cube"))
def a4_weekly_cube(spark, sf):
    return district_cube(spark, sf)


@query("a4_weekly_cube_section", with_scube("SELECT * FROM cube"))
def a4_weekly_cube_section(spark, sf):
    return section_cube(spark, sf)


@query("p2_clean_loads", with_clean("SELECT * FROM clean"))
def p2_clean_loads(spark, sf):
    return clean_df(spark, sf)
