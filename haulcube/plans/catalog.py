"""Imports every query module so that the registry is complete."""
from . import q_agg, q_basic, q_cluster, q_core, q_forecast, q_geo, q_io  # noqa: F401
from .registry import ORACLES, QUERIES  # noqa: F401
