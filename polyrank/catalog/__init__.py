"""Queries over the driver's tables, one or more for each operator, and their SQL."""

from . import cohorts, ensembles, joining, modelling, projecting, quality, scanning, selecting, statistics  # noqa: F401
from .registry import ORACLE_SQL, QUERIES  # noqa: F401
