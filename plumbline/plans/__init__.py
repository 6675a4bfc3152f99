"""Registered queries by family; importing a module registers its queries."""

from . import aggregates, control, detectors, evaluation, joins, relational, scalars, series, simulations, sources, statistics  # noqa: F401
from .registry import ORACLE, QUERIES  # noqa: F401
