"""Imports every module of queries, so that all are registered."""

from larder.plans import analytics, scans, surface  # noqa: F401
from larder.plans.registry import ORACLES, QUERIES  # noqa: F401
