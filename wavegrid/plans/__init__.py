"""Registered queries."""

from wavegrid.plans import files, headers, imaging, models, scans, surveys, volumes  # noqa: F401
from wavegrid.plans.registry import ORACLE, QUERIES  # noqa: F401
