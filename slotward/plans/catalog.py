"""All registered queries."""

from . import audits, design, features, models, profiling, reports, storage, vendors  # noqa: F401 - registration
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
