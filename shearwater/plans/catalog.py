"""All registered queries: importing the modules registers them."""

from . import analytics, documents, jobs, relational, rules, scalars  # noqa: F401
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
