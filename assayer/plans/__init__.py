"""The named queries. Importing this package registers them."""

from assayer.plans import arrow, diagrams, documents, drawings, fitting, flow, measures, readings, reports, scoring, segments, streams, windows  # noqa: F401
from assayer.registry import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES"]
