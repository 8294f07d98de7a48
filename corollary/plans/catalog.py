"""All registered queries."""

from corollary.plans import queries_evaluation, queries_features, queries_jobs, queries_text  # noqa: F401
from corollary.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
