"""All registered queries of the catalog operators and their SQL."""

from shelfmark.plans import q_attrs, q_category, q_deps, q_evidence, q_prices  # noqa: F401
from shelfmark.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
