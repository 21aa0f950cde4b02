"""All named queries of the engine."""

from emberline.plans import incidents, joins, places, rules, streams, tables, words  # noqa: F401  each registers its queries
from emberline.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
