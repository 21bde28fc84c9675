"""All registered queries: importing the query modules fills the registry."""

from eventlab.plans import event_queries, stat_queries, table_queries  # noqa: F401
from eventlab.plans.registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
