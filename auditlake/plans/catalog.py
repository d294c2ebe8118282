"""All registered queries."""

from auditlake.plans import flow_queries, result_queries, site_queries  # noqa: F401
from auditlake.plans.queries import QUERIES

__all__ = ["QUERIES"]
