"""All registered queries."""

from stackscope.plans import (  # noqa: F401
    catalog_findings, catalog_locks, catalog_series, catalog_single, catalog_sources,
)
from stackscope.plans.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
