"""All queries of the key-value operators, by name."""

from __future__ import annotations

from kvloom.plans import cluster, service, values  # noqa: F401  (they register)
from kvloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
