"""All registered queries."""

from __future__ import annotations

from wardline.catalog import reads, jobs, others, checks  # noqa: F401, I001  (registered in this order)
from wardline.catalog.oracle import check_sql
from wardline.catalog.registry import CHECKS, QUERIES

__all__ = ["QUERIES", "oracle_sql"]


def oracle_sql() -> dict[str, str]:
    return {name: check_sql(body) for name, body in CHECKS.items()}
