"""Money stays DECIMAL; every result is brought back to the declared width."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def money(col: str | Column) -> Column:
    return (F.col(col) if isinstance(col, str) else col).cast("decimal(12,2)")


def sum_money(col: str | Column) -> Column:
    """Sum over nothing is NULL, as in SQL."""
    return F.sum(col).cast("decimal(18,2)")


def sum_money_or_zero(col: str | Column) -> Column:
    return F.coalesce(sum_money(col), F.lit(0).cast("decimal(18,2)"))
