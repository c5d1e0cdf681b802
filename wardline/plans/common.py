"""Shapes shared by the batch jobs."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

REASON = "reason"


@dataclass(frozen=True)
class Change:
    """Rows, unique per key, with the values that columns of the stored rows end with."""

    rows: DataFrame
    key: str
    columns: Sequence[str]


@dataclass
class Outcome:
    """What a job decided, the new images of the tables it touched, and the changes that lead to them."""

    accepted: DataFrame
    rejected: DataFrame
    tables: dict[str, DataFrame] = field(default_factory=dict)
    changes: dict[str, Change] = field(default_factory=dict)


def changed(accepted: DataFrame, rejected: DataFrame, table: str, before: DataFrame, change: Change) -> Outcome:
    """The outcome of a job that changes rows of one table."""
    image = patched(before, change.rows, change.key, change.columns)
    return Outcome(accepted, rejected, {table: image}, {table: change})


def first_failure(*checks: tuple[Column, str | Column] | Column) -> Column:
    """Reason of the first failing check, NULL if all pass.

    A check is (failing condition, reason), or a rule: a column that is the reason itself or NULL.
    """
    reason = F.lit(None).cast("string")
    for check in reversed(checks):
        if isinstance(check, tuple):
            failing, text = check
            reason = F.when(failing, F.lit(text) if isinstance(text, str) else text).otherwise(reason)
        else:
            reason = F.coalesce(check, reason)
    return reason


def decisions(outcome: Outcome, row_id: str = "request_id", new_id: str | None = None) -> DataFrame:
    """One row per request: accepted or not, why not, and the id an accepted one resolved to."""
    made = F.lit(None).cast("long") if new_id is None else F.col(new_id).cast("long")
    yes = outcome.accepted.select(
        row_id, F.lit(True).alias("accepted"), F.lit(None).cast("string").alias(REASON), made.alias("new_id")
    )
    no = outcome.rejected.select(row_id, F.lit(False).alias("accepted"), REASON, F.lit(None).cast("long").alias("new_id"))
    both = yes.unionByName(no)
    return both if new_id is not None else both.drop("new_id")


def known(df: DataFrame, table: DataFrame, key: str, flag: str, table_key: str | None = None) -> DataFrame:
    """Add a flag: the row's key occurs in the table (whose key column is unique)."""
    keys = table.select(F.col(table_key or key).alias(key), F.lit(True).alias(flag))
    return df.join(keys, key, "left").withColumn(flag, F.coalesce(flag, F.lit(False)))


def patched(table: DataFrame, changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """New table image: rows named in `changes` (unique per key) take its values, NULLs included."""
    fresh = changes.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns], F.lit(True).alias("_hit"))
    joined = table.join(fresh, key, "left")
    return joined.select(
        *[
            F.when(F.col("_hit"), F.col(f"_new_{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c)
            for c in table.columns
        ]
    )
