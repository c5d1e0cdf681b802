"""Ordering with explicit NULL placement, bounded top-k, and row sequences that do not pass one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wardline.sources.staging import cut


def up(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def down(name: str) -> Column:
    return F.col(name).desc_nulls_first()


def top(df: DataFrame, order: Sequence[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per(df: DataFrame, key: str | Sequence[str], order: Sequence[Column], n: int, rank: str = "rank") -> DataFrame:
    """First n rows of each key. Spark keeps at most n rows per key and map task before the shuffle."""
    keys = [key] if isinstance(key, str) else list(key)
    ranked = df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(rank) <= n)


def first_of(df: DataFrame, keys: Sequence[str], order: Sequence[str], row_id: str) -> DataFrame:
    """row_id of the earliest row per key, by hash aggregation: a hot key shrinks in the map tasks."""
    earliest = F.min_by(F.col(row_id), F.struct(*order))
    return df.groupBy(*keys).agg(earliest.alias(row_id))


def positioned(df: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Sort globally and write the result with (_part, _pos): the range partition and the row's place in it.

    The written table fixes the layout, so later passes agree on it even if tasks are repeated.
    """
    laid = df.orderBy(*order).withColumn("_mark", F.monotonically_increasing_id())
    return (
        cut(laid)
        .withColumn("_part", F.shiftright("_mark", 33))
        .withColumn("_pos", F.col("_mark").bitwiseAND(F.lit((1 << 33) - 1)))
        .drop("_mark")
    )


def with_sequence(df: DataFrame, order: Sequence[Column], name: str, start: Column | int = 0) -> DataFrame:
    """Number rows start+1, start+2, ... in the given order without moving them into one task.

    The only un-partitioned window runs over one row per sort partition.
    """
    laid = positioned(df, order)
    before = F.coalesce(F.sum("_rows").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = laid.groupBy("_part").agg(F.count("*").alias("_rows")).select("_part", before.alias("_before"))
    base = F.lit(start) if isinstance(start, int) else start
    return (
        laid.join(F.broadcast(offsets), "_part")
        .withColumn(name, (base + F.col("_before") + F.col("_pos") + 1).cast("long"))
        .drop("_part", "_pos", "_before")
    )


def highest(df: DataFrame, column: str) -> Column:
    """Largest value of a column as a scalar subquery, 0 for an empty table."""
    return F.coalesce(df.agg(F.max(column)).scalar(), F.lit(0))
