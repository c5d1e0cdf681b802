"""Tables stored by month or by bucket of their key, where a job's changes rewrite only the partitions they fall into.

The partitions come from the changes: those of the rows that change, and those that a changed date moves rows to.
Their new content is written to the shared folder first and then put in place by dynamic partition overwrite; all
other partitions keep their files. Changes name the values that rows end with, so doing a merge again, after a
failure halfway or from the start, gives the same table.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardline.plans.common import Change, patched
from wardline.schema import TABLES
from wardline.sources.staging import cut
from wardline.sources.tables import Hospital

BUCKETS = 64
NO_MONTH = "none"


@dataclass(frozen=True)
class Layout:
    """Name and value of a table's partition column, and the column that decides it."""

    part: str
    value: Callable[[], Column]
    source: str


def by_month(part: str, source: str) -> Layout:
    return Layout(part, lambda: F.coalesce(F.date_format(source, "yyyy-MM"), F.lit(NO_MONTH)), source)


def by_bucket(part: str, key: str) -> Layout:
    return Layout(part, lambda: F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(BUCKETS)).cast("string"), key)


LAYOUTS: Mapping[str, Layout] = {
    "appointments": by_month("appt_month", "appt_date"),
    "lab_orders": by_month("order_month", "ordered_at"),
    "prescriptions": by_month("rx_month", "prescribed_at"),
    "bills": by_month("bill_month", "bill_date"),
    "patients": by_bucket("patient_bucket", "patient_id"),
    "medicines": by_bucket("medicine_bucket", "medicine_id"),
}


def open_parts(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A stored table with its declared schema and its partition column, as text."""
    schema = StructType([*TABLES[name].fields, StructField(LAYOUTS[name].part, StringType())])
    return spark.read.schema(schema).parquet(path)


def with_parts(h: Hospital, name: str, path: str) -> Hospital:
    """The hospital with a table read from its partitions, and beside it the same with its partition column."""
    stored = open_parts(h.spark, path, name)
    return h.replaced(**{name: stored.drop(LAYOUTS[name].part), f"{name}_parts": stored})


def live_slots(h: Hospital, wanted: DataFrame) -> DataFrame:
    """Live appointments that may hold one of the wanted slots (appt_date).

    Where the appointments are stored by month, Spark prunes the months by those that are wanted, when the query runs.
    """
    live = F.col("status") != "Cancelled"
    if "appointments_parts" not in h:
        return h.appointments.filter(live)
    layout = LAYOUTS["appointments"]
    # as a comparison, which Spark takes for selective enough to prune by; months sort before the mark of none
    months = wanted.select(layout.value().alias(layout.part)).filter(F.col(layout.part) < NO_MONTH).distinct()
    # broadcast: a row a month of the calendar at most
    return h.appointments_parts.filter(live).join(F.broadcast(months), layout.part, "left_semi").drop(layout.part)


def _laid_out(rows: DataFrame, name: str) -> DataFrame:
    layout = LAYOUTS[name]
    rows = rows.select(*TABLES[name].fieldNames()).withColumn(layout.part, layout.value())
    return rows.hint("rebalance", layout.part).sortWithinPartitions(layout.part, layout.source)


def store_parts(rows: DataFrame, path: str, name: str) -> None:
    _laid_out(rows, name).write.mode("errorifexists").partitionBy(LAYOUTS[name].part).parquet(path)


def append_parts(rows: DataFrame, path: str, name: str) -> None:
    """New rows go to new files of their partitions."""
    _laid_out(rows, name).write.mode("append").partitionBy(LAYOUTS[name].part).parquet(path)


def touched_parts(stored: DataFrame, name: str, change: Change) -> list[str]:
    """Partitions that a change reads and writes; at most as many as the table has, or new dates name."""
    layout = LAYOUTS[name]
    if layout.source == change.key:
        parts = change.rows.select(layout.value().alias(layout.part))
    else:  # two columns of the stored table
        parts = stored.select(change.key, layout.part).join(change.rows.select(change.key), change.key, "left_semi").select(layout.part)
        if layout.source in change.columns:
            parts = parts.unionByName(change.rows.select(layout.value().alias(layout.part)))
    return sorted(row[0] for row in parts.distinct().collect())


def merge_change(spark: SparkSession, path: str, name: str, change: Change) -> list[str]:
    """Rewrite the partitions of a stored table that a change falls into; returns them."""
    layout = LAYOUTS[name]
    change = Change(cut(change.rows), change.key, change.columns)
    stored = open_parts(spark, path, name)
    parts = touched_parts(stored, name, change)
    if not parts:
        return []
    old = stored.filter(F.col(layout.part).isin(parts)).drop(layout.part)
    image = cut(_laid_out(patched(old, change.rows, change.key, change.columns), name))
    put_in_place(image, path, name, parts)
    return parts


def put_in_place(image: DataFrame, path: str, name: str, parts: list[str]) -> None:
    """Replace the given partitions by the written image of all of them."""
    part = LAYOUTS[name].part
    writer = image.hint("rebalance", part).sortWithinPartitions(part, LAYOUTS[name].source).write.mode("overwrite")
    writer.option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    filled = {row[0] for row in image.select(part).distinct().collect()}
    for emptied in sorted(set(parts) - filled):  # a dynamic overwrite leaves partitions without rows as they are
        image.limit(0).drop(part).coalesce(1).write.mode("overwrite").parquet(f"{path}/{part}={emptied}")
