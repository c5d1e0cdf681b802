"""Change log by snapshot comparison, and questions to the log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.functions.dates import AsOf, on_day, stamp
from wardline.functions.ordering import down, top
from wardline.schema import KEYS
from wardline.sources.images import differing_buckets, read_image
from wardline.sources.tables import Hospital


def row_changes(name: str, old: DataFrame, new: DataFrame, *, as_of: AsOf, changed_by: Column | None = None) -> DataFrame:
    """INSERT, UPDATE and DELETE entries between two images of a table.

    A rewrite that changes no value leaves no trace in the images and so makes no entry.
    """
    key = KEYS[name]
    columns = [c for c in old.columns if c in new.columns]
    before = old.select(F.col(key).alias("record_id"), F.struct(*columns).alias("_old"))
    after = new.select(F.col(key).alias("record_id"), F.struct(*columns).alias("_new"))
    operation = (
        F.when(F.col("_old").isNull(), "INSERT").when(F.col("_new").isNull(), "DELETE").otherwise("UPDATE")
    )
    full = {"ignoreNullFields": "false"}
    return (
        before.join(after, "record_id", "full")
        .filter(~F.col("_old").eqNullSafe(F.col("_new")))
        .select(
            F.lit(name).alias("table_name"),
            operation.alias("operation"),
            "record_id",
            F.to_json("_old", full).alias("old_values"),
            F.to_json("_new", full).alias("new_values"),
            (F.lit(None).cast("long") if changed_by is None else changed_by.cast("long")).alias("changed_by"),
            stamp(as_of).alias("changed_at"),
        )
    )


def image_changes(
    spark: SparkSession, name: str, old: str, new: str, *, as_of: AsOf, changed_by: Column | None = None
) -> DataFrame:
    """The same between two stored images (`sources/images.py`): only buckets that differ are read and joined."""
    buckets = differing_buckets(spark, old, new)
    before, after = (read_image(spark, path, buckets) for path in (old, new))
    return row_changes(name, before, after, as_of=as_of, changed_by=changed_by)


def audit_entries(
    h: Hospital, log: DataFrame, *, on: AsOf, table: str | None = None, operation: str | None = None, n: int = 100
) -> DataFrame:
    """Newest entries of a day; entries without a known account are the system's."""
    wanted = on_day("changed_at", on)
    if table is not None:
        wanted = wanted & (F.col("table_name") == table)
    if operation is not None:
        wanted = wanted & (F.col("operation") == operation)
    newest = top(log.filter(wanted), [down("changed_at"), down("log_id")], n)
    accounts = h.users.select(F.col("user_id").alias("changed_by"), "username")
    return (
        newest.join(accounts, "changed_by", "left")
        .drop("changed_by")
        .withColumn("changed_by", F.coalesce("username", F.lit("System")))
        .select("log_id", "table_name", "operation", "record_id", "changed_by", "changed_at", "old_values", "new_values")
        .orderBy(down("changed_at"), down("log_id"))
    )


def changed_fields(log: DataFrame, *keep: str) -> DataFrame:
    """One row per field whose value differs between the two sides; an absent side counts as empty."""
    side = "map<string,string>"
    none = F.expr(f"cast(map() as {side})")
    pair = (
        log.withColumn("_old", F.coalesce(F.from_json("old_values", side), none))
        .withColumn("_new", F.coalesce(F.from_json("new_values", side), none))
        .withColumn("field", F.explode(F.array_union(F.map_keys("_old"), F.map_keys("_new"))))
        .withColumn("old_value", F.try_element_at("_old", F.col("field")))
        .withColumn("new_value", F.try_element_at("_new", F.col("field")))
    )
    return pair.filter(~F.col("old_value").eqNullSafe(F.col("new_value"))).select(*keep, "field", "old_value", "new_value")
