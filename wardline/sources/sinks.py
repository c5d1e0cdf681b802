"""Sinks: an append-only audit log and whole-table snapshots that replace each other by path."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import DateType, StructField, StructType

from wardline.schema import TABLES
from wardline.sources.staging import cut


def append_audit(entries: DataFrame, path: str, *, once: bool = False) -> None:
    """Add entries to the audit log. There is no update and no delete: files are only ever added.

    The log is laid out by day of change, so a day's query reads a day's files. Rebalancing gathers a day's
    entries into files of the advisory size and splits a day that holds most of them.

    With `once`, an entry whose log_id the log has already on its day is left out, so that a delivery may be repeated,
    whole or in part; the days of the delivery are all that is read of the log. A change keeps its number and its time
    when it is delivered again. One writer at a time.
    """
    laid = entries.withColumn("changed_on", F.to_date("changed_at"))
    if once:
        laid = cut(laid.withColumn("_row", F.monotonically_increasing_id()))
        days = [row[0] for row in laid.select("changed_on").distinct().collect()]  # at most the days of the delivery
        if not days:
            return
        rows = told = laid.select("log_id", "_row")
        if _exists(entries.sparkSession, path):
            log = read_audit(entries.sparkSession, path)
            same_days = F.col("changed_on").isin([d for d in days if d]) | (F.col("changed_on").isNull() & F.lit(None in days))
            there = log.filter(same_days & F.col("log_id").isNotNull())
            told = rows.unionByName(there.select("log_id", F.lit(-1).cast("long").alias("_row")))
        # Numbers alone are compared; whole entries are only joined if some of them are to be left out.
        first = told.groupBy(F.col("log_id").alias("_id")).agg(F.min("_row").alias("_first"), F.count("*").alias("_n")).filter("_n > 1")
        left_out = cut(rows.join(first, F.col("log_id").eqNullSafe(F.col("_id"))).filter("_row <> _first").select("_row"))
        laid = (laid if left_out.isEmpty() else laid.join(left_out, "_row", "left_anti")).drop("_row")
    (
        laid.hint("rebalance", "changed_on")
        .write.mode("append")
        .partitionBy("changed_on")
        .parquet(path)
    )


def _exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    laid_out = StructType([*TABLES["audit_log"].fields, StructField("changed_on", DateType())])
    return spark.read.schema(laid_out).parquet(path)


def write_snapshot(df: DataFrame, root: str, name: str, version: str) -> str:
    """Write a full table image beside the older ones. Readers switch by using the returned path.

    Appointments are laid out by month, because every worklist filters on the appointment date.
    """
    path = f"{root.rstrip('/')}/{name}/version={version}"
    if name == "appointments":
        (
            df.withColumn("appt_month", F.date_format("appt_date", "yyyy-MM"))
            .hint("rebalance", "appt_month")
            .sortWithinPartitions("appt_month", "appt_date")
            .write.mode("errorifexists")
            .partitionBy("appt_month")
            .parquet(path)
        )
    else:
        df.write.mode("errorifexists").parquet(path)
    return path
