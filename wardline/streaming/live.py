"""Live daily totals: the trend queries over streams of payments and appointments."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from wardline.sources.staging import cut


def _daily(stream: DataFrame, ts: str, late: str, *figures: Column) -> DataFrame:
    """Tumbling days by event time; rows older than the watermark are dropped."""
    return (
        stream.withColumn("_ts", F.col(ts).cast("timestamp"))
        .withWatermark("_ts", late)
        .groupBy(F.window("_ts", "1 day"))
        .agg(*figures)
        .withColumn("day", F.to_date(F.col("window.start")))
        .drop("window")
    )


def live_revenue(payments: DataFrame, *, late: str = "1 day") -> DataFrame:
    return _daily(
        payments, "payment_date", late, F.sum("amount_paid").cast("decimal(18,2)").alias("revenue"), F.count("*").alias("payments")
    )


def live_appointments(appointments: DataFrame, *, late: str = "1 day") -> DataFrame:
    status = F.col("status")

    def count_if(condition: Column, name: str) -> Column:
        return F.sum(F.when(condition, 1).otherwise(0)).cast("long").alias(name)

    return _daily(
        appointments,
        "appt_date",
        late,
        F.count("*").alias("total"),
        count_if(status == "Completed", "completed"),
        count_if(status == "Cancelled", "cancelled"),
        count_if(status.isin("Pending", "Confirmed"), "pending"),
    )


class LateSplit:
    """Daily sums of a stream under a folder, and beside them the rows that came too late for them.

    A micro-batch's watermark is the newest event time of all batches before it less `late`; rows older than that go
    to the side table, the others into the batch's sums per day. Every batch writes to places of its own number, so a
    repeated batch replaces what it wrote, and both tables together hold the feed exactly. The newest times are one
    row a batch; a row without a time counts as late.
    """

    def __init__(self, base: str, ts: str, late: str, sums: Mapping[str, Column], merged: Mapping[str, str]):
        self.base, self.ts, self.late, self.sums, self.merged = base.rstrip("/"), ts, late, dict(sums), dict(merged)

    def _table(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.base}/{name}")

    def take(self, batch: DataFrame, number: int) -> None:
        spark, at = batch.sparkSession, F.col(self.ts).cast("timestamp")
        batch = cut(batch)
        batch.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{self.base}/newest/batch={number}")
        marks = self._table(spark, "newest").filter(F.col("batch") < number)
        passed = marks.agg((F.max("newest") - F.expr(f"interval {self.late}")).alias("mark")).scalar()
        on_time = F.coalesce(at >= passed, at.isNotNull() & passed.isNull())
        batch.filter(~on_time).write.mode("overwrite").parquet(f"{self.base}/late/batch={number}")
        daily = batch.filter(on_time).groupBy(F.to_date(at).alias("day")).agg(*(c.alias(n) for n, c in self.sums.items()))
        daily.write.mode("overwrite").parquet(f"{self.base}/daily/batch={number}")

    def run(self, stream: DataFrame) -> None:
        query = stream.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.base}/state")
        query.trigger(availableNow=True).start().awaitTermination()

    def totals(self, spark: SparkSession) -> DataFrame:
        merged = (F.sum(n).cast(self.merged[n]).alias(n) for n in self.sums)
        return self._table(spark, "daily").groupBy("day").agg(*merged)

    def too_late(self, spark: SparkSession) -> DataFrame:
        return self._table(spark, "late").drop("batch")


def revenue_with_late(base: str, *, late: str = "1 day") -> LateSplit:
    """Revenue and number of payments per day, with the payments that came too late kept apart."""
    sums = {"revenue": F.sum("amount_paid"), "payments": F.count("*")}
    return LateSplit(base, "payment_date", late, sums, {"revenue": "decimal(18,2)", "payments": "long"})
