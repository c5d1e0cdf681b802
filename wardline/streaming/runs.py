"""Running a stream over what is there now: sources by path, sinks in the shared folder."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from wardline.functions.dates import AsOf, stamp
from wardline.sources.sinks import append_audit
from wardline.sources.staging import shared_folder


def parquet_stream(
    spark: SparkSession, folder: str, schema: StructType, *, names: str = "*", files_per_batch: int = 1000
) -> DataFrame:
    """Files of a folder as a stream, a bounded number per micro-batch; `names` is a file name pattern."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    return reader.option("pathGlobFilter", names).parquet(folder)


def run_to_parquet(stream: DataFrame, *, mode: str = "append", then: Callable[[], None] | None = None) -> DataFrame:
    """Process everything available, then return the sink's content.

    With `then`, the query ends, that is called (it may add files to the sources), and the query goes on from its
    checkpoint.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"
    for before in (None, then) if then else (None,):
        if before:
            before()
        query = (
            stream.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/state")
            .outputMode(mode)
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")


def with_last_tick(stream: DataFrame, stamp: str, newest: str) -> tuple[DataFrame, Callable[[], None]]:
    """The stream with a source that is empty at first, and what adds one row to it: its time is `newest`, the rest null.

    A feed that ends leaves its last rows behind the watermark; a row from after its end moves it past them.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark)}/ticks/{uuid.uuid4().hex}"
    spark.createDataFrame([], stream.schema).write.parquet(folder)

    def add() -> None:
        columns = [F.lit(newest if f.name == stamp else None).cast(f.dataType).alias(f.name) for f in stream.schema]
        spark.range(1).select(*columns).write.mode("append").parquet(folder)

    return stream.unionByName(spark.readStream.schema(stream.schema).parquet(folder)), add


def run_latest(stream: DataFrame, key: str) -> DataFrame:
    """Process everything available in update mode and return each key's last figures.

    Every batch adds its updates to a table together with the batch number; a repeated batch writes to
    the same place again.
    """
    spark = stream.sparkSession
    base = f"{shared_folder(spark)}/streams/{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    query = (
        stream.writeStream.foreachBatch(keep)
        .option("checkpointLocation", f"{base}/state")
        .outputMode("update")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    numbered = StructType([*stream.schema.fields, StructField("batch", LongType())])
    updates = spark.read.schema(numbered).parquet(f"{base}/out")
    others = [c for c in stream.columns if c != key]
    newest = F.max_by(F.struct(*others), F.col("batch")).alias("_row")
    return updates.groupBy(key).agg(newest).select(key, "_row.*")


def audit_stream(feed: DataFrame, *, as_of: AsOf | None = None, lateness: str | None = None) -> DataFrame:
    """A change feed (change_id, table_name, operation, record_id, old_values, new_values) as audit entries.

    One entry per change, under the feed's own number: equal changes are two entries. Entries carry the feed's
    changed_at or, with as_of, that moment. With `lateness`, a change that is delivered again within that time of its
    changed_at is dropped by its number, and so is any change, also a new one, that comes later than that behind the
    newest. Without it nothing is lost, and what comes twice is left to `append_audit(once=True)`.
    """
    if lateness is not None:
        timed = feed.withColumn("_at", F.col("changed_at").cast("timestamp")).withWatermark("_at", lateness)
        feed = timed.dropDuplicatesWithinWatermark(["change_id"]).drop("_at")
    return feed.select(
        F.col("change_id").alias("log_id"), "table_name", "operation", "record_id", "old_values", "new_values",
        F.lit(None).cast("long").alias("changed_by"),
        (F.col("changed_at").cast("timestamp_ntz") if as_of is None else stamp(as_of)).alias("changed_at"),
    )


def run_to_audit_log(stream: DataFrame, path: str, *, checkpoint: str) -> None:
    """Append everything available to the audit log, each log_id once; a repeated micro-batch adds nothing."""
    query = (
        stream.writeStream.foreachBatch(lambda batch, _: append_audit(batch, path, once=True))
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
