"""Table images that can be compared without reading what they have in common.

An image is stored by bucket of its key, with a digest of every bucket beside it. A digest does not depend on the
order of rows or on files: number of rows, and exclusive-or and sum of two hashes of whole rows, nulls included. Two
images are compared bucket by bucket: only those whose digests differ are read, so a few changes in a large table
read a few buckets of each image.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BUCKETS = 256
_BUCKET = "_bucket"


def _row_hash(columns: list[str], salt: int) -> Column:
    # a hash of several columns passes nulls over: which ones are null is hashed too
    return F.xxhash64(F.lit(salt), *(F.col(c) for c in columns), *(F.col(c).isNull() for c in columns))


def digests(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per bucket, by partial aggregation."""
    total = F.sum(_row_hash(columns, 2).cast("decimal(38,0)"))
    return rows.groupBy(_BUCKET).agg(
        F.count("*").alias("rows"), F.bit_xor(_row_hash(columns, 1)).alias("mixed"), total.alias("total")
    )


def write_image(table: DataFrame, path: str, key: str, buckets: int = BUCKETS) -> None:
    columns = sorted(table.columns)
    dealt = table.withColumn(_BUCKET, F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    dealt.hint("rebalance", _BUCKET).write.mode("errorifexists").partitionBy(_BUCKET).parquet(f"{path}/rows")
    stored = table.sparkSession.read.parquet(f"{path}/rows")
    digests(stored, columns).coalesce(1).write.mode("errorifexists").parquet(f"{path}/digests")


def differing_buckets(spark: SparkSession, old: str, new: str) -> list[int]:
    """Buckets whose rows are not the same in two images with equal columns; at most the number of buckets."""
    one, other = (spark.read.parquet(f"{path}/digests") for path in (old, new))
    sides = one.select(_BUCKET, F.struct("rows", "mixed", "total").alias("one")).join(
        other.select(_BUCKET, F.struct("rows", "mixed", "total").alias("other")), _BUCKET, "full"
    )
    return sorted(r[0] for r in sides.filter(~F.col("one").eqNullSafe(F.col("other"))).select(_BUCKET).collect())


def read_image(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    rows = spark.read.parquet(f"{path}/rows")
    return (rows if buckets is None else rows.filter(F.col(_BUCKET).isin(buckets))).drop(_BUCKET)
