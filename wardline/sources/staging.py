"""Written tables in the shared folder: they cut lineage and survive the loss of executors.

The folder is the one the cluster names in spark.checkpoint.dir or by setCheckpointDir. Only a local
session, whose executor is the driver itself, gets one of its own where neither is set; elsewhere that is
an error, as executors would write to disks that the others do not see.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_own_folder: dict[str, str] = {}
_written: dict[tuple[str, str], str] = {}


def shared_folder(spark: SparkSession) -> str:
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    app = context.applicationId
    if named:
        return f"{named.rstrip('/')}/wardline/{app}"
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    if app not in _own_folder:
        _own_folder[app] = tempfile.mkdtemp(prefix="wardline-")
    return f"{_own_folder[app]}/{app}"


def written(df: DataFrame) -> str:
    """Write a frame under a fresh name and return its path."""
    path = f"{shared_folder(df.sparkSession)}/cut/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write a frame once and go on from the written table."""
    return df.sparkSession.read.schema(df.schema).parquet(written(df))


def staged(spark: SparkSession, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A named table of this application: written at first use, then read back."""
    key = (spark.sparkContext.applicationId, name)
    if key not in _written:
        frame = build()
        path = f"{shared_folder(spark)}/tables/{name}-{uuid.uuid4().hex}"
        frame.write.parquet(path)
        _written[key] = path
    return spark.read.parquet(_written[key])
