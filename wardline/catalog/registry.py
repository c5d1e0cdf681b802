"""Registration of queries together with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from wardline.sources.star import hospital
from wardline.sources.tables import Hospital

AS_OF = date(1998, 6, 15)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def portable(df: DataFrame) -> DataFrame:
    """Result columns in types every engine shows alike: money as double, dates and stamps as text."""
    columns = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.date_format(column, "yyyy-MM-dd HH:mm:ss")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def query(name: str, check: str | None = None) -> Callable:
    """Register fn(h) under a name, with the SQL that must give the same rows."""

    def register(fn: Callable[[Hospital], DataFrame]) -> Callable[[Hospital], DataFrame]:
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # Stamps carry no zone; in UTC they pass through zoned functions unchanged.
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return portable(fn(hospital(spark, sf_dir)))

        QUERIES[name] = run
        if check is not None:
            CHECKS[name] = check
        return fn

    return register
