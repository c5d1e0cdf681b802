"""Scans with a fixed schema, literal row loads, parameterised selects and column views."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

from wardline.schema import DEFAULTS, TABLES


class Hospital:
    """The hospital tables by name, built on first use. Attribute access returns the DataFrame."""

    def __init__(
        self, spark: SparkSession, tables: Mapping[str, DataFrame | Callable[[], DataFrame]], root: str | None = None
    ):
        self.spark = spark
        self.root = root
        self._tables = dict(tables)

    def table(self, name: str) -> DataFrame:
        found = self._tables[name]
        if callable(found) and not isinstance(found, DataFrame):
            found = self._tables[name] = found()
        return found

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._tables:
            raise AttributeError(name)
        return self.table(name)

    def __contains__(self, name: str) -> bool:
        return name in self._tables

    def replaced(self, **tables: DataFrame) -> Hospital:
        return Hospital(self.spark, {**self._tables, **tables}, self.root)


def scan(spark: SparkSession, root: str, name: str) -> DataFrame:
    """Parquet scan of one hospital table; the schema is declared, never inferred."""
    return spark.read.schema(TABLES[name]).parquet(f"{root.rstrip('/')}/{name}")


def open_hospital(spark: SparkSession, root: str) -> Hospital:
    return Hospital(spark, {name: (lambda n=name: scan(spark, root, n)) for name in TABLES}, root)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Bring a frame to a table's columns: cast, fill declared defaults, add absent columns."""
    present = set(df.columns)
    defaults = DEFAULTS.get(name, {})
    columns = []
    for field in TABLES[name]:
        if field.name in present:
            columns.append(F.col(field.name).cast(field.dataType).alias(field.name))
        else:
            columns.append(F.lit(defaults.get(field.name)).cast(field.dataType).alias(field.name))
    return df.select(*columns)


def load_rows(spark: SparkSession, name: str, rows: Iterable[Mapping[str, object]]) -> DataFrame:
    """Small literal row loads; omitted columns take the table's default."""
    defaults = DEFAULTS.get(name, {})
    schema = TABLES[name]
    literal = [tuple({**defaults, **row}.get(field.name) for field in schema) for row in rows]
    text = ", ".join(f"{f.name} {'string' if f.dataType.typeName() != 'boolean' else 'boolean'}" for f in schema)
    as_text = [tuple(v if v is None or isinstance(v, bool) else str(v) for v in row) for row in literal]
    frame = spark.createDataFrame(as_text, text)
    return frame.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def select_rows(h: Hospital, query: str, tables: Iterable[str], **params: object) -> DataFrame:
    """Parameterised SQL over hospital tables: values go in as named parameters, never as text.

    Tables are written {name} in the query, parameters :name.
    """
    return h.spark.sql(query, args=params or None, **{t: h.table(t) for t in tables})


def select_one(h: Hospital, query: str, tables: Iterable[str], **params: object) -> DataFrame:
    """First row of a parameterised select as a frame of at most one row."""
    return select_rows(h, query, tables, **params).limit(1)


def shown(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Select the known columns of a mapping, in its order, under their display names."""
    known = {c: label for c, label in columns.items() if c in df.columns}
    return df.select(*known).withColumnsRenamed(known)
