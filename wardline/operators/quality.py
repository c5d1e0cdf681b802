"""Data-quality scans: split rows by rules, count failures per rule, check table constraints."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardline.schema import ENUMS, KEYS, LENGTHS, TABLES
from wardline.sources.tables import Hospital


VALID, QUARANTINED = "valid", "quarantined"


@dataclass
class Scan:
    valid: DataFrame
    quarantined: DataFrame
    failures: DataFrame


def quality_scan(df: DataFrame, rules: Mapping[str, Column]) -> Scan:
    """Rows that pass every rule, rows that fail with their messages, and failures per rule.

    The failures are one aggregate with one counter per rule, unpivoted afterwards.
    """
    marked = df.withColumn("_errors", F.array_compact(F.array(*rules.values())))
    counters = [F.sum(F.when(rule.isNotNull(), 1).otherwise(0)).cast("long").alias(n) for n, rule in rules.items()]
    failures = df.agg(*counters).unpivot([], list(rules), "rule", "failures").select("rule", F.coalesce("failures", F.lit(0)).alias("failures"))
    return Scan(
        marked.filter(F.size("_errors") == 0).drop("_errors"),
        marked.filter(F.size("_errors") > 0).withColumnRenamed("_errors", "errors"),
        failures,
    )


@dataclass
class Screened:
    """Both outcomes of a screening as read from its folder, rows seen, and failures per rule."""

    valid: DataFrame
    quarantined: DataFrame
    rows: int
    failures: dict[str, int]


@contextmanager
def _open_files(spark: SparkSession, number: int) -> Iterator[None]:
    """Up to so many files of a partitioned write are open in a task; the session's own number comes back afterwards."""
    name = "spark.sql.maxConcurrentOutputFileWriters"
    before = spark.conf.get(name)
    spark.conf.set(name, max(number, int(before)))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def screen(df: DataFrame, rules: Mapping[str, Column], path: str) -> Screened:
    """Write a table once, parted into valid and quarantined rows (these with their messages), counting on the way.

    The input is read a single time: the counters are metrics of the write, gathered by its tasks. A task keeps both
    files open, so that its rows need no sort by outcome. The rows that the files have are compared with the rows counted, so that a count that a repeated task has spoilt is an error.
    """
    counters = [F.count_if(rule.isNotNull()).alias(name) for name, rule in rules.items()]
    errors = F.array_compact(F.array(*rules.values()))
    seen = Observation()
    marked = df.observe(seen, F.count(F.lit(1)).alias("_rows"), *counters).withColumn("errors", errors)
    outcome = F.when(F.size("errors") == 0, VALID).otherwise(QUARANTINED)
    with _open_files(df.sparkSession, 2):
        marked.withColumn("outcome", outcome).write.mode("errorifexists").partitionBy("outcome").parquet(path)
    counts = dict(seen.get)
    rows = counts.pop("_rows")
    stored = df.sparkSession.read.schema(StructType([*marked.schema.fields, StructField("outcome", StringType())])).parquet(path)
    if stored.count() != rows:  # from the files' footers
        raise RuntimeError("rows counted differ from rows written")
    part = lambda name: stored.filter(F.col("outcome") == name).drop("outcome")
    return Screened(part(VALID).drop("errors"), part(QUARANTINED), rows, counts)


# Foreign keys, unique columns and value checks of the data model.
FOREIGN_KEYS = (
    ("patients", "insurance_id", "insurance"),
    ("doctors", "dept_id", "departments"),
    ("appointments", "patient_id", "patients"),
    ("appointments", "doctor_id", "doctors"),
    ("diagnoses", "appt_id", "appointments"),
    ("prescriptions", "diag_id", "diagnoses"),
    ("prescriptions", "medicine_id", "medicines"),
    ("lab_orders", "appt_id", "appointments"),
    ("lab_orders", "test_id", "lab_tests"),
    ("bills", "patient_id", "patients"),
    ("bills", "appt_id", "appointments"),
    ("bill_items", "bill_id", "bills"),
    ("payments", "bill_id", "bills"),
    ("bills", "generated_by", "users"),
    ("payments", "received_by", "users"),
    ("user_sessions", "user_id", "users"),
    ("audit_log", "changed_by", "users"),
    ("users", "role_id", "roles"),
)
UNIQUE = (("insurance", "policy_number"), ("patients", "phone"), ("users", "username"), ("roles", "role_name"))
CHECKS = (
    ("appointments", "appt_time within hours", "appt_time between '08:00:00' and '20:00:00'"),
    ("medicines", "stock_quantity >= 0", "stock_quantity >= 0"),
    ("medicines", "unit_price > 0", "unit_price > 0"),
    ("bills", "insurance_covered <= total_amount", "insurance_covered <= total_amount"),
    ("bills", "net_payable >= 0", "net_payable >= 0"),
    ("payments", "amount_paid > 0", "amount_paid > 0"),
)


def row_rules(name: str, columns: Sequence[str]) -> dict[str, Column]:
    """Violation conditions that one row can show: required, enumerated, length and value checks."""
    have = set(columns)
    rules = {
        f"{f.name} required": F.col(f.name).isNull() for f in TABLES[name] if not f.nullable and f.name in have
    }
    for (table, column), allowed in ENUMS.items():
        if table == name and column in have:
            rules[f"{column} in allowed values"] = F.col(column).isNotNull() & ~F.col(column).isin(*allowed)
    for column, limit in LENGTHS.get(name, {}).items():
        if column in have:
            rules[f"{column} at most {limit} characters"] = F.length(column) > limit
    for table, label, sql in CHECKS:
        if table == name:
            rules[label] = ~F.coalesce(F.expr(sql), F.lit(True))
    if name == "bills":
        rules["fully insured bill left open"] = (F.col("net_payable") == 0) & (F.col("status") != "Paid")
    return rules


def _finding(df: DataFrame, table: str, rule: str, count: Column) -> DataFrame:
    return df.agg(count.cast("long").alias("violations")).select(
        F.lit(table).alias("table_name"), F.lit(rule).alias("rule"), F.coalesce("violations", F.lit(0)).alias("violations")
    )


def duplicates(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that occur more than once (NULLs never clash)."""
    filled = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])
    return df.filter(filled).groupBy(*columns).count().filter("count > 1")


def constraint_findings(h: Hospital, tables: Sequence[str]) -> DataFrame:
    """(table_name, rule, violations) for every constraint of the given tables.

    All row rules of a table share one scan; keys and references are one aggregate or anti-join each.
    """
    parts: list[DataFrame] = []
    for name in tables:
        df = h.table(name)
        rules = row_rules(name, df.columns)
        counters = [F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(n.replace(".", " ")) for n, c in rules.items()]
        wide = df.agg(*counters)
        parts.append(
            wide.unpivot([], wide.columns, "rule", "violations").select(
                F.lit(name).alias("table_name"), "rule", F.coalesce("violations", F.lit(0)).alias("violations")
            )
        )
        keys = [KEYS[name]] + [c for t, c in UNIQUE if t == name]
        for column in keys:
            parts.append(_finding(duplicates(df, [column]), name, f"{column} unique", F.count("*")))
        if name == "appointments":
            live = df.filter(F.col("status") != "Cancelled")
            clashes = duplicates(live, ["doctor_id", "appt_date", "appt_time"])
            parts.append(_finding(clashes, name, "one live appointment per slot", F.count("*")))
        for table, column, target in FOREIGN_KEYS:
            if table == name and column in df.columns:
                # One row per referenced value goes into the join, however often it occurs.
                used = df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("_rows"))
                targets = h.table(target).select(F.col(KEYS[target]).alias(column))
                orphans = used.join(targets, column, "left_anti")
                parts.append(_finding(orphans, name, f"{column} exists in {target}", F.sum("_rows")))
    return reduce(DataFrame.unionByName, parts)
