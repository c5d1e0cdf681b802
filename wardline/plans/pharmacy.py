"""Dispensing, restocking and low-stock alerts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wardline.plans.admission import FOLD_LIMIT, admit_in_order
from wardline.plans.common import REASON, Outcome, first_failure, known, patched
from wardline.sources.tables import Hospital

# Reason texts and limits.
NO_PRESCRIPTION = "Prescription not found."
DISPENSED = "Prescription has already been dispensed."
TOO_FEW = "Quantity must be at least 1."
OUT_OF_STOCK = "OUT OF STOCK — cannot dispense."
RESTOCK_MAX = 100_000
ORDER = ["request_ts", "request_id"]


@dataclass
class DispenseRun:
    accepted: DataFrame
    rejected: DataFrame
    medicines: DataFrame
    prescriptions: DataFrame
    warnings: DataFrame


def decide_dispense(h: Hospital, requests: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Every request with `admitted`, the units handed out before it and the reason for a refusal.

    requests: request_id, request_ts, rx_id, quantity. The stock guard runs per medicine in arrival order; a
    refusal takes nothing, and only a request that is granted closes its prescription for later ones.
    """
    scripts = h.prescriptions.select("rx_id", "medicine_id", "is_dispensed")
    stock = h.medicines.select("medicine_id", F.col("stock_quantity").cast("long").alias("_stock"))
    joined = requests.join(scripts, "rx_id", "left").join(stock, "medicine_id", "left")
    open_units = F.when(F.col("medicine_id").isNotNull() & ~F.col("is_dispensed"), F.col("quantity").cast("long"))
    ruled = admit_in_order(
        joined.withColumn("_units", open_units),
        key="medicine_id",
        order=ORDER,
        row_id="request_id",
        units="_units",
        room="_stock",
        fold_limit=fold_limit,
        once="rx_id",
    )
    left = F.col("_stock") - F.col("used_before")
    short = F.concat(
        F.lit("Cannot dispense "), F.col("quantity").cast("string"), F.lit(" units. Only "), left.cast("string"), F.lit(" in stock.")
    )
    reason = first_failure(
        (F.col("admitted"), F.lit(None).cast("string")),
        (F.col("is_dispensed").isNull(), NO_PRESCRIPTION),
        (F.col("is_dispensed") | F.col("closed"), DISPENSED),
        (F.coalesce(F.col("quantity") < 1, F.lit(True)), TOO_FEW),
        (left == 0, OUT_OF_STOCK),
        (F.lit(True), short),
    )
    return ruled.withColumn(REASON, reason).drop("closed", "_units", "is_dispensed")


def dispense(h: Hospital, requests: DataFrame, fold_limit: int = FOLD_LIMIT) -> DispenseRun:
    """A prescription is marked dispensed only when its stock was really taken."""
    decided = decide_dispense(h, requests, fold_limit)
    accepted = decided.filter("admitted").withColumn(
        "stock_after", F.col("_stock") - F.col("used_before") - F.col("quantity")
    )
    taken = accepted.groupBy("medicine_id").agg(F.sum("quantity").cast("int").alias("_taken"))
    stock = _moved(h.medicines, taken.withColumn("_delta", -F.col("_taken")))
    handed = accepted.select("rx_id", F.lit(True).alias("is_dispensed"))
    warnings = stock.join(taken, "medicine_id", "left_semi").filter(F.col("stock_quantity") <= F.col("reorder_level"))
    return DispenseRun(
        accepted.drop("admitted", REASON, "_stock"),
        decided.filter(~F.col("admitted")).select("request_id", "rx_id", REASON),
        stock,
        patched(h.prescriptions, handed, "rx_id", ["is_dispensed"]),
        warnings.select("medicine_id", "brand_name", "stock_quantity", "reorder_level"),
    )


def _moved(medicines: DataFrame, deltas: DataFrame) -> DataFrame:
    change = deltas.select("medicine_id", F.col("_delta").cast("int").alias("_delta"))
    stock = F.col("stock_quantity") + F.coalesce("_delta", F.lit(0))
    columns = [stock.cast("int").alias(c) if c == "stock_quantity" else F.col(c) for c in medicines.columns]
    return medicines.join(change, "medicine_id", "left").select(*columns)


def restock(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, medicine_id, quantity. Additions to one medicine add up."""
    checked = known(requests, h.medicines, "medicine_id", "_known")
    out_of_range = F.coalesce((F.col("quantity") < 1) | (F.col("quantity") > RESTOCK_MAX), F.lit(True))
    reason = first_failure(
        (~F.col("_known"), "Select a medicine."), (out_of_range, f"Quantity must be between 1 and {RESTOCK_MAX}.")
    )
    decided = checked.withColumn(REASON, reason).drop("_known")
    accepted = decided.filter(F.col(REASON).isNull()).drop(REASON)
    added = accepted.groupBy("medicine_id").agg(F.sum("quantity").alias("_delta"))
    return Outcome(
        accepted,
        decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON),
        {"medicines": _moved(h.medicines, added)},
    )


def alert_text() -> Column:
    return F.concat(
        F.lit("LOW STOCK ALERT: "), F.col("brand_name"), F.lit(" has only "), F.col("stock_quantity").cast("string"), F.lit(" units left")
    )


def low_stock_alerts(changed: DataFrame, *, strict: bool = True) -> DataFrame:
    """Alerts for changed medicines. The alert fires below the reorder level; not strict, also at it.

    Works on a batch of changed rows and on a stream of them alike.
    """
    stock, reorder = F.col("stock_quantity"), F.col("reorder_level")
    low = stock < reorder if strict else stock <= reorder
    return changed.filter(low).select("medicine_id", "brand_name", "stock_quantity", "reorder_level", alert_text().alias("message"))


def changed_medicines(before: DataFrame, after: DataFrame) -> DataFrame:
    old = before.select("medicine_id", F.col("stock_quantity").alias("_old"))
    return after.join(old, "medicine_id").filter(F.col("stock_quantity") != F.col("_old")).drop("_old")
