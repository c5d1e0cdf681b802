"""Payments applied to bills in arrival order."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.money import money
from wardline.functions.ordering import highest, with_sequence
from wardline.functions.rules import transaction_ref
from wardline.plans.admission import FOLD_LIMIT, admit_in_order
from wardline.plans.common import REASON, first_failure, patched

# A payment may exceed what is owed by one cent; reasons as the rule words them.
TOLERANCE_CENTS = 1
NOT_FOUND = "Bill not found."
ALREADY_PAID = "This bill has already been fully paid."
NOT_POSITIVE = "Payment amount must be greater than 0."
MODES = ("Cash", "Card", "UPI", "Insurance")
UNKNOWN_MODE = "Unknown payment mode."


@dataclass
class PaymentRun:
    payments: DataFrame
    rejected: DataFrame
    bills: DataFrame


def _cents(column: str) -> Column:
    return (F.col(column).cast("decimal(12,2)") * 100).cast("long")


def _amount(cents: Column) -> Column:
    return (cents.cast("decimal(18,0)") * F.lit("0.01").cast("decimal(3,2)")).cast("decimal(12,2)")


def exceeds(amount: Column, outstanding: Column) -> Column:
    return F.concat(
        F.lit("Payment of ₹"), amount.cast("string"), F.lit(" would exceed outstanding amount of ₹"),
        outstanding.cast("string"), F.lit("."),
    )


def decide_payments(
    bills: DataFrame, payments: DataFrame | None, requests: DataFrame, fold_limit: int = FOLD_LIMIT
) -> DataFrame:
    """Every request with `admitted` and the reason it was refused.

    requests: request_id, bill_id, amount, payment_mode, transaction_ref, received_by, request_ts.
    Bills already paid in full when the run starts, unknown bills and rows without an amount are refused
    outright, as are unknown modes and card payments without a reference; everything else is decided in
    (request_ts, request_id) order, in whole cents.
    """
    owed = bills.select("bill_id", "net_payable", F.col("status").alias("_status"))
    if payments is not None:
        earlier = payments.groupBy("bill_id").agg(F.sum("amount_paid").alias("_earlier"))
        owed = owed.join(earlier, "bill_id", "left").withColumn("_earlier", money(F.coalesce("_earlier", F.lit(0))))
    else:
        owed = owed.withColumn("_earlier", money(F.lit(0)))
    joined = (
        requests.join(owed, "bill_id", "left")
        .withColumn("_open", F.col("net_payable").isNotNull() & (F.col("_status") != "Paid"))
        .withColumn("_room", _cents("net_payable") - _cents("_earlier"))
        .withColumn("_bad_mode", ~F.coalesce(F.col("payment_mode").isin(*MODES), F.lit(False)))
        .withColumn("_no_ref", transaction_ref("transaction_ref", "payment_mode"))
        .withColumn("_cents", F.when(F.col("_open") & ~F.col("_bad_mode") & F.col("_no_ref").isNull(), _cents("amount")))
    )
    ruled = admit_in_order(
        joined,
        key="bill_id",
        order=("request_ts", "request_id"),
        row_id="request_id",
        units="_cents",
        room="_room",
        slack=TOLERANCE_CENTS,
        fold_limit=fold_limit,
    )
    closed = (F.col("_status") == "Paid") | ((F.col("used_before") > 0) & (F.col("used_before") >= F.col("_room")))
    reason = first_failure(
        (F.col("admitted"), F.lit(None).cast("string")),
        (F.col("net_payable").isNull(), NOT_FOUND),
        (closed, ALREADY_PAID),
        (F.col("_bad_mode"), UNKNOWN_MODE),
        F.col("_no_ref"),
        (F.coalesce(F.col("amount") <= 0, F.lit(True)), NOT_POSITIVE),
        (F.lit(True), exceeds(money("amount"), _amount(F.col("_room") - F.col("used_before")))),
    )
    return ruled.withColumn(REASON, reason).drop("_status", "_earlier", "_open", "_cents", "_bad_mode", "_no_ref")


def record_payments(
    bills: DataFrame, payments: DataFrame | None, requests: DataFrame, fold_limit: int = FOLD_LIMIT
) -> PaymentRun:
    decided = decide_payments(bills, payments, requests, fold_limit)
    accepted = decided.filter("admitted")
    last = F.lit(0) if payments is None else highest(payments, "payment_id")
    new = with_sequence(accepted, [F.col("request_ts"), F.col("request_id")], "payment_id", last).select(
        "payment_id",
        "bill_id",
        money("amount").alias("amount_paid"),
        "payment_mode",
        F.col("request_ts").alias("payment_date"),
        "transaction_ref",
        "received_by",
        "request_id",
    )
    status = (
        new.groupBy("bill_id")
        .agg(F.sum("amount_paid").alias("_new"))
        .join(bills.select("bill_id", "net_payable"), "bill_id")
    )
    if payments is not None:
        earlier = payments.groupBy("bill_id").agg(F.sum("amount_paid").alias("_earlier"))
        status = status.join(earlier, "bill_id", "left")
    else:
        status = status.withColumn("_earlier", F.lit(0))
    paid = F.col("_new") + F.coalesce("_earlier", F.lit(0))
    status = status.select("bill_id", F.when(paid >= F.col("net_payable"), "Paid").otherwise("Partial").alias("status"))
    rejected = decided.filter(~F.col("admitted")).select("request_id", "bill_id", "amount", "request_ts", REASON)
    return PaymentRun(new, rejected, patched(bills, status, "bill_id", ["status"]))
