"""Bills for finished appointments: itemise, total, deduct cover, number, complete the appointment."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from wardline.functions.dates import AsOf, stamp
from wardline.functions.money import money
from wardline.functions.ordering import first_of, highest, with_sequence
from wardline.plans.common import REASON, first_failure, known, patched
from wardline.sources.tables import Hospital

# Service names, order of items on a bill, days until a bill is due, reason text.
CONSULTATION, LAB, PHARMACY = "Consultation", "Lab", "Pharmacy"
CONSULTATION_TEXT = "Doctor Consultation Fee"
DUE_DAYS = 7
ALREADY_BILLED = "A bill has already been generated for this appointment."
UNKNOWN_APPOINTMENT = "Appointment not found."


@dataclass
class BillRun:
    bills: DataFrame
    items: DataFrame
    rejected: DataFrame
    appointments: DataFrame


def consultation_lines(h: Hospital, appts: DataFrame) -> DataFrame:
    fee = F.coalesce(F.col("opd_fee"), F.lit(0)).cast("decimal(10,2)")
    return appts.join(h.doctors.select("doctor_id", "opd_fee"), "doctor_id", "left").select(
        "appt_id",
        F.lit(CONSULTATION).alias("service_type"),
        F.lit(CONSULTATION_TEXT).alias("description"),
        F.lit(1).alias("quantity"),
        fee.alias("unit_price"),
        fee.alias("total"),
        F.col("appt_id").alias("source_id"),
    )


def lab_lines(h: Hospital, appts: DataFrame | None = None) -> DataFrame:
    """One line per lab order. The test catalogue is small; Spark broadcasts it when its size allows."""
    orders = h.lab_orders.select("order_id", "appt_id", "test_id")
    if appts is not None:
        orders = orders.join(appts.select("appt_id"), "appt_id", "left_semi")
    return orders.join(h.lab_tests.select("test_id", "test_name", "price"), "test_id").select(
        "appt_id",
        F.lit(LAB).alias("service_type"),
        F.col("test_name").alias("description"),
        F.lit(1).alias("quantity"),
        F.col("price").cast("decimal(10,2)").alias("unit_price"),
        F.col("price").cast("decimal(10,2)").alias("total"),
        F.col("order_id").alias("source_id"),
    )


def pharmacy_lines(h: Hospital, appts: DataFrame | None = None) -> DataFrame:
    """One line per prescription: unit price times days; frequency and dispensing do not enter."""
    diagnoses = h.diagnoses.select("diag_id", "appt_id")
    if appts is not None:
        diagnoses = diagnoses.join(appts.select("appt_id"), "appt_id", "left_semi")
    return (
        h.prescriptions.select("rx_id", "diag_id", "medicine_id", "duration_days")
        .join(diagnoses, "diag_id")
        .join(h.medicines.select("medicine_id", "brand_name", "unit_price"), "medicine_id")
        .select(
            "appt_id",
            F.lit(PHARMACY).alias("service_type"),
            F.col("brand_name").alias("description"),
            F.col("duration_days").alias("quantity"),
            F.col("unit_price").cast("decimal(10,2)").alias("unit_price"),
            (F.col("unit_price") * F.col("duration_days")).cast("decimal(10,2)").alias("total"),
            F.col("rx_id").alias("source_id"),
        )
    )


def admit_bill_requests(h: Hospital, requests: DataFrame, as_of: AsOf, existing: DataFrame | None) -> DataFrame:
    """Requests with a reason, NULL for the one request per unbilled appointment that makes the bill."""
    if "request_ts" not in requests.columns:
        requests = requests.withColumn("request_ts", stamp(as_of))
    checked = known(requests, h.appointments, "appt_id", "_known")
    if existing is None:
        checked = checked.withColumn("_billed", F.lit(False))
    else:
        billed = existing.filter(F.col("appt_id").isNotNull()).select("appt_id").distinct()
        checked = known(checked, billed, "appt_id", "_billed")
    valid = checked.filter(F.col("_known") & ~F.col("_billed"))
    winners = first_of(valid, ["appt_id"], ["request_ts", "request_id"], "request_id")
    checked = known(checked, winners, "request_id", "_first")
    reason = first_failure(
        (F.col("_billed"), ALREADY_BILLED),
        (~F.col("_known"), UNKNOWN_APPOINTMENT),
        (~F.col("_first"), ALREADY_BILLED),
    )
    return checked.withColumn(REASON, reason).drop("_known", "_billed", "_first")


def price_bills(h: Hospital, accepted: DataFrame, items: DataFrame) -> DataFrame:
    """Totals, cover and net per numbered bill. Cover looks at the policy amount only."""
    totals = items.groupBy("bill_id").agg(money(F.sum("total")).alias("total_amount"))
    covered = money(F.coalesce(F.least("coverage_amount", "total_amount"), F.lit(0)))
    cover = h.patients.select("patient_id", "insurance_id").join(
        h.insurance.select("insurance_id", "coverage_amount"), "insurance_id"
    )
    return (
        accepted.join(totals, "bill_id")
        .join(cover.select("patient_id", "coverage_amount"), "patient_id", "left")
        .withColumn("insurance_covered", F.when(F.col("coverage_amount").isNull(), money(F.lit(0))).otherwise(covered))
        .withColumn("net_payable", money(F.col("total_amount") - F.col("insurance_covered")))
        .drop("coverage_amount")
    )


def generate_bills(h: Hospital, requests: DataFrame, *, as_of: AsOf, existing: DataFrame | None) -> BillRun:
    """requests: request_id, appt_id, generated_by and optionally request_ts (else the as-of moment).

    existing: the bills there already are, or None. Two tables are written on the way: the accepted
    requests with their bill number, and the items, which are both a result and the source of the totals.
    """
    decided = admit_bill_requests(h, requests, as_of, existing)
    rejected = decided.filter(F.col(REASON).isNotNull()).select("request_id", "appt_id", REASON)
    accepted = with_sequence(
        decided.filter(F.col(REASON).isNull())
        .drop(REASON)
        .join(h.appointments.select("appt_id", "patient_id", "doctor_id"), "appt_id"),
        [F.col("request_ts"), F.col("request_id")],
        "bill_id",
        F.lit(0) if existing is None else highest(existing, "bill_id"),
    )
    place = F.when(F.col("service_type") == CONSULTATION, 1).when(F.col("service_type") == LAB, 2).otherwise(3)
    lines = consultation_lines(h, accepted).unionByName(lab_lines(h, accepted)).unionByName(pharmacy_lines(h, accepted))
    items = with_sequence(
        lines.join(accepted.select("appt_id", "bill_id"), "appt_id").withColumn("_place", place),
        [F.col("bill_id"), F.col("_place"), F.col("source_id")],
        "item_id",
        highest(h.bill_items, "item_id") if existing is not None and "bill_items" in h else F.lit(0),
    ).select("item_id", "bill_id", "service_type", "description", "quantity", "unit_price", "total")
    bills = price_bills(h, accepted, items).select(
        "bill_id",
        "patient_id",
        "appt_id",
        "total_amount",
        "insurance_covered",
        "net_payable",
        F.col("request_ts").alias("bill_date"),
        F.date_add(F.col("request_ts").cast("date"), DUE_DAYS).alias("due_date"),
        F.lit("Unpaid").alias("status"),
        "generated_by",
    )
    completed = accepted.select("appt_id", F.lit("Completed").alias("status"))
    return BillRun(bills, items, rejected, patched(h.appointments, completed, "appt_id", ["status"]))
