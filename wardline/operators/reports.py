"""Report views and per-key functions, evaluated for all keys at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.functions.dates import AsOf, completed_years, day, years_by_days
from wardline.functions.money import sum_money_or_zero
from wardline.functions.ordering import down, up
from wardline.sources.partitions import live_slots
from wardline.sources.tables import Hospital


def patient_history(h: Hospital) -> DataFrame:
    patients = h.patients.select("patient_id", "full_name")
    doctors = h.doctors.select("doctor_id", F.col("full_name").alias("doctor"))
    findings = h.diagnoses.select("appt_id", F.col("description").alias("diagnosis"), "severity")
    return (
        h.appointments.select("appt_id", "patient_id", "doctor_id", "appt_date", "appt_type", "status")
        .join(patients, "patient_id")
        .join(doctors, "doctor_id")
        .join(findings, "appt_id", "left")
        .select("patient_id", "full_name", "appt_date", "appt_type", "doctor", "diagnosis", "severity", "status")
    )


def opd_queue(h: Hospital, *, as_of: AsOf) -> DataFrame:
    doctors = h.doctors.select("doctor_id", "dept_id", F.col("full_name").alias("doctor"))
    return (
        h.appointments.filter(F.col("appt_date") == day(as_of))
        .join(h.patients.select("patient_id", F.col("full_name").alias("patient")), "patient_id")
        .join(doctors, "doctor_id")
        .join(h.departments.select("dept_id", "dept_name"), "dept_id")
        .select("appt_id", "patient", "doctor", "dept_name", "appt_time", "appt_type", "status")
        .orderBy(up("appt_time"), up("appt_id"))
    )


def received_per_bill(h: Hospital) -> DataFrame:
    """Payments reduced to one row per bill before anything is joined to them."""
    return h.payments.groupBy("bill_id").agg(F.sum("amount_paid").cast("decimal(18,2)").alias("_received"))


def with_balance(h: Hospital, bills: DataFrame, paid: str, owed: str) -> DataFrame:
    """Add what was received and what is still owed per bill; no payments count as zero."""
    received = F.coalesce(F.col("_received"), F.lit(0).cast("decimal(18,2)"))
    return (
        bills.join(received_per_bill(h), "bill_id", "left")
        .withColumn(paid, received)
        .withColumn(owed, (F.col("net_payable") - F.col(paid)).cast("decimal(18,2)"))
        .drop("_received")
    )


def billing_summary(h: Hospital) -> DataFrame:
    bills = h.bills.join(h.patients.select("patient_id", F.col("full_name").alias("patient")), "patient_id")
    return with_balance(h, bills, "amount_received", "outstanding").select(
        "bill_id",
        "patient",
        "total_amount",
        "insurance_covered",
        "net_payable",
        "status",
        "bill_date",
        "amount_received",
        "outstanding",
    )


def low_stock(h: Hospital) -> DataFrame:
    return (
        h.medicines.filter(F.col("stock_quantity") <= F.col("reorder_level"))
        .select(
            "medicine_id",
            "brand_name",
            "category",
            "stock_quantity",
            "reorder_level",
            (F.col("reorder_level") - F.col("stock_quantity")).alias("shortage"),
        )
        .orderBy(down("shortage"), up("medicine_id"))
    )


def patient_age(h: Hospital, *, as_of: AsOf) -> DataFrame:
    """Completed years, and the age by days that the patient card shows."""
    return h.patients.select(
        "patient_id",
        completed_years("date_of_birth", as_of).cast("int").alias("age"),
        years_by_days("date_of_birth", as_of).alias("card_age"),
    )


def slot_availability(h: Hospital, slots: DataFrame) -> DataFrame:
    """slots: doctor_id, appt_date, appt_time. Free when no live appointment holds the slot."""
    slot = ["doctor_id", "appt_date", "appt_time"]
    held = live_slots(h, slots).select(*slot).distinct().withColumn("_held", F.lit(True))
    return slots.join(held, slot, "left").withColumn("available", F.col("_held").isNull()).drop("_held")


def deductions(h: Hospital) -> DataFrame:
    """Net payable per bill after the insurance deduction."""
    return h.bills.select("bill_id", F.col("net_payable").alias("deduction"))


def patient_active(h: Hospital) -> DataFrame:
    return h.patients.select("patient_id", (F.col("status") == "Active").alias("is_active"))


def revenue_total(payments: DataFrame) -> DataFrame:
    return payments.agg(sum_money_or_zero("amount_paid").alias("revenue"))
