"""Dashboard figures: every set is one row, each table read once with conditional aggregates."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.dates import AsOf, day, on_day
from wardline.functions.money import sum_money_or_zero
from wardline.operators.reports import with_balance
from wardline.sources.tables import Hospital


def _count_if(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, 1).otherwise(0)), F.lit(0)).cast("long")


def _low() -> Column:
    return F.col("stock_quantity") <= F.col("reorder_level")


def _side_by_side(*figures: DataFrame) -> DataFrame:
    """One row from several one-row frames: union with the missing columns NULL, then keep the value."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), figures)
    names = [c for f in figures for c in f.columns]
    return stacked.agg(*[F.max(c).alias(c) for c in names])


def _revenue_on(h: Hospital, as_of: AsOf) -> DataFrame:
    return h.payments.filter(on_day("payment_date", as_of)).agg(sum_money_or_zero("amount_paid").alias("revenue_today"))


def _appointments_on(h: Hospital, as_of: AsOf) -> DataFrame:
    return h.appointments.filter(F.col("appt_date") == day(as_of))


def admin_figures(h: Hospital, *, as_of: AsOf) -> DataFrame:
    return _side_by_side(
        h.patients.agg(F.count("*").alias("patients")),
        h.doctors.agg(_count_if(F.col("status") == "Active").alias("active_doctors")),
        _appointments_on(h, as_of).agg(F.count("*").alias("appointments_today")),
        _revenue_on(h, as_of),
        h.medicines.agg(_count_if(_low()).alias("low_stock")),
    )


def admin_alerts(h: Hospital) -> DataFrame:
    """Alert classes that have something to report."""
    low = h.medicines.filter(_low()).agg(F.count("*").alias("n")).select(F.lit("Low Stock Medicines").alias("alert"), "n")
    pending = h.lab_orders.filter(F.col("status") == "Pending").agg(F.count("*").alias("n"))
    unpaid = h.bills.filter(F.col("status") != "Paid").agg(F.count("*").alias("n"))
    return (
        low.unionByName(pending.select(F.lit("Pending Lab Orders").alias("alert"), "n"))
        .unionByName(unpaid.select(F.lit("Unpaid Bills").alias("alert"), "n"))
        .filter(F.col("n") > 0)
    )


def billing_figures(h: Hospital, *, as_of: AsOf) -> DataFrame:
    open_bills = with_balance(h, h.bills.filter(F.col("status") != "Paid").select("bill_id", "net_payable"), "paid", "owed")
    return _side_by_side(
        _revenue_on(h, as_of),
        open_bills.agg(sum_money_or_zero("owed").alias("outstanding"), F.count("*").alias("pending_bills")),
    )


def doctor_day(h: Hospital, *, as_of: AsOf) -> DataFrame:
    """Per doctor with appointments on the day: all, completed, still open."""
    return (
        _appointments_on(h, as_of)
        .groupBy("doctor_id")
        .agg(
            F.count("*").alias("total"),
            _count_if(F.col("status") == "Completed").alias("completed"),
            _count_if(F.col("status").isin("Pending", "Confirmed")).alias("pending"),
        )
    )


def reception_figures(h: Hospital, *, as_of: AsOf) -> DataFrame:
    return _side_by_side(
        h.patients.agg(F.count("*").alias("patients")),
        _appointments_on(h, as_of).agg(
            F.count("*").alias("appointments_today"), _count_if(F.col("status") == "Pending").alias("pending_today")
        ),
    )


def lab_figures(h: Hospital, *, as_of: AsOf) -> DataFrame:
    today = on_day("result_date", as_of)
    return h.lab_orders.agg(
        _count_if(F.col("status") == "Pending").alias("pending"),
        _count_if((F.col("status") == "Done") & today).alias("done_today"),
        _count_if(F.col("is_abnormal") & today).alias("abnormal_today"),
    )


def pharmacy_figures(h: Hospital) -> DataFrame:
    return h.medicines.agg(
        F.count("*").alias("medicines"),
        _count_if(_low()).alias("low_stock"),
        _count_if(F.col("stock_quantity") == 0).alias("out_of_stock"),
    )
