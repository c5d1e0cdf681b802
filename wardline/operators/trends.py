"""Daily trends and breakdowns: the data sets behind the charts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.dates import AsOf, day, in_month, shifted, since_day
from wardline.functions.money import sum_money
from wardline.functions.ordering import top, up
from wardline.sources.tables import Hospital


def _count_if(condition: Column) -> Column:
    return F.sum(F.when(condition, 1).otherwise(0)).cast("long")


def fill_days(series: DataFrame, as_of: AsOf, days: int, zero: dict[str, object]) -> DataFrame:
    """Optional: give every day of the window a row. The calendar is one row per day of the window."""
    first = F.lit(shifted(as_of, 1 - days))
    spark = series.sparkSession
    calendar = spark.range(1).select(F.explode(F.sequence(first, day(as_of))).alias("day"))
    return calendar.join(series, "day", "left").fillna(zero)


def appointments_per_day(h: Hospital, *, as_of: AsOf, days: int = 7) -> DataFrame:
    status = F.col("status")
    return (
        h.appointments.filter(F.col("appt_date") >= F.lit(shifted(as_of, 1 - days)))
        .groupBy(F.col("appt_date").alias("day"))
        .agg(
            F.count("*").alias("total"),
            _count_if(status == "Completed").alias("completed"),
            _count_if(status == "Cancelled").alias("cancelled"),
            _count_if(status.isin("Pending", "Confirmed")).alias("pending"),
        )
        .orderBy("day")
    )


def revenue_per_day(h: Hospital, *, as_of: AsOf, days: int = 30) -> DataFrame:
    return (
        h.payments.filter(since_day("payment_date", as_of, days - 1))
        .groupBy(F.to_date("payment_date").alias("day"))
        .agg(sum_money("amount_paid").alias("revenue"))
        .orderBy("day")
    )


def stock_band() -> Column:
    """Out at zero, low up to the reorder level, otherwise ok."""
    stock, reorder = F.col("stock_quantity"), F.col("reorder_level")
    return F.when(stock == 0, "out").when(stock <= reorder, "low").otherwise("ok")


def lowest_stock(h: Hospital, *, n: int = 10) -> DataFrame:
    chosen = top(h.medicines, [up("stock_quantity"), up("medicine_id")], n)
    return chosen.select("medicine_id", "brand_name", "stock_quantity", "reorder_level", stock_band().alias("band"))


def daily_activity(h: Hospital, *, as_of: AsOf, days: int = 14) -> DataFrame:
    """New patients and appointments per day; a day known to either side appears, gaps count zero."""
    joined_up = (
        h.patients.filter(since_day("registration_date", as_of, days - 1))
        .groupBy(F.to_date("registration_date").alias("day"))
        .agg(F.count("*").alias("new_patients"))
    )
    visits = (
        h.appointments.filter(F.col("appt_date") >= F.lit(shifted(as_of, 1 - days)))
        .groupBy(F.col("appt_date").alias("day"))
        .agg(F.count("*").alias("appointments"))
    )
    return joined_up.join(visits, "day", "full").fillna(0, ["new_patients", "appointments"]).orderBy("day")


def appointments_per_department(h: Hospital, *, as_of: AsOf) -> DataFrame:
    """Reduce to one row per doctor first, so the joins carry doctors and not appointments."""
    per_doctor = (
        h.appointments.filter(in_month("appt_date", as_of)).groupBy("doctor_id").agg(F.count("*").alias("_visits"))
    )
    return (
        per_doctor.join(h.doctors.select("doctor_id", "dept_id"), "doctor_id")
        .join(h.departments.select("dept_id", "dept_name"), "dept_id")
        .groupBy("dept_name")
        .agg(F.sum("_visits").cast("long").alias("appointments"))
        .orderBy(F.col("appointments").desc(), "dept_name")
    )


def bills_per_status(h: Hospital) -> DataFrame:
    return h.bills.groupBy("status").agg(
        F.count("*").alias("bills"), sum_money("net_payable").alias("total_value")
    )
