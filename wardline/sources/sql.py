"""The hospital in Spark SQL: tables and report views as temporary views, per-key functions as SQL functions."""

from __future__ import annotations

from pyspark.sql import DataFrame

from wardline.functions.dates import AsOf, to_datetime
from wardline.operators import reports
from wardline.schema import TABLES
from wardline.sources.tables import Hospital

# Scalar SQL functions over the views. Spark turns their subqueries into joins, so a call per row of a
# table is one join and not one lookup per row. max() states that a key finds at most one row.
FUNCTIONS = {
    "completed_years": """(p_born date, p_as_of date) returns int return
        year(p_as_of) - year(p_born)
        - case when month(p_born) * 100 + day(p_born) > month(p_as_of) * 100 + day(p_as_of) then 1 else 0 end""",
    "get_patient_age": """(p_patient_id bigint, p_as_of date) returns int return
        completed_years((select max(date_of_birth) from patients where patient_id = p_patient_id), p_as_of)""",
    "is_slot_available": """(p_doctor_id bigint, p_date date, p_time string) returns boolean return (
        select count(*) = 0 from appointments
        where doctor_id = p_doctor_id and appt_date = p_date and appt_time = p_time and status <> 'Cancelled')""",
    "calculate_deduction": """(p_bill_id bigint) returns decimal(12,2) return (
        select max(net_payable) from bills where bill_id = p_bill_id)""",
    "is_patient_active": """(p_patient_id bigint) returns boolean return (
        select bool_or(status = 'Active') from patients where patient_id = p_patient_id)""",
}


def create_views(h: Hospital, *, as_of: AsOf) -> None:
    """Temporary views for every table there is, the four report views and the functions."""
    for name in TABLES:
        if name in h:
            h.table(name).createOrReplaceTempView(name)
    views: dict[str, DataFrame] = {
        "vw_patient_history": reports.patient_history(h),
        "vw_opd_queue": reports.opd_queue(h, as_of=to_datetime(as_of).date()),
        "vw_billing_summary": reports.billing_summary(h),
        "vw_low_stock": reports.low_stock(h),
    }
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    for name, body in FUNCTIONS.items():
        h.spark.sql(f"create or replace temporary function {name}{body}")
