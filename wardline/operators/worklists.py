"""Worklists and listings. Lists the reference shows for one doctor or patient are computed for all.

NULLs sort last ascending and first descending; a key breaks ties before any limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.dates import AsOf, day, on_day
from wardline.functions.ordering import down, top, top_per, up
from wardline.operators.reports import with_balance
from wardline.operators.trends import stock_band
from wardline.plans.billing import consultation_lines, lab_lines, pharmacy_lines
from wardline.sources.tables import Hospital

OPEN = ("Pending", "Confirmed")


def _patients(h: Hospital, *extra: str, name: str = "patient") -> DataFrame:
    return h.patients.select("patient_id", F.col("full_name").alias(name), *extra)


def _doctors(h: Hospital, *extra: str) -> DataFrame:
    return h.doctors.select("doctor_id", F.col("full_name").alias("doctor"), *extra)


# Appointments -------------------------------------------------------------------------------------


def schedule_today(h: Hospital, *, as_of: AsOf, n: int = 8) -> DataFrame:
    """The day's first appointments: cut to n before names are joined on."""
    first = top(h.appointments.filter(F.col("appt_date") == day(as_of)), [up("appt_time"), up("appt_id")], n)
    return (
        first.join(_patients(h), "patient_id")
        .join(_doctors(h), "doctor_id")
        .select("appt_id", "patient", "doctor", "appt_time", "appt_type", "status")
        .orderBy(up("appt_time"), up("appt_id"))
    )


def upcoming_per_doctor(h: Hospital, *, as_of: AsOf, n: int = 5) -> DataFrame:
    ahead = h.appointments.filter((F.col("appt_date") >= day(as_of)) & F.col("status").isin(*OPEN)).select(
        "appt_id", "patient_id", "doctor_id", "appt_date", "appt_time", "status"
    )
    first = top_per(ahead, "doctor_id", [up("appt_date"), up("appt_time"), up("appt_id")], n)
    return first.join(_patients(h), "patient_id").select(
        "doctor_id",
        "rank",
        "appt_id",
        F.date_format("appt_date", "dd-MMM-yyyy").alias("appt_day"),
        F.substring("appt_time", 1, 5).alias("appt_hour"),
        "patient",
        "status",
    )


def appointments_on(
    h: Hospital,
    *,
    on: AsOf,
    doctor_id: int | None = None,
    status: str | None = None,
    department: str | None = None,
    hide_cancelled: bool = False,
) -> DataFrame:
    """Appointments of a day. No status means all, or all but Cancelled with hide_cancelled."""
    wanted: Column = F.col("appt_date") == day(on)
    if doctor_id is not None:
        wanted = wanted & (F.col("doctor_id") == doctor_id)
    if status is not None:
        wanted = wanted & (F.col("status") == status)
    elif hide_cancelled:
        wanted = wanted & (F.col("status") != "Cancelled")
    departments = h.departments.select("dept_id", "dept_name")
    if department is not None:
        departments = departments.filter(F.col("dept_name") == department)
    return (
        h.appointments.filter(wanted)
        .join(_patients(h, "phone", "blood_group"), "patient_id")
        .join(_doctors(h, "dept_id"), "doctor_id")
        .join(departments, "dept_id", "left" if department is None else "inner")
        .select(
            "appt_id", "patient", "phone", "blood_group", "doctor", F.col("dept_name").alias("dept"),
            "appt_date", "appt_time", "appt_type", "status",
        )
        .orderBy(up("appt_time"), up("appt_id"))
    )


def booked_slots(h: Hospital) -> DataFrame:
    return (
        h.appointments.filter(F.col("status") != "Cancelled")
        .select("doctor_id", "appt_date", "appt_time")
    )


def changeable_appointments(h: Hospital) -> DataFrame:
    """What may still be cancelled or moved."""
    return (
        h.appointments.filter(~F.col("status").isin("Completed", "Cancelled"))
        .select("appt_id", "appt_date", "appt_time")
        .orderBy(up("appt_date"), up("appt_time"), up("appt_id"))
    )


def visit_history(h: Hospital, *, n: int = 20) -> DataFrame:
    """Newest visits of every patient with doctor, department and finding.

    Every visit makes at least one row, so the n newest rows lie in the n newest visits: the list is cut
    before anything is joined and again after the findings.
    """
    visits = h.appointments.select("appt_id", "patient_id", "doctor_id", "appt_date", "appt_type", "status")
    recent = top_per(visits, "patient_id", [down("appt_date"), down("appt_id")], n, rank="_visit").drop("_visit")
    findings = h.diagnoses.select("appt_id", "diag_id", "icd_code", F.col("description").alias("diagnosis"), "severity")
    newest = top_per(
        recent.join(findings, "appt_id", "left"), "patient_id", [down("appt_date"), down("appt_id"), down("diag_id")], n
    )
    return (
        newest.join(_doctors(h, "dept_id"), "doctor_id")
        .join(h.departments.select("dept_id", F.col("dept_name").alias("department")), "dept_id")
        .select(
            "patient_id", "rank", "appt_date", "appt_type", "doctor", "department", "icd_code", "diagnosis", "severity", "status"
        )
    )


# Clinical work still to do ------------------------------------------------------------------------


def awaiting_diagnosis(h: Hospital, *, n: int = 20) -> DataFrame:
    done = h.diagnoses.filter(F.col("appt_id").isNotNull()).select("appt_id")
    todo = h.appointments.filter(F.col("status") == "Completed").join(done, "appt_id", "left_anti")
    first = top_per(todo.select("appt_id", "patient_id", "doctor_id", "appt_date"), "doctor_id", [down("appt_date"), down("appt_id")], n)
    return first.join(_patients(h, name="full_name"), "patient_id").select("doctor_id", "rank", "appt_id", "full_name", "appt_date")


def awaiting_prescription(h: Hospital, *, n: int = 20, null_aware: bool = False) -> DataFrame:
    """Diagnoses without a prescription. With null_aware, one prescription without a diagnosis empties the
    list, as NOT IN over a set with a NULL does."""
    found = h.diagnoses.select("diag_id", "appt_id", "icd_code")
    todo = found.join(h.prescriptions.select("diag_id"), "diag_id", "left_anti")
    if null_aware:
        orphans = h.prescriptions.filter(F.col("diag_id").isNull()).agg(F.count("*")).scalar()
        todo = todo.filter(orphans == 0)
    with_doctor = todo.join(h.appointments.select("appt_id", "doctor_id", "patient_id"), "appt_id")
    first = top_per(with_doctor, "doctor_id", [down("diag_id")], n)
    return first.join(_patients(h, name="full_name"), "patient_id").select("doctor_id", "rank", "diag_id", "full_name", "icd_code")


def awaiting_lab_order(h: Hospital, *, n: int = 20) -> DataFrame:
    todo = h.appointments.filter(F.col("status").isin("Confirmed", "Completed")).join(
        h.lab_orders.select("appt_id"), "appt_id", "left_anti"
    )
    first = top_per(todo.select("appt_id", "patient_id", "doctor_id", "appt_date"), "doctor_id", [down("appt_date"), down("appt_id")], n)
    return first.join(_patients(h, name="full_name"), "patient_id").select("doctor_id", "rank", "appt_id", "full_name", "appt_date")


def recent_results_per_doctor(h: Hospital, *, n: int = 8) -> DataFrame:
    orders = h.lab_orders.select("order_id", "appt_id", "test_id", "ordered_at", "result_value", "is_abnormal").join(
        h.appointments.select("appt_id", "doctor_id", "patient_id"), "appt_id"
    )
    first = top_per(orders, "doctor_id", [down("ordered_at"), down("order_id")], n)
    flag = F.when(F.col("is_abnormal"), "ABNORMAL").otherwise("Normal")
    return (
        first.join(_patients(h), "patient_id")
        .join(h.lab_tests.select("test_id", "test_name"), "test_id")
        .select(
            "doctor_id", "rank", "order_id", "patient", "test_name",
            F.coalesce("result_value", F.lit("Pending")).alias("result"), flag.alias("flag"),
        )
    )


# Laboratory ---------------------------------------------------------------------------------------


def _orders_with_names(h: Hospital, orders: DataFrame) -> DataFrame:
    tests = h.lab_tests.select("test_id", "test_name", "category", "normal_range", "unit")
    return (
        orders.join(h.appointments.select("appt_id", "patient_id"), "appt_id")
        .join(_patients(h, "phone"), "patient_id")
        .join(tests, "test_id")
    )


def pending_lab_orders(h: Hospital) -> DataFrame:
    pending = h.lab_orders.filter(F.col("status") == "Pending").select("order_id", "appt_id", "test_id", "ordered_at")
    return (
        _orders_with_names(h, pending)
        .select("order_id", "patient", "phone", "test_name", "category", "normal_range", "unit", "ordered_at")
        .orderBy(up("ordered_at"), up("order_id"))
    )


def results_on(h: Hospital, *, as_of: AsOf, n: int = 10) -> DataFrame:
    done = h.lab_orders.filter((F.col("status") == "Done") & on_day("result_date", as_of))
    newest = top(done, [down("result_date"), down("order_id")], n)
    return _orders_with_names(h, newest).select(
        "order_id", "test_name", "result_value", "is_abnormal", F.col("patient").alias("full_name"), "result_date"
    )


# Billing ------------------------------------------------------------------------------------------


def recent_payments(h: Hospital, *, n: int = 5) -> DataFrame:
    newest = top(h.payments, [down("payment_date"), down("payment_id")], n)
    return (
        newest.join(h.bills.select("bill_id", "patient_id"), "bill_id")
        .join(_patients(h), "patient_id")
        .select("payment_id", "patient", "amount_paid", "payment_mode", "payment_date")
        .orderBy(down("payment_date"), down("payment_id"))
    )


def recent_bills(h: Hospital, *, n: int = 5) -> DataFrame:
    newest = top(h.bills, [down("bill_date"), down("bill_id")], n)
    return (
        newest.join(_patients(h), "patient_id")
        .select("bill_id", "patient", "net_payable", "status", "bill_date")
        .orderBy(down("bill_date"), down("bill_id"))
    )


def awaiting_bill(h: Hospital) -> DataFrame:
    billed = h.bills.filter(F.col("appt_id").isNotNull()).select("appt_id")
    return (
        h.appointments.filter(F.col("status") == "Completed")
        .join(billed, "appt_id", "left_anti")
        .join(_patients(h, "phone", name="full_name"), "patient_id")
        .join(_doctors(h, "opd_fee"), "doctor_id")
        .select("appt_id", "full_name", "phone", "appt_date", "doctor", "opd_fee")
        .orderBy(down("appt_date"), down("appt_id"))
    )


def charge_preview(h: Hospital) -> DataFrame:
    """What a bill would come to for every completed appointment that has none, by kind of charge."""
    billed = h.bills.filter(F.col("appt_id").isNotNull()).select("appt_id")
    todo = (
        h.appointments.filter(F.col("status") == "Completed")
        .select("appt_id", "doctor_id")
        .join(billed, "appt_id", "left_anti")
    )
    lines = consultation_lines(h, todo).unionByName(lab_lines(h, todo)).unionByName(pharmacy_lines(h, todo))

    def part(kind: str) -> Column:
        chosen = F.when(F.col("service_type") == kind, F.col("total")).otherwise(F.lit(0))
        return F.sum(chosen).cast("decimal(12,2)").alias(kind.lower())

    return lines.groupBy("appt_id").agg(
        part("Consultation"), part("Lab"), part("Pharmacy"), F.sum("total").cast("decimal(12,2)").alias("total")
    )


def open_bills(h: Hospital) -> DataFrame:
    unpaid = h.bills.filter(F.col("status") != "Paid").join(_patients(h, "phone"), "patient_id")
    return (
        with_balance(h, unpaid, "paid_so_far", "outstanding")
        .select(
            "bill_id", "patient", "phone", "total_amount", "insurance_covered", "net_payable", "status", "due_date",
            "paid_so_far", "outstanding",
        )
        .orderBy(up("due_date"), up("bill_id"))
    )


def bill_history(h: Hospital, *, name_like: str | None = None, status: str | None = None) -> DataFrame:
    bills = h.bills if status is None else h.bills.filter(F.col("status") == status)
    patients = _patients(h, name="full_name")
    if name_like is not None:
        patients = patients.filter(F.lower("full_name").like(f"%{name_like.strip()}%".lower()))
    return (
        bills.join(patients, "patient_id")
        .select("bill_id", "full_name", "bill_date", "total_amount", "insurance_covered", "net_payable", "status")
        .orderBy(down("bill_date"), down("bill_id"))
    )


def bill_items(h: Hospital) -> DataFrame:
    return h.bill_items.select("bill_id", "item_id", "service_type", "description", "quantity", "unit_price", "total")


def payment_history(h: Hospital) -> DataFrame:
    return h.payments.select("bill_id", "payment_id", "amount_paid", "payment_mode", "payment_date")


def bill_balances(h: Hospital) -> DataFrame:
    return with_balance(h, h.bills.select("bill_id", "net_payable"), "paid", "outstanding")


def invoice_headers(h: Hospital) -> DataFrame:
    """One row per bill: who, when, totals, paid and what is still due (never below zero)."""
    appts = h.appointments.select("appt_id", "doctor_id", "appt_date", "appt_time")
    bills = (
        h.bills.join(_patients(h), "patient_id").join(appts, "appt_id", "left").join(_doctors(h), "doctor_id", "left")
    )
    zero = F.lit(0).cast("decimal(18,2)")
    return with_balance(h, bills, "total_paid", "_owed").select(
        "bill_id", "patient", F.coalesce("doctor", F.lit("N/A")).alias("doctor"), "appt_id", "appt_date", "appt_time",
        "bill_date", "total_amount", "insurance_covered", "net_payable", "total_paid",
        F.greatest(zero, F.col("_owed")).alias("outstanding"), "status",
    )


def invoice_lines(h: Hospital) -> DataFrame:
    """The body of every invoice as flat rows: charges by item, then payments by date.

    Rows and not one array per bill, so a bill of any length spreads over tasks; (bill_id, section,
    line_ts, line_id) is the printing order.
    """
    charges = h.bill_items.select(
        "bill_id",
        F.lit("1-charge").alias("section"),
        F.lit(None).cast("timestamp_ntz").alias("line_ts"),
        F.col("item_id").alias("line_id"),
        F.concat_ws(": ", "service_type", "description").alias("label"),
        "quantity",
        F.col("unit_price").cast("decimal(12,2)").alias("unit_price"),
        F.col("total").cast("decimal(12,2)").alias("amount"),
    )
    receipts = h.payments.select(
        "bill_id",
        F.lit("2-payment").alias("section"),
        F.col("payment_date").alias("line_ts"),
        F.col("payment_id").alias("line_id"),
        F.col("payment_mode").alias("label"),
        F.lit(None).cast("int").alias("quantity"),
        F.lit(None).cast("decimal(12,2)").alias("unit_price"),
        F.col("amount_paid").cast("decimal(12,2)").alias("amount"),
    )
    return charges.unionByName(receipts)


# Pharmacy -----------------------------------------------------------------------------------------


def dispense_queue(h: Hospital, *, n: int = 30) -> DataFrame:
    """Newest prescriptions still to hand out, with a flag where stock does not cover the course."""
    waiting = h.prescriptions.filter(~F.col("is_dispensed"))
    linked = (
        waiting.join(h.diagnoses.select("diag_id", "appt_id"), "diag_id")
        .join(h.appointments.select("appt_id", "patient_id"), "appt_id")
        .join(h.medicines.select("medicine_id"), "medicine_id", "left_semi")
    )
    newest = top(linked, [down("prescribed_at"), down("rx_id")], n)
    shortfall = (
        F.when(F.col("stock_quantity") == 0, "out of stock")
        .when(F.col("stock_quantity") < F.col("duration_days"), "short")
        .otherwise("ok")
    )
    return (
        newest.join(_patients(h), "patient_id")
        .join(h.medicines.select("medicine_id", "brand_name", "generic_name", "unit_price", "stock_quantity"), "medicine_id")
        .select(
            "rx_id", "patient", "brand_name", "generic_name", "unit_price", "dosage", "frequency", "duration_days",
            "instructions", "stock_quantity", "medicine_id", shortfall.alias("shortfall"),
        )
    )


def low_stock_short_list(h: Hospital, *, n: int = 10) -> DataFrame:
    low = h.medicines.filter(F.col("stock_quantity") <= F.col("reorder_level"))
    return top(low, [up("stock_quantity"), up("medicine_id")], n).select(
        "medicine_id", "brand_name", "stock_quantity", "reorder_level"
    )


def low_stock_detail(h: Hospital) -> DataFrame:
    return (
        h.medicines.filter(F.col("stock_quantity") <= F.col("reorder_level"))
        .select(
            "medicine_id", "brand_name", "generic_name", "category", "stock_quantity", "reorder_level",
            (F.col("reorder_level") - F.col("stock_quantity")).alias("units_short"), "expiry_date",
        )
        .orderBy(down("units_short"), up("medicine_id"))
    )


def inventory(h: Hospital, *, text: str | None = None, category: str | None = None, stock: str | None = None) -> DataFrame:
    """Medicines by brand or generic text, category and stock band (In, Low or Out of Stock)."""
    rows = h.medicines
    if text is not None and text.strip():
        pattern = f"%{text}%".lower()
        rows = rows.filter(F.lower("brand_name").like(pattern) | F.lower("generic_name").like(pattern))
    if category is not None:
        rows = rows.filter(F.col("category") == category)
    if stock == "In Stock":
        rows = rows.filter(F.col("stock_quantity") > F.col("reorder_level"))
    elif stock == "Low Stock":
        rows = rows.filter((F.col("stock_quantity") > 0) & (F.col("stock_quantity") <= F.col("reorder_level")))
    elif stock == "Out of Stock":
        rows = rows.filter(F.col("stock_quantity") == 0)
    return rows.select(
        "medicine_id", "brand_name", "generic_name", "category", "stock_quantity", "reorder_level", "unit_price",
        "expiry_date", *[c for c in rows.columns if c == "manufacturer"], stock_band().alias("band"),
    ).orderBy(up("brand_name"), up("medicine_id"))


def categories(h: Hospital) -> DataFrame:
    return h.medicines.filter(F.col("category").isNotNull()).select("category").distinct().orderBy("category")


# Directories --------------------------------------------------------------------------------------


def doctor_directory(h: Hospital) -> DataFrame:
    return (
        h.doctors.join(h.departments.select("dept_id", F.col("dept_name").alias("dept")), "dept_id")
        .select("doctor_id", "full_name", "dept", "specialization", "phone", "opd_fee", "status")
        .orderBy(up("full_name"), up("doctor_id"))
    )


def available_doctors(h: Hospital, *, dept_id: int | None = None) -> DataFrame:
    doctors = h.doctors.filter(F.col("status") == "Active")
    if dept_id is not None:
        doctors = doctors.filter(F.col("dept_id") == dept_id)
    return doctors.select("dept_id", "doctor_id", "full_name", "specialization", "opd_fee").orderBy(
        up("dept_id"), up("full_name"), up("doctor_id")
    )


def user_directory(h: Hospital) -> DataFrame:
    return (
        h.users.join(h.roles.select("role_id", "role_name"), "role_id")
        .select("user_id", "username", "role_name", "is_active", "last_login", "failed_attempts")
        .orderBy(up("username"), up("user_id"))
    )


def medicine_catalogue(h: Hospital) -> DataFrame:
    return (
        h.medicines.filter(F.col("stock_quantity") > 0)
        .select("medicine_id", "brand_name", "generic_name", "unit_price", "stock_quantity")
        .orderBy(up("brand_name"), up("medicine_id"))
    )


def lab_test_catalogue(h: Hospital) -> DataFrame:
    return h.lab_tests.select(
        "test_id", "test_name", "category", "price", "normal_range", "turnaround_hours"
    ).orderBy(up("test_name"), up("test_id"))


def department_catalogue(h: Hospital) -> DataFrame:
    return h.departments.select("dept_id", "dept_name").orderBy(up("dept_name"), up("dept_id"))


def role_catalogue(h: Hospital) -> DataFrame:
    return h.roles.select("role_id", "role_name").orderBy(up("role_name"))
