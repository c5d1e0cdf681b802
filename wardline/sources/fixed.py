"""Small tables whose rows are part of the data model itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wardline.sources.tables import load_rows

# Role catalogue.
ROLES = (
    (1, "Admin", "Full system access"),
    (2, "Doctor", "Clinical access only"),
    (3, "Receptionist", "Patient and appointment management"),
    (4, "Lab_Tech", "Lab orders and results"),
    (5, "Pharmacist", "Prescriptions and medicine stock"),
    (6, "Billing_Staff", "Bills and payments"),
)

# Laboratory test catalogue (id, name, category, normal range, unit, price, turnaround hours).
LAB_TESTS = (
    (1, "Complete Blood Count", "Blood", "4.5-11 x10^9/L", "x10^9/L", 350, 4),
    (2, "Lipid Profile", "Blood", "<200 mg/dL", "mg/dL", 600, 6),
    (3, "Blood Glucose Fasting", "Blood", "70-100 mg/dL", "mg/dL", 150, 2),
    (4, "Urine Routine", "Urine", "Normal", "NA", 100, 2),
    (5, "Chest X-Ray", "Radiology", "Normal", "NA", 500, 24),
    (6, "ECG", "Cardiology", "Normal Sinus Rhythm", "NA", 300, 1),
)

# Table privileges per role (the Admin holds every privilege on every table).
GRANTS = {
    "Receptionist": {
        "patients": ("SELECT", "INSERT", "UPDATE"),
        "appointments": ("SELECT", "INSERT", "UPDATE"),
        "insurance": ("SELECT", "INSERT"),
        "doctors": ("SELECT",),
        "departments": ("SELECT",),
        "roles": ("SELECT",),
        "audit_log": ("INSERT",),
        "vw_patient_history": ("SELECT",),
        "vw_opd_queue": ("SELECT",),
    },
    "Doctor": {
        "appointments": ("SELECT", "UPDATE"),
        "patients": ("SELECT",),
        "diagnoses": ("SELECT", "INSERT"),
        "prescriptions": ("SELECT", "INSERT"),
        "lab_orders": ("SELECT", "INSERT"),
        "lab_tests": ("SELECT",),
        "medicines": ("SELECT",),
        "doctors": ("SELECT",),
        "departments": ("SELECT",),
        "vw_patient_history": ("SELECT",),
        "vw_opd_queue": ("SELECT",),
    },
    "Lab_Tech": {
        "lab_orders": ("SELECT", "UPDATE"),
        "lab_tests": ("SELECT",),
        "appointments": ("SELECT",),
        "patients": ("SELECT",),
    },
    "Pharmacist": {
        "prescriptions": ("SELECT",),
        "diagnoses": ("SELECT",),
        "appointments": ("SELECT",),
        "patients": ("SELECT",),
        "medicines": ("SELECT", "UPDATE"),
        "vw_low_stock": ("SELECT",),
    },
    "Billing_Staff": {
        "bills": ("SELECT", "INSERT", "UPDATE"),
        "bill_items": ("SELECT", "INSERT"),
        "payments": ("SELECT", "INSERT"),
        "patients": ("SELECT",),
        "appointments": ("SELECT",),
        "doctors": ("SELECT",),
        "lab_orders": ("SELECT",),
        "lab_tests": ("SELECT",),
        "prescriptions": ("SELECT",),
        "medicines": ("SELECT",),
        "diagnoses": ("SELECT",),
        "vw_billing_summary": ("SELECT",),
    },
}

# What "all privileges" on a table stands for.
ALL_PRIVILEGES = ("DELETE", "INSERT", "REFERENCES", "SELECT", "TRIGGER", "TRUNCATE", "UPDATE")

# Report views, granted beside the tables.
VIEWS = ("vw_patient_history", "vw_opd_queue", "vw_billing_summary", "vw_low_stock")


def roles(spark: SparkSession) -> DataFrame:
    return load_rows(spark, "roles", [dict(zip(("role_id", "role_name", "description"), r)) for r in ROLES])


def lab_tests(spark: SparkSession) -> DataFrame:
    names = ("test_id", "test_name", "category", "normal_range", "unit", "price", "turnaround_hours")
    return load_rows(spark, "lab_tests", [dict(zip(names, r)) for r in LAB_TESTS])


def grants(spark: SparkSession) -> DataFrame:
    """One row per (role_name, table_name, privilege_type)."""
    from wardline.schema import TABLES

    rows = [(role, table, p) for role, tables in GRANTS.items() for table, ps in tables.items() for p in ps]
    rows += [("Admin", table, p) for table in (*TABLES, *VIEWS) for p in ALL_PRIVILEGES]
    return spark.createDataFrame(rows, "role_name string, table_name string, privilege_type string")
