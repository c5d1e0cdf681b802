"""A small hospital of hand-made rows, one or more for every behaviour worth pinning down."""

from wardline.sources import fixed
from wardline.sources.tables import Hospital, load_rows
from wardline.schema import TABLES

ROWS = {
    "departments": [{"dept_id": 1, "dept_name": "Heart"}, {"dept_id": 2, "dept_name": "Bones"}],
    "doctors": [
        {"doctor_id": 1, "full_name": "Dr. Ann Lee", "dept_id": 1, "opd_fee": "800"},
        {"doctor_id": 2, "full_name": "Dr. Bo Lee", "dept_id": 2, "opd_fee": "500", "status": "On Leave"},
        {"doctor_id": 3, "full_name": "Dr. Cy Roy", "dept_id": 2, "opd_fee": None},
    ],
    "insurance": [
        {"insurance_id": 1, "provider_name": "Star", "policy_number": "S-1", "coverage_amount": "1000", "expiry_date": "1990-01-01"},
        {"insurance_id": 2, "provider_name": "Moon", "policy_number": "M-1", "coverage_amount": None, "expiry_date": "2030-01-01"},
    ],
    "patients": [
        {"patient_id": 1, "full_name": "Raj", "date_of_birth": "2000-02-29", "phone": "9000000001", "email": "raj@mail.example", "insurance_id": 1, "registration_date": "1998-06-15 10:00:00"},
        {"patient_id": 2, "full_name": "Mia_50%", "date_of_birth": "1990-07-22", "phone": "9000000002", "insurance_id": 2, "status": "Discharged", "registration_date": "1998-06-10 10:00:00"},
        {"patient_id": 3, "full_name": "Zed", "date_of_birth": "1978-11-08", "phone": "9000000003", "registration_date": "1998-05-01 10:00:00"},
    ],
    "appointments": [
        {"appt_id": 1, "patient_id": 1, "doctor_id": 1, "appt_date": "1998-06-15", "appt_time": "09:00:00", "appt_type": "OPD", "status": "Completed"},
        {"appt_id": 2, "patient_id": 2, "doctor_id": 1, "appt_date": "1998-06-15", "appt_time": "10:00:00", "appt_type": "OPD", "status": "Confirmed"},
        {"appt_id": 3, "patient_id": 3, "doctor_id": 3, "appt_date": "1998-06-14", "appt_time": "10:00:00", "appt_type": "IPD", "status": "Completed"},
        {"appt_id": 4, "patient_id": 1, "doctor_id": 1, "appt_date": "1998-06-16", "appt_time": "11:00:00", "appt_type": "OPD", "status": "Cancelled"},
        {"appt_id": 5, "patient_id": 2, "doctor_id": 1, "appt_date": "1998-06-17", "appt_time": "11:00:00", "appt_type": "OPD", "status": "Pending"},
    ],
    "diagnoses": [
        {"diag_id": 1, "appt_id": 1, "icd_code": "J18.9", "severity": "Mild"},
        {"diag_id": 2, "appt_id": 3, "icd_code": "A00", "severity": "Severe"},
    ],
    "medicines": [
        {"medicine_id": 1, "brand_name": "Crocin", "generic_name": "Paracetamol", "category": "Pain", "stock_quantity": 10, "reorder_level": 10, "unit_price": "2.50"},
        {"medicine_id": 2, "brand_name": "Pantop", "generic_name": "Pantoprazole", "category": None, "stock_quantity": 0, "reorder_level": 5, "unit_price": "8.00"},
        {"medicine_id": 3, "brand_name": "Dolo", "generic_name": "Paracetamol", "category": "Pain", "stock_quantity": 99, "reorder_level": 5, "unit_price": "1.00"},
    ],
    "prescriptions": [
        {"rx_id": 1, "diag_id": 1, "medicine_id": 1, "dosage": "5mg", "frequency": "Twice daily", "duration_days": 4, "prescribed_at": "1998-06-15 09:30:00"},
        {"rx_id": 2, "diag_id": 1, "medicine_id": 2, "dosage": "5mg", "frequency": "Once daily", "duration_days": 3, "prescribed_at": "1998-06-15 09:31:00"},
        {"rx_id": 3, "diag_id": 1, "medicine_id": 1, "dosage": "5mg", "frequency": "Once daily", "duration_days": 8, "prescribed_at": "1998-06-15 09:32:00"},
        {"rx_id": 4, "diag_id": 1, "medicine_id": 3, "dosage": "5mg", "frequency": "Once daily", "duration_days": 1, "prescribed_at": "1998-06-15 09:33:00", "is_dispensed": True},
    ],
    "lab_orders": [
        {"order_id": 1, "appt_id": 1, "test_id": 1, "ordered_at": "1998-06-15 09:00:00"},
        {"order_id": 2, "appt_id": 1, "test_id": 6, "ordered_at": "1998-06-15 09:05:00", "result_value": "ok", "status": "Done", "result_date": "1998-06-15 12:00:00"},
    ],
    "users": [
        {"user_id": 1, "username": "dr_ann_lee", "role_id": 2, "staff_ref_id": 1},
        {"user_id": 2, "username": "Dr.Lee", "role_id": 2},
        {"user_id": 3, "username": "dr_cy", "role_id": 2, "staff_ref_id": 99},
        {"user_id": 4, "username": "desk", "role_id": 3},
        {"user_id": 5, "username": "dr_", "role_id": 2},
    ],
    "bills": [],
    "bill_items": [],
    "payments": [],
}


def build(spark, **extra) -> Hospital:
    tables = {
        name: (load_rows(spark, name, rows) if rows else spark.createDataFrame([], TABLES[name])) for name, rows in ROWS.items()
    }
    tables["roles"], tables["lab_tests"], tables["grants"] = fixed.roles(spark), fixed.lab_tests(spark), fixed.grants(spark)
    return Hospital(spark, {**tables, **extra})


def requests(spark, schema: str, *rows):
    """Requests as rows of text, cast to the schema; request_ts is given as minutes after 08:00."""
    names = [part.split()[0] for part in schema.split(", ")]
    kinds = dict(part.split() for part in schema.split(", "))
    text = [tuple(None if v is None else str(v) for v in row) for row in rows]
    df = spark.createDataFrame(text, ", ".join(f"{n} string" for n in names))
    from pyspark.sql import functions as F

    def typed(name):
        if name == "request_ts":
            base = F.lit("1998-06-15 08:00:00").cast("timestamp_ntz")
            return F.timestamp_add("MINUTE", F.col(name).cast("int"), base).alias(name)
        return F.col(name).cast(kinds[name]).alias(name)

    return df.select(*[typed(n) for n in names])
