"""Fixed schemas of the hospital tables.

Ids are 64-bit so that request volumes never overflow a key; money is DECIMAL; times of day are
'HH:mm:ss' strings, which sort and compare like the time they denote; stamps carry no zone.
Credentials are not part of the model: the users table has no password column.
"""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {
    "id": T.LongType(),
    "int": T.IntegerType(),
    "text": T.StringType(),
    "time": T.StringType(),
    "fee": T.DecimalType(10, 2),
    "money": T.DecimalType(12, 2),
    "date": T.DateType(),
    "stamp": T.TimestampNTZType(),
    "flag": T.BooleanType(),
}


def _table(spec: str) -> T.StructType:
    fields = []
    for part in spec.split(","):
        name, kind = part.split()
        required = kind.endswith("!")
        fields.append(T.StructField(name, _TYPES[kind.rstrip("!")], not required))
    return T.StructType(fields)


TABLES: dict[str, T.StructType] = {
    "roles": _table("role_id id!, role_name text!, description text"),
    "users": _table(
        "user_id id!, username text!, role_id id, staff_ref_id id, last_login stamp, is_active flag, "
        "failed_attempts int, locked_until stamp, created_at stamp"
    ),
    "user_sessions": _table(
        "session_id text!, user_id id, role_id id, ip_address text, created_at stamp, expires_at stamp, is_active flag"
    ),
    "insurance": _table(
        "insurance_id id!, provider_name text, policy_number text, coverage_amount money, expiry_date date, plan_type text"
    ),
    "patients": _table(
        "patient_id id!, full_name text!, date_of_birth date!, gender text, blood_group text, phone text!, email text, "
        "address text, emergency_contact text, insurance_id id, registration_date stamp, status text"
    ),
    "departments": _table("dept_id id!, dept_name text!, location text, phone_ext text, head_doctor_id id"),
    "doctors": _table(
        "doctor_id id!, full_name text!, dept_id id, specialization text, qualification text, phone text, email text, "
        "joining_date date, opd_fee fee, status text"
    ),
    "appointments": _table(
        "appt_id id!, patient_id id, doctor_id id, appt_date date!, appt_time time!, appt_type text, status text, "
        "notes text, created_at stamp"
    ),
    "diagnoses": _table("diag_id id!, appt_id id, icd_code text, description text, severity text, diagnosed_at stamp"),
    "medicines": _table(
        "medicine_id id!, brand_name text!, generic_name text, category text, stock_quantity int, reorder_level int, "
        "unit_price fee, expiry_date date, manufacturer text"
    ),
    "prescriptions": _table(
        "rx_id id!, diag_id id, medicine_id id, dosage text, frequency text, duration_days int, instructions text, "
        "prescribed_at stamp, is_dispensed flag"
    ),
    "lab_tests": _table(
        "test_id id!, test_name text!, category text, normal_range text, unit text, price fee, turnaround_hours int"
    ),
    "lab_orders": _table(
        "order_id id!, appt_id id, test_id id, ordered_at stamp, result_value text, is_abnormal flag, status text, "
        "result_date stamp"
    ),
    "bills": _table(
        "bill_id id!, patient_id id, appt_id id, total_amount money, insurance_covered money, net_payable money, "
        "bill_date stamp, due_date date, status text, generated_by id"
    ),
    "bill_items": _table(
        "item_id id!, bill_id id, service_type text, description text, quantity int, unit_price fee, total fee"
    ),
    "payments": _table(
        "payment_id id!, bill_id id, amount_paid money, payment_mode text, payment_date stamp, transaction_ref text, "
        "received_by id"
    ),
    "audit_log": _table(
        "log_id id!, table_name text, operation text, record_id id, old_values text, new_values text, changed_by id, "
        "changed_at stamp, ip_address text"
    ),
}

KEYS: dict[str, str] = {
    "roles": "role_id",
    "users": "user_id",
    "user_sessions": "session_id",
    "insurance": "insurance_id",
    "patients": "patient_id",
    "departments": "dept_id",
    "doctors": "doctor_id",
    "appointments": "appt_id",
    "diagnoses": "diag_id",
    "medicines": "medicine_id",
    "prescriptions": "rx_id",
    "lab_tests": "test_id",
    "lab_orders": "order_id",
    "bills": "bill_id",
    "bill_items": "item_id",
    "payments": "payment_id",
    "audit_log": "log_id",
}

# Column defaults of the data model.
DEFAULTS: dict[str, dict[str, object]] = {
    "users": {"is_active": True, "failed_attempts": 0},
    "user_sessions": {"is_active": True},
    "patients": {"status": "Active"},
    "doctors": {"opd_fee": 500, "status": "Active"},
    "appointments": {"status": "Pending"},
    "medicines": {"stock_quantity": 0, "reorder_level": 50},
    "prescriptions": {"is_dispensed": False},
    "lab_orders": {"is_abnormal": False, "status": "Pending"},
    "bills": {"insurance_covered": 0, "status": "Unpaid"},
    "bill_items": {"quantity": 1},
}

# Allowed codes per column.
ENUMS: dict[tuple[str, str], tuple[str, ...]] = {
    ("patients", "gender"): ("Male", "Female", "Other"),
    ("patients", "blood_group"): ("A+", "A-", "B+", "B-", "AB+", "AB-", "O+", "O-"),
    ("patients", "status"): ("Active", "Discharged"),
    ("appointments", "appt_type"): ("OPD", "IPD", "Emergency"),
    ("appointments", "status"): ("Pending", "Confirmed", "Completed", "Cancelled"),
    ("diagnoses", "severity"): ("Mild", "Moderate", "Severe"),
    ("lab_orders", "status"): ("Pending", "Collected", "Done"),
    ("bills", "status"): ("Unpaid", "Partial", "Paid"),
    ("bill_items", "service_type"): ("Consultation", "Lab", "Pharmacy"),
    ("payments", "payment_mode"): ("Cash", "Card", "UPI", "Insurance"),
    ("audit_log", "operation"): ("INSERT", "UPDATE", "DELETE"),
}

# Column length limits of the data model (text columns without a limit are absent).
LENGTHS: dict[str, dict[str, int]] = {
    "patients": {"full_name": 100, "phone": 15, "email": 100, "emergency_contact": 100},
    "lab_orders": {"result_value": 100},
    "prescriptions": {"dosage": 50, "frequency": 50},
    "medicines": {"brand_name": 100, "generic_name": 100, "category": 50, "manufacturer": 100},
}
