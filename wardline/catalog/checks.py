"""Registered validation rules, sanitisers and error wording, over whole intake tables."""

from __future__ import annotations

import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from wardline.catalog.registry import AS_OF, query
from wardline.functions import rules, text
from wardline.functions.errors import friendly_error
from wardline.operators.quality import constraint_findings, quality_scan, screen
from wardline.sources.staging import shared_folder
from wardline.sources.tables import Hospital

NOW = datetime(1998, 6, 15, 9, 45)


def _checked(h: Hospital, rule: Column, *shown: str) -> DataFrame:
    return h.intake.select("row_id", *shown, rule.alias("problem"))


def _sql(case: str) -> str:
    return f"select row_id, {case} as problem from {{intake}}"


@query(
    "r01_email",
    _sql(
        """case when email is null or trim(email) = '' then null
                when not regexp_matches(lower(trim(email)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z][a-z]+$') then 'Invalid email format. Example: name@example.com'
                when length(trim(email)) > 254 then 'Email is too long (max 254 characters).'
                when strpos(email, '..') > 0 then 'Email cannot contain consecutive dots.' end"""
    ),
)
def r01(h: Hospital) -> DataFrame:
    return _checked(h, rules.email("email"))


@query(
    "r02_phone",
    """with c as (select row_id, phone, regexp_replace(trim(phone), '[ +()-]', '', 'g') as p from {intake}),
       e as (select row_id, phone, case when starts_with(p, '91') and length(p) = 12 then substr(p, 3) else p end as p from c)
       select row_id, case when phone is null or trim(phone) = '' then 'Phone number is required.'
              when not regexp_matches(p, '^[0-9]+$') then 'Phone number must contain digits only.'
              when length(p) <> 10 then 'Phone must be exactly 10 digits. You entered ' || length(p) || ' digit(s).'
              when p[1] not in ('6', '7', '8', '9') then 'Indian mobile numbers must start with 6, 7, 8, or 9.' end as problem from e""",
)
def r02(h: Hospital) -> DataFrame:
    return _checked(h, rules.phone("phone"))


@query(
    "r03_name",
    _sql(
        """case when full_name is null or trim(full_name) = '' then 'Name is required.'
                when length(trim(full_name)) < 2 then 'Name must be at least 2 characters.'
                when length(trim(full_name)) > 100 then 'Name must be under 100 characters.'
                when not regexp_matches(trim(full_name), '^[A-Za-z .''-]+$') then 'Name can only contain letters, spaces, dots and hyphens.' end"""
    ),
)
def r03(h: Hospital) -> DataFrame:
    return _checked(h, rules.name("full_name"))


@query(
    "r04_date_of_birth",
    _sql(
        """case when date_of_birth is null then 'Date of birth is required.'
                when date_of_birth >= date '1998-06-15' then 'Date of birth must be in the past.'
                when (date '1998-06-15' - date_of_birth) // 365 > 120 then 'Age cannot exceed 120 years.' end"""
    ),
)
def r04(h: Hospital) -> DataFrame:
    return _checked(h, rules.date_of_birth("date_of_birth", AS_OF))


@query(
    "r05_appointment_date",
    _sql(
        """case when visit_date is null then 'Appointment date is required.'
                when visit_date < date '1998-06-15' then 'Appointment date cannot be in the past.'
                when visit_date - date '1998-06-15' > 365 then 'Cannot schedule more than 1 year in advance.' end"""
    ),
)
def r05(h: Hospital) -> DataFrame:
    return _checked(h, rules.appointment_date("visit_date", AS_OF))


@query(
    "r06_appointment_time",
    _sql(
        """case when visit_time is null or trim(visit_time) = '' then 'Appointment time is required.'
                when not regexp_matches(trim(visit_time), '^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$')
                  then 'Appointment time must be given as HH:MM or HH:MM:SS.'
                when cast(substr(trim(visit_time), 1, 2) as int) < 8 then 'Appointments cannot be before 8:00 AM.'
                when cast(substr(trim(visit_time), 1, 2) as int) >= 20 then 'Appointments cannot be after 8:00 PM.'
                when visit_date = date '1998-06-15' and cast(trim(visit_time) as time) < time '11:45:00'
                  then 'For today''s appointments, time must be at least 2 hours from now (earliest allowed: 11:45 AM).' end"""
    ),
)
def r06(h: Hospital) -> DataFrame:
    return _checked(h, rules.appointment_time("visit_time", "visit_date", NOW))


@query(
    "r07_username",
    _sql(
        """case when username is null or trim(username) = '' then 'Username is required.'
                when length(trim(username)) < 3 then 'Username must be at least 3 characters.'
                when length(trim(username)) > 50 then 'Username must be under 50 characters.'
                when not regexp_matches(trim(username), '^[a-zA-Z0-9_]+$') then 'Username can only contain letters, numbers and underscores.'
                when regexp_matches(trim(username), '^[0-9]') then 'Username cannot start with a number.' end"""
    ),
)
def r07(h: Hospital) -> DataFrame:
    return _checked(h, rules.username("username"))


@query(
    "r08_amount",
    _sql(
        """case when amount is null then 'Amount is required.' when try_cast(amount as double) is null then 'Amount must be a valid number.'
                when try_cast(amount as double) < 0.01 then 'Amount must be at least ₹0.01.'
                when try_cast(amount as double) > 10000000 then 'Amount cannot exceed ₹10,000,000.00.' end"""
    ),
)
def r08(h: Hospital) -> DataFrame:
    return _checked(h, rules.amount("amount"))


@query(
    "r09_icd_code",
    _sql(
        """case when icd_code is null or trim(icd_code) = '' then 'ICD code is required.'
                when not regexp_matches(upper(trim(icd_code)), '^[A-Z][0-9][0-9](\\.[0-9A-Z]{1,4})?$') then 'Invalid ICD-10 format. Use e.g. J18.9 or A00' end"""
    ),
)
def r09(h: Hospital) -> DataFrame:
    return _checked(h, rules.icd_code("icd_code"))


@query(
    "r10_text",
    _sql(
        """case when remark is null or trim(remark) = '' then 'Remark is required.'
                when length(remark) > 1000 then 'Remark cannot exceed 1000 characters.' end"""
    ),
)
def r10(h: Hospital) -> DataFrame:
    return _checked(h, rules.text("remark", "Remark"))


@query(
    "r11_dosage",
    _sql(
        """case when dosage is null or trim(dosage) = '' then 'Dosage is required (e.g. 500mg, 10ml, 1 tablet).'
                when length(trim(dosage)) > 50 then 'Dosage too long (max 50 characters).' end"""
    ),
)
def r11(h: Hospital) -> DataFrame:
    return _checked(h, rules.dosage("dosage"))


@query(
    "r12_duration_days",
    _sql(
        """case when duration_days is null or not regexp_matches(duration_days, '^-?[0-9]+$') then 'Duration must be a whole number.'
                when cast(duration_days as double) < 1 then 'Duration must be at least 1 day.'
                when cast(duration_days as double) > 365 then 'Duration cannot exceed 365 days.' end"""
    ),
)
def r12(h: Hospital) -> DataFrame:
    return _checked(h, rules.duration_days("duration_days"))


@query(
    "r13_transaction_ref",
    _sql(
        """case when payment_mode in ('Card', 'UPI') and (transaction_ref is null or trim(transaction_ref) = '')
                then 'Transaction reference is required for ' || payment_mode || ' payments.' end"""
    ),
)
def r13(h: Hospital) -> DataFrame:
    return _checked(h, rules.transaction_ref("transaction_ref", "payment_mode"))


@query(
    "r14a_medicine_name",
    _sql(
        """case when medicine_name is null or trim(medicine_name) = '' then 'Medicine name is required.'
                when length(trim(medicine_name)) < 2 then 'Medicine name must be at least 2 characters.'
                when length(trim(medicine_name)) > 100 then 'Medicine name too long.' end"""
    ),
)
def r14a(h: Hospital) -> DataFrame:
    return _checked(h, rules.medicine_name("medicine_name"))


@query(
    "r14b_stock_quantity",
    _sql(
        """case when stock_quantity is null or not regexp_matches(stock_quantity, '^-?[0-9]+$') then 'Stock quantity must be a whole number.'
                when cast(stock_quantity as bigint) < 0 then 'Stock quantity cannot be negative.'
                when cast(stock_quantity as bigint) > 1000000 then 'Stock quantity seems too high.' end"""
    ).replace("cast(stock_quantity as bigint)", "try_cast(stock_quantity as bigint)"),
)
def r14b(h: Hospital) -> DataFrame:
    return _checked(h, rules.stock_quantity("stock_quantity"))


@query(
    "r15_insurance_block",
    """with g as (select row_id, trim(provider_name) as a, trim(policy_number) as b, coverage_amount as c from {intake})
       select row_id, case when a = '' and b = '' and c <= 0 then null when a = '' then 'Insurance provider name required.'
              when b = '' then 'Policy number required.' when c <= 0 then 'Coverage amount must be greater than 0.' end as problem from g""",
)
def r15(h: Hospital) -> DataFrame:
    return _checked(h, rules.insurance_block("provider_name", "policy_number", "coverage_amount"))


def _findings_sql(
    checks: dict[str, dict[str, str]], unique: list[tuple[str, str]], links: list[tuple[str, str, str, str]]
) -> str:
    parts = [
        f"select '{table}' as table_name, '{rule}' as rule, count(*) filter ({bad}) as violations from {{{table}}}"
        for table, group in checks.items()
        for rule, bad in group.items()
    ]
    parts += [
        f"""select '{table}', '{key} unique', (select count(*) from (select {key} from {{{table}}} where {key} is not null
            group by {key} having count(*) > 1) k)"""
        for table, key in unique
    ]
    if "appointments" in checks:
        parts.append(
            """select 'appointments', 'one live appointment per slot', (select count(*) from (select 1 from {appointments}
               where status <> 'Cancelled' group by doctor_id, appt_date, appt_time having count(*) > 1) k)"""
        )
    parts += [
        f"""select '{table}', '{column} exists in {target}', (select count(*) from {{{table}}} x
            where {column} is not null and not exists (select 1 from {{{target}}} y where y.{key} = x.{column}))"""
        for table, column, target, key in links
    ]
    return " union all ".join(parts)


def _required(table: str, *columns: str) -> dict[str, str]:
    return {f"{c} required": f"{c} is null" for c in columns}


_CLINIC = _findings_sql(
    {
            "appointments": {
                "appt_id required": "appt_id is null",
                "appt_date required": "appt_date is null",
                "appt_time required": "appt_time is null",
                "appt_type in allowed values": "appt_type not in ('OPD', 'IPD', 'Emergency')",
                "status in allowed values": "status not in ('Pending', 'Confirmed', 'Completed', 'Cancelled')",
                "appt_time within hours": "appt_time < '08:00:00' or appt_time > '20:00:00'",
            },
            "bills": {
                "bill_id required": "bill_id is null",
                "status in allowed values": "status not in ('Unpaid', 'Partial', 'Paid')",
                "insurance_covered <= total_amount": "insurance_covered > total_amount",
                "net_payable >= 0": "net_payable < 0",
                "fully insured bill left open": "net_payable = 0 and status <> 'Paid'",
            },
            "prescriptions": {
                "rx_id required": "rx_id is null",
                "dosage at most 50 characters": "length(dosage) > 50",
                "frequency at most 50 characters": "length(frequency) > 50",
            },
        },
    [("appointments", "appt_id"), ("bills", "bill_id"), ("prescriptions", "rx_id")],
    [
        ("appointments", "patient_id", "patients", "patient_id"),
        ("appointments", "doctor_id", "doctors", "doctor_id"),
        ("prescriptions", "diag_id", "diagnoses", "diag_id"),
        ("prescriptions", "medicine_id", "medicines", "medicine_id"),
        ("bills", "patient_id", "patients", "patient_id"),
        ("bills", "appt_id", "appointments", "appt_id"),
        ("bills", "generated_by", "users", "user_id"),
    ],
)
_MASTER = _findings_sql(
    {
        "roles": _required("roles", "role_id", "role_name"),
        "users": _required("users", "user_id", "username"),
        "insurance": _required("insurance", "insurance_id"),
        "patients": {
            **_required("patients", "patient_id", "full_name", "date_of_birth", "phone"),
            "gender in allowed values": "gender not in ('Male', 'Female', 'Other')",
            "blood_group in allowed values": "blood_group not in ('A+', 'A-', 'B+', 'B-', 'AB+', 'AB-', 'O+', 'O-')",
            "status in allowed values": "status not in ('Active', 'Discharged')",
            "full_name at most 100 characters": "length(full_name) > 100",
            "phone at most 15 characters": "length(phone) > 15",
            "email at most 100 characters": "length(email) > 100",
        },
        "departments": _required("departments", "dept_id", "dept_name"),
        "doctors": _required("doctors", "doctor_id", "full_name"),
        "diagnoses": {
            **_required("diagnoses", "diag_id"),
            "severity in allowed values": "severity not in ('Mild', 'Moderate', 'Severe')",
        },
        "medicines": {
            **_required("medicines", "medicine_id", "brand_name"),
            "brand_name at most 100 characters": "length(brand_name) > 100",
            "generic_name at most 100 characters": "length(generic_name) > 100",
            "category at most 50 characters": "length(category) > 50",
            "stock_quantity >= 0": "stock_quantity < 0",
            "unit_price > 0": "unit_price <= 0",
        },
        "lab_tests": _required("lab_tests", "test_id", "test_name"),
        "lab_orders": {
            **_required("lab_orders", "order_id"),
            "status in allowed values": "status not in ('Pending', 'Collected', 'Done')",
            "result_value at most 100 characters": "length(result_value) > 100",
        },
        "bill_items": {
            **_required("bill_items", "item_id"),
            "service_type in allowed values": "service_type not in ('Consultation', 'Lab', 'Pharmacy')",
        },
        "payments": {
            **_required("payments", "payment_id"),
            "payment_mode in allowed values": "payment_mode not in ('Cash', 'Card', 'UPI', 'Insurance')",
            "amount_paid > 0": "amount_paid <= 0",
        },
    },
    [
        ("roles", "role_id"), ("roles", "role_name"), ("users", "user_id"), ("users", "username"), ("insurance", "insurance_id"),
        ("insurance", "policy_number"), ("patients", "patient_id"), ("patients", "phone"), ("departments", "dept_id"),
        ("doctors", "doctor_id"), ("diagnoses", "diag_id"), ("medicines", "medicine_id"), ("lab_tests", "test_id"),
        ("lab_orders", "order_id"), ("bill_items", "item_id"), ("payments", "payment_id"),
    ],
    [
        ("users", "role_id", "roles", "role_id"),
        ("patients", "insurance_id", "insurance", "insurance_id"),
        ("doctors", "dept_id", "departments", "dept_id"),
        ("diagnoses", "appt_id", "appointments", "appt_id"),
        ("lab_orders", "appt_id", "appointments", "appt_id"),
        ("lab_orders", "test_id", "lab_tests", "test_id"),
        ("bill_items", "bill_id", "bills", "bill_id"),
        ("payments", "bill_id", "bills", "bill_id"),
        ("payments", "received_by", "users", "user_id"),
    ],
)


@query("r16_table_constraints", _CLINIC)
def r16(h: Hospital) -> DataFrame:
    return constraint_findings(h, ["appointments", "bills", "prescriptions"])


@query("r16b_master_and_detail_constraints", _MASTER)
def r16b(h: Hospital) -> DataFrame:
    """The other stored tables: required columns, codes, lengths, values, keys and references."""
    tables = "roles users insurance patients departments doctors diagnoses medicines lab_tests lab_orders bill_items payments"
    return constraint_findings(h, tables.split())


_SCREEN = """
    select row_id, full_name is null or length(trim(full_name)) < 2 or length(trim(full_name)) > 100
                     or not regexp_matches(trim(full_name), '^[A-Za-z .''-]+$') as name_bad,
           date_of_birth is null or date_of_birth >= date '1998-06-15' or (date '1998-06-15' - date_of_birth) // 365 > 120 as dob_bad,
           dosage is null or trim(dosage) = '' or length(trim(dosage)) > 50 as dosage_bad from {intake}"""


def _screen_rules() -> dict[str, Column]:
    return {
        "name": rules.name("full_name"),
        "date_of_birth": rules.date_of_birth("date_of_birth", AS_OF),
        "dosage": rules.dosage("dosage"),
    }


@query(
    "r18_screened_in_one_pass",
    f"""with p as ({_SCREEN})
        select row_id, case when name_bad or dob_bad or dosage_bad then 'quarantined' else 'valid' end as outcome,
               cast(name_bad as int) + cast(dob_bad as int) + cast(dosage_bad as int) as messages,
               (select count(*) filter (name_bad) from p) as bad_names, (select count(*) from p) as seen from p""",
)
def r18(h: Hospital) -> DataFrame:
    """Every intake row with the outcome that it was written under, and two of the counts taken while writing."""
    got = screen(h.intake, _screen_rules(), f"{shared_folder(h.spark)}/screened/{uuid.uuid4().hex}")
    good = got.valid.select("row_id", F.lit("valid").alias("outcome"), F.lit(0).alias("messages"))
    bad = got.quarantined.select("row_id", F.lit("quarantined").alias("outcome"), F.size("errors").alias("messages"))
    return good.unionByName(bad).withColumns(
        {"bad_names": F.lit(got.failures["name"]).cast("long"), "seen": F.lit(got.rows).cast("long")}
    )


@query(
    "r17_quality_scan",
    """with p as (
         select row_id, full_name is null or length(trim(full_name)) < 2 or length(trim(full_name)) > 100
                          or not regexp_matches(trim(full_name), '^[A-Za-z .''-]+$') as name_bad,
                date_of_birth is null or date_of_birth >= date '1998-06-15' or (date '1998-06-15' - date_of_birth) // 365 > 120 as dob_bad,
                dosage is null or trim(dosage) = '' or length(trim(dosage)) > 50 as dosage_bad from {intake})
       select 'name' as rule, count(*) filter (name_bad) as failures, count(*) filter (name_bad or dob_bad or dosage_bad) as quarantined from p
       union all select 'date_of_birth', count(*) filter (dob_bad), count(*) filter (name_bad or dob_bad or dosage_bad) from p
       union all select 'dosage', count(*) filter (dosage_bad), count(*) filter (name_bad or dob_bad or dosage_bad) from p""",
)
def r17(h: Hospital) -> DataFrame:
    scan = quality_scan(
        h.intake,
        {
            "name": rules.name("full_name"),
            "date_of_birth": rules.date_of_birth("date_of_birth", AS_OF),
            "dosage": rules.dosage("dosage"),
        },
    )
    held = scan.quarantined.agg(F.count("*").alias("n")).scalar()
    return scan.failures.withColumn("quarantined", held)


@query(
    "n1_sanitize_string",
    "select row_id, coalesce(trim(regexp_replace(full_name, ' +', ' ', 'g')), '') as cleaned from {intake}",
)
def n1(h: Hospital) -> DataFrame:
    return h.intake.select("row_id", text.sanitize_string("full_name").alias("cleaned"))


@query(
    "n2_sanitize_phone",
    """with c as (select row_id, regexp_replace(coalesce(phone, ''), '[^0-9]', '', 'g') as p from {intake})
       select row_id, right(case when length(p) = 12 and starts_with(p, '91') then substr(p, 3) else p end, 10) as cleaned from c""",
)
def n2(h: Hospital) -> DataFrame:
    return h.intake.select("row_id", text.sanitize_phone("phone").alias("cleaned"))


@query("n3_sanitize_email", "select row_id, lower(trim(coalesce(email, ''))) as cleaned from {intake}")
def n3(h: Hospital) -> DataFrame:
    return h.intake.select("row_id", text.sanitize_email("email").alias("cleaned"))


@query(
    "n4_error_wording",
    """select event_id, case
         when strpos(lower(message), 'duplicate key value violates unique constraint') > 0 then 'This record already exists. Please check for duplicates.'
         when strpos(lower(message), 'violates foreign key constraint') > 0 then 'Cannot complete — a related record is missing.'
         when strpos(lower(message), 'violates check constraint') > 0 then 'The value entered is not allowed for this field.'
         when strpos(lower(message), 'null value in column') > 0 then 'A required field is missing. Please fill all required fields.'
         when strpos(lower(message), 'value too long for type') > 0 then 'One of the fields is too long. Please shorten your input.'
         when strpos(lower(message), 'invalid input syntax for type') > 0 then 'Invalid format — please check dates, numbers and special characters.'
         when strpos(lower(message), 'slot conflict') > 0 then 'This appointment slot is already taken. Please choose a different time.'
         when strpos(lower(message), 'connection refused') > 0 then 'Cannot connect to database. Please ensure PostgreSQL is running.'
         when strpos(lower(message), 'already marked') > 0 then 'This record has already been processed.'
         when strpos(lower(message), 'insufficient stock') > 0 then 'Not enough stock available for this medicine.'
         else 'Database error: ' || case when length(split_part(message, chr(10), 1)) > 200
              then substr(split_part(message, chr(10), 1), 1, 200) || '...' else split_part(message, chr(10), 1) end end as wording
       from {error_log}""",
)
def n4(h: Hospital) -> DataFrame:
    return h.error_log.select("event_id", friendly_error("message").alias("wording"))
