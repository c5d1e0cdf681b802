"""Master data: patients, insurance policies, medicines, doctors and accounts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions import rules
from wardline.functions.dates import AsOf
from wardline.functions.ordering import first_of, highest, with_sequence
from wardline.functions.text import blank, sanitize_email, sanitize_phone, sanitize_string, strip
from wardline.schema import ENUMS
from wardline.plans.claims import LAST_ROWS, admit_claims
from wardline.plans.common import REASON, Change, Outcome, changed, first_failure, known
from wardline.plans.moves import admit_moves
from wardline.sources.staging import cut
from wardline.sources.tables import Hospital, conform

ORDER = ["request_ts", "request_id"]

# Reason texts.
PHONE_EXISTS = ("A patient with phone number ", " already exists.")
EMAIL_EXISTS = ("A patient with email ", " is already registered.")
NO_PHONE = "Phone number is required."
NO_GENDER = "Gender is required."
NO_BLOOD_GROUP = "Blood Group is required."
DUPLICATE = "This record already exists. Please check for duplicates."
NO_RECORD = "Record not found."
OWN_ACCOUNT = "You cannot disable your own account."
DOCTOR_STATUSES = ("Active", "Inactive", "On Leave")


def _around(texts: tuple[str, str], value: str) -> Column:
    return F.concat(F.lit(texts[0]), F.col(value), F.lit(texts[1]))


def _sanitized(name: str, rule: Column) -> Column:
    return F.when(~blank(name), rule)


# Patients -----------------------------------------------------------------------------------------


def _one_of(column: str) -> Column:
    return F.coalesce(F.col(column).isin(*ENUMS["patients", column]), F.lit(False))


def registration_form(as_of: AsOf) -> list[tuple[Column, str] | Column]:
    """What the registration form asks for, in its order."""
    return [
        rules.name("full_name", "Full Name"),
        rules.date_of_birth("date_of_birth", as_of),
        (~_one_of("gender"), NO_GENDER),
        (~_one_of("blood_group"), NO_BLOOD_GROUP),
        rules.phone("phone"),
        rules.email("email"),
    ]


def register_patients(
    h: Hospital, requests: DataFrame, *, as_of: AsOf | None = None, last: int = LAST_ROWS
) -> Outcome:
    """requests: request_id, request_ts and the patient columns.

    With as_of, requests that fail the form are refused first; a phone number is required always.

    In arrival order, a request is admitted when neither its phone nor its e-mail belongs to a patient
    or to an earlier admitted request. A refused request reserves nothing, so the two keys interact; see
    plans/claims.py for how that is decided, and for last.
    """
    form = [(blank("phone"), NO_PHONE)] if as_of is None else registration_form(as_of)
    clean = requests.withColumn("_form", first_failure(*form)).withColumns(
        {
            "full_name": sanitize_string("full_name"),
            "phone": sanitize_phone("phone"),
            "email": _sanitized("email", sanitize_email("email")),
            "address": _sanitized("address", sanitize_string("address")),
            "emergency_contact": _sanitized("emergency_contact", sanitize_string("emergency_contact")),
        }
    )
    phones = h.patients.select("phone").distinct()
    emails = h.patients.filter(F.col("email").isNotNull()).select("email").distinct()
    marked = cut(known(known(clean, phones, "phone", "_phone_known"), emails, "email", "_email_known"))
    free = marked.filter(F.col("_form").isNull() & ~F.col("_phone_known") & ~F.col("_email_known"))
    won = admit_claims(free, keys=["phone", "email"], order=ORDER, row_id="request_id", last=last)
    accepted_keys = cut(free.select("phone", *ORDER).join(won, "request_id", "left_semi"))
    owner = accepted_keys.select("phone", F.struct(*ORDER).alias("_holder"))
    decided = known(marked, accepted_keys.select("request_id"), "request_id", "_in").join(owner, "phone", "left")
    phone_taken = F.col("_phone_known") | F.coalesce(F.col("_holder") < F.struct(*ORDER), F.lit(False))
    reason = first_failure(
        F.col("_form"),
        (F.col("_in"), F.lit(None).cast("string")),
        (phone_taken, _around(PHONE_EXISTS, "phone")),
        (F.lit(True), _around(EMAIL_EXISTS, "email")),
    )
    decided = decided.withColumn(REASON, reason).drop("_phone_known", "_email_known", "_in", "_holder", "_form")
    accepted = with_sequence(
        decided.filter(F.col(REASON).isNull()).drop(REASON),
        [F.col(c) for c in ORDER],
        "patient_id",
        highest(h.patients, "patient_id"),
    )
    new = accepted.withColumn("registration_date", F.col("request_ts")).withColumn("status", F.lit("Active"))
    return Outcome(
        accepted,
        decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON),
        {"patients": _appended(h.patients, conform(new, "patients"))},
    )


def _appended(table: DataFrame, new: DataFrame) -> DataFrame:
    types = dict(table.dtypes)
    return table.unionByName(new.select(*[F.col(c).cast(types[c]).alias(c) for c in table.columns]))


def update_patients(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, patient_id, phone, email, address, emergency_contact, status.

    Blank optional fields become NULL. A phone that another patient has at that time is refused: one from the
    start that no earlier request has changed, or one that an earlier request gave. Of several accepted changes to
    one patient the last one stays.
    """
    columns = ["phone", "email", "address", "emergency_contact", "status"]
    checked = known(requests, h.patients, "patient_id", "_known").withColumn("_clean", sanitize_phone("phone"))
    static = first_failure(rules.phone("phone"), rules.email("email"), (~F.col("_known"), NO_RECORD))
    checked = cut(checked.withColumn(REASON, static).drop("_known"))
    holders = h.patients.filter(F.col("phone").isNotNull()).select("patient_id", F.col("phone").alias("_clean"))
    valid = checked.filter(F.col(REASON).isNull())
    won = admit_moves(valid, holders, place=["_clean"], owner="patient_id", order=ORDER, row_id="request_id")
    decided = known(checked, won, "request_id", "_won").withColumn(
        REASON, F.coalesce(REASON, F.when(~F.col("_won"), DUPLICATE))
    )
    accepted = decided.filter(F.col(REASON).isNull()).withColumns(
        {
            "phone": F.col("_clean"),
            "email": _sanitized("email", sanitize_email("email")),
            "address": _sanitized("address", sanitize_string("address")),
            "emergency_contact": _sanitized("emergency_contact", sanitize_string("emergency_contact")),
        }
    ).drop("_clean", "_won", REASON)
    present = [c for c in columns if c in h.patients.columns]
    rejected = decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON)
    change = Change(last_change(accepted, "patient_id", present), "patient_id", present)
    return changed(accepted, rejected, "patients", h.patients, change)


def last_change(changes: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """The newest change per key, by aggregation."""
    newest = F.max_by(F.struct(*columns), F.struct(*ORDER)).alias("_row")
    return changes.groupBy(key).agg(newest).select(key, "_row.*")


# Insurance ----------------------------------------------------------------------------------------


def upsert_insurance(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, provider_name, policy_number, coverage_amount, expiry_date.

    A known policy is reused as it is; a new one is added once, from its first request. Every accepted
    request carries the insurance_id it resolved to.
    """
    clean = requests.withColumn("policy_number", strip("policy_number")).withColumn("provider_name", strip("provider_name"))
    incomplete = rules.insurance_block("provider_name", "policy_number", "coverage_amount")
    none_given = blank("provider_name") & blank("policy_number")
    checked = cut(clean.withColumn(REASON, first_failure(incomplete, (none_given, "Policy number required."))))
    valid = checked.filter(F.col(REASON).isNull()).drop(REASON)
    existing = h.insurance.select("policy_number", "insurance_id")
    fresh = valid.join(existing.select("policy_number"), "policy_number", "left_anti")
    winners = first_of(fresh, ["policy_number"], ORDER, "request_id")
    new = with_sequence(
        fresh.join(winners.select("request_id"), "request_id", "left_semi"),
        [F.col(c) for c in ORDER],
        "insurance_id",
        highest(h.insurance, "insurance_id"),
    )
    ids = existing.unionByName(new.select("policy_number", "insurance_id"))
    rows = new.select(
        "insurance_id", "provider_name", "policy_number",
        F.col("coverage_amount").cast("decimal(12,2)").alias("coverage_amount"), "expiry_date",
    )
    return Outcome(
        valid.join(ids, "policy_number"),
        checked.filter(F.col(REASON).isNotNull()).select("request_id", REASON),
        {"insurance": _appended(h.insurance, conform(rows, "insurance"))},
    )


# Medicines, doctors, accounts ---------------------------------------------------------------------


def _add(
    h: Hospital, requests: DataFrame, table: str, key: str, reason: Column, keys: dict[str, Column], taken: DataFrame, text: Column | str
) -> Outcome:
    """Append requests that pass `reason` and whose natural key neither exists nor came earlier."""
    checked = cut(requests.withColumns(keys).withColumn(REASON, reason))
    names = list(keys)
    held = taken.select(*names).distinct().withColumn("_held", F.lit(True))
    checked = checked.join(held, names, "left") if names else checked.withColumn("_held", F.lit(None))
    checked = checked.withColumn(REASON, F.coalesce(REASON, F.when(F.col("_held").isNotNull(), text))).drop("_held")
    if names:
        winners = first_of(checked.filter(F.col(REASON).isNull()), names, ORDER, "request_id")
        checked = known(checked, winners, "request_id", "_won").withColumn(
            REASON, F.coalesce(REASON, F.when(~F.col("_won"), text))
        ).drop("_won")
    accepted = with_sequence(
        checked.filter(F.col(REASON).isNull()).drop(REASON, *names),
        [F.col(c) for c in ORDER],
        key,
        highest(h.table(table), key),
    )
    return Outcome(
        accepted,
        checked.filter(F.col(REASON).isNotNull()).select("request_id", REASON),
        {table: _appended(h.table(table), conform(accepted, table))},
    )


def add_medicines(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, brand_name, generic_name, category, stock_quantity,
    reorder_level, unit_price, expiry_date. Brand and generic name together are unique, whatever the case."""
    generic = rules.medicine_name("generic_name")
    price = rules.amount("unit_price", "Unit Price")
    stock = rules.stock_quantity("stock_quantity")
    brand = rules.medicine_name("brand_name")
    reason = first_failure(
        brand,
        (generic.isNotNull(), F.concat(F.lit("Generic name: "), generic)),
        (blank("category"), "Category is required."),
        stock,
        price,
        (F.col("reorder_level") < 1, "Reorder level must be at least 1."),
    )
    keys = {"_brand": F.lower(strip("brand_name")), "_generic": F.lower(strip("generic_name"))}
    taken = h.medicines.select(F.lower("brand_name").alias("_brand"), F.lower("generic_name").alias("_generic"))
    text = F.concat(
        F.lit("Medicine '"), F.col("brand_name"), F.lit("' ("), F.col("generic_name"), F.lit(") already exists in inventory.")
    )
    cleaned = requests.withColumn("brand_name", strip("brand_name")).withColumn("generic_name", strip("generic_name"))
    return _add(h, cleaned, "medicines", "medicine_id", reason, keys, taken, text)


def add_users(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, username, role_id. Usernames are unique whatever the case and
    stored in lower case; accounts carry no password here."""
    problem = rules.username("username")
    with_role = known(requests, h.roles, "role_id", "_role")
    reason = first_failure(problem, (~F.col("_role"), "Role required."))
    keys = {"_name": F.lower(strip("username"))}
    taken = h.users.select(F.lower("username").alias("_name"))
    text = F.concat(F.lit("Username '"), F.col("username"), F.lit("' already taken."))
    cleaned = with_role.withColumn("username", F.lower(strip("username")))
    return _add(h, cleaned, "users", "user_id", reason, keys, taken, text)


def add_doctors(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, full_name, dept_id, specialization, qualification, phone, email, opd_fee."""
    name, phone, email = rules.name("full_name"), rules.phone("phone"), rules.email("email")
    with_dept = known(requests, h.departments, "dept_id", "_dept")
    reason = first_failure(
        name,
        (~F.col("_dept"), "Department required."),
        (blank("specialization"), "Specialization required."),
        (blank("qualification"), "Qualification required."),
        phone,
        email,
    )
    checked = cut(with_dept.withColumn(REASON, reason).drop("_dept"))
    accepted = with_sequence(
        checked.filter(F.col(REASON).isNull()).drop(REASON),
        [F.col(c) for c in ORDER],
        "doctor_id",
        highest(h.doctors, "doctor_id"),
    )
    new = accepted.withColumns(
        {
            "full_name": sanitize_string("full_name"),
            "specialization": sanitize_string("specialization"),
            "qualification": sanitize_string("qualification"),
            "phone": strip("phone"),
            "email": _sanitized("email", strip("email")),
        }
    )
    return Outcome(
        accepted,
        checked.filter(F.col(REASON).isNotNull()).select("request_id", REASON),
        {"doctors": _appended(h.doctors, conform(new, "doctors"))},
    )


def update_doctors(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, doctor_id, opd_fee, status."""
    checked = known(requests, h.doctors, "doctor_id", "_known")
    reason = first_failure(
        (~F.col("_known"), NO_RECORD),
        (F.coalesce(F.col("opd_fee") < 0, F.lit(True)), "Fee must not be negative."),
        (~F.coalesce(F.col("status").isin(*DOCTOR_STATUSES), F.lit(False)), "Unknown status."),
    )
    return _changed(h, checked, reason, "doctors", "doctor_id", ["opd_fee", "status"])


def update_accounts(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, user_id, is_active, by_user. Any change also lifts a lock."""
    checked = known(requests, h.users, "user_id", "_known").withColumns(
        {"failed_attempts": F.lit(0), "locked_until": F.lit(None).cast("timestamp_ntz")}
    )
    reason = first_failure((F.col("user_id") == F.col("by_user"), OWN_ACCOUNT), (~F.col("_known"), NO_RECORD))
    columns = [c for c in ("is_active", "failed_attempts", "locked_until") if c in h.users.columns]
    return _changed(h, checked, reason, "users", "user_id", columns)


def _changed(h: Hospital, checked: DataFrame, reason: Column, table: str, key: str, columns: Sequence[str]) -> Outcome:
    types = dict(h.table(table).dtypes)
    decided = checked.withColumn(REASON, reason).drop("_known")
    accepted = decided.filter(F.col(REASON).isNull()).drop(REASON)
    typed = accepted.withColumns({c: F.col(c).cast(types[c]) for c in columns})
    rejected = decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON)
    return changed(accepted, rejected, table, h.table(table), Change(last_change(typed, key, columns), key, columns))
