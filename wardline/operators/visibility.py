"""Who sees which rows, as row filters, and who holds which privileges."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wardline.sources.tables import Hospital

# Per protected table, the roles that see all rows. The Doctor sees own rows; any other
# role sees none.
SEES_ALL = {
    "appointments": ("Receptionist", "Billing_Staff", "Admin", "Lab_Tech", "Pharmacist"),
    "diagnoses": ("Admin", "Billing_Staff", "Pharmacist"),
    "prescriptions": ("Admin", "Billing_Staff", "Pharmacist"),
    "lab_orders": ("Lab_Tech", "Admin", "Billing_Staff"),
}
DOCTOR = "Doctor"


def visible(h: Hospital, table: str, *, role: str, user_id: int | None = None) -> DataFrame:
    """Rows of a table that a user in a role sees. A doctor without a linked profile sees none."""
    rows = h.table(table)
    if table not in SEES_ALL or role in SEES_ALL[table]:
        return rows
    if role != DOCTOR or user_id is None:
        return rows.filter(F.lit(False))
    own = h.users.filter(F.col("user_id") == user_id).select("staff_ref_id").scalar()
    appointments = h.appointments.filter(F.col("doctor_id") == own)
    return _through(h, table, rows, appointments)


def _through(h: Hospital, table: str, rows: DataFrame, appointments: DataFrame) -> DataFrame:
    if table == "appointments":
        return appointments
    if table == "prescriptions":
        found = h.diagnoses.join(appointments.select("appt_id"), "appt_id", "left_semi")
        return rows.join(found.select("diag_id"), "diag_id", "left_semi")
    return rows.join(appointments.select("appt_id"), "appt_id", "left_semi")


def doctor_users(h: Hospital) -> DataFrame:
    """(user_id, doctor_id) of accounts in the doctor role with a staff reference."""
    role = h.roles.filter(F.col("role_name") == DOCTOR).select("role_id").scalar()
    return h.users.filter(F.col("staff_ref_id").isNotNull() & (F.col("role_id") == role)).select(
        "user_id", F.col("staff_ref_id").alias("doctor_id")
    )


def own_rows(h: Hospital, table: str, key: str) -> DataFrame:
    """(user_id, key) of every row that some doctor account sees as its own."""
    owners = h.appointments.select("appt_id", "doctor_id").join(doctor_users(h), "doctor_id").select("user_id", "appt_id")
    if table == "appointments":
        return owners
    if table == "prescriptions":
        owners = h.diagnoses.select("diag_id", "appt_id").join(owners, "appt_id").select("user_id", "diag_id")
        return h.prescriptions.select(key, "diag_id").join(owners, "diag_id").select("user_id", key)
    return h.table(table).select(key, "appt_id").join(owners, "appt_id").select("user_id", key)


def visible_counts(h: Hospital, table: str) -> DataFrame:
    """Rows each role sees of a protected table: all, own (summed over its doctor accounts) or none."""
    total = h.table(table).agg(F.count("*").alias("_all"))
    own = own_rows(h, table, {"appointments": "appt_id"}.get(table, _key(table))).agg(F.count("*").alias("_own"))
    return h.roles.select(
        "role_name",
        F.when(F.col("role_name").isin(*SEES_ALL[table]), total.scalar())
        .when(F.col("role_name") == DOCTOR, own.scalar())
        .otherwise(F.lit(0))
        .cast("long")
        .alias("visible_rows"),
    )


def _key(table: str) -> str:
    from wardline.schema import KEYS

    return KEYS[table]


def privilege_matrix(h: Hospital) -> DataFrame:
    """Privileges per role and table as one ordered text, with the number of accounts that hold them."""
    listed = h.grants.select("role_name", "table_name", "privilege_type").distinct()
    texts = listed.groupBy("role_name", "table_name").agg(
        F.expr("listagg(privilege_type, ', ') within group (order by privilege_type)").alias("privileges")
    )
    holders = h.users.groupBy("role_id").agg(F.count("*").alias("accounts")).join(
        h.roles.select("role_id", "role_name"), "role_id"
    )
    return texts.join(holders.select("role_name", "accounts"), "role_name").orderBy("role_name", "table_name")
