"""Registered audit, visibility and streaming queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from wardline.catalog.oracle import d, m, t
from wardline.catalog.registry import AS_OF, query
from wardline.functions.ordering import up, with_sequence
from wardline.operators import audit, visibility
from wardline.plans import clinical, pharmacy
from wardline.sources.images import write_image
from wardline.sources.sinks import read_audit
from wardline.sources.staging import cut, shared_folder, written
from wardline.sources.tables import Hospital
from wardline.streaming import live, lockout, runs, sessions

# Audit --------------------------------------------------------------------------------------------
#
# Two days' images: bills before and after the payments; appointments whose cancelled rows were purged
# and pending ones confirmed; the patients of before and of after the as-of date.


def _changes(h: Hospital) -> DataFrame:
    appointments = h.appointments
    later = appointments.filter(F.col("status") != "Cancelled").withColumn(
        "status", F.when(F.col("status") == "Pending", "Confirmed").otherwise(F.col("status"))
    )
    known = h.patients.filter(F.col("registration_date") < F.lit(AS_OF))
    return (
        audit.row_changes("bills", h.new_bills, h.bills, as_of=AS_OF)
        .unionByName(audit.row_changes("appointments", appointments, later, as_of=AS_OF))
        .unionByName(audit.row_changes("patients", known, h.patients, as_of=AS_OF))
    )


_CHANGES = f"""
    select 'bills' as table_name, 'UPDATE' as operation, bill_id as record_id from {{bills}} where status <> 'Unpaid'
    union all select 'appointments', case status when 'Cancelled' then 'DELETE' else 'UPDATE' end, appt_id
    from {{appointments}} where status in ('Cancelled', 'Pending')
    union all select 'patients', 'INSERT', patient_id from {{patients}} where registration_date >= date '{AS_OF}'"""


@query("a1_row_changes", _CHANGES)
def a1(h: Hospital) -> DataFrame:
    return _changes(h).select("table_name", "operation", "record_id")


@query("a1b_image_changes", f"select * from ({_CHANGES}) c where table_name = 'appointments'")
def a1b(h: Hospital) -> DataFrame:
    """The appointments of both days stored as images, and compared by the digests of their buckets."""
    base = f"{shared_folder(h.spark)}/images/{uuid.uuid4().hex}"
    later = h.appointments.filter(F.col("status") != "Cancelled").withColumn(
        "status", F.when(F.col("status") == "Pending", "Confirmed").otherwise(F.col("status"))
    )
    write_image(h.appointments, f"{base}/old", "appt_id")
    write_image(later, f"{base}/new", "appt_id")
    changes = audit.image_changes(h.spark, "appointments", f"{base}/old", f"{base}/new", as_of=AS_OF)
    return changes.select("table_name", "operation", "record_id")


_LOG = f"""
    select table_name, operation, record_id, row_number() over (order by table_name, record_id) as log_id,
           timestamp '{AS_OF} 08:00:00' + to_hours(cast(record_id % 40 as int)) as changed_at,
           case when record_id % 4 = 0 then null else record_id % 30 end as changed_by
    from ({_CHANGES}) c"""


def _log(h: Hospital) -> DataFrame:
    when = F.timestamp_add("HOUR", (F.col("record_id") % 40).cast("int"), F.lit(f"{AS_OF} 08:00:00").cast("timestamp_ntz"))
    by = F.when(F.col("record_id") % 4 != 0, F.col("record_id") % 30)
    entries = _changes(h).withColumn("changed_at", when).withColumn("changed_by", by)
    return with_sequence(entries, [up("table_name"), up("record_id")], "log_id")


@query(
    "a2_audit_entries",
    f"""select log_id, table_name, operation, record_id, coalesce(u.username, 'System') as changed_by, {t('changed_at')}
        from ({_LOG}) l left join {{users}} u on u.user_id = l.changed_by
        where cast(l.changed_at as date) = date '{AS_OF}' and operation = 'UPDATE'
        order by l.changed_at desc, log_id desc limit 100""",
)
def a2(h: Hospital) -> DataFrame:
    return audit.audit_entries(h, _log(h), on=AS_OF, operation="UPDATE").drop("old_values", "new_values")


def _fields(table: str, key: str, columns: dict[str, str], where: str, side: str) -> str:
    """One row per non-empty field of rows that exist on one side only."""
    values = " union all ".join(
        f"select '{table}' as table_name, {key} as record_id, '{name}' as field, {text} as v from {{{table}}} where {where}"
        for name, text in columns.items()
    )
    shown = "null as old_value, v as new_value" if side == "new" else "v as old_value, null as new_value"
    return f"select table_name, record_id, field, {shown} from ({values}) f where v is not null"


_APPT = {c: f"cast({c} as varchar)" for c in ("appt_id", "patient_id", "doctor_id", "appt_date", "appt_time", "appt_type", "status", "notes")}
_APPT["created_at"] = "strftime(created_at, '%Y-%m-%dT%H:%M:%S.000')"
_PATIENT = {
    c: f"cast({c} as varchar)"
    for c in ("patient_id", "full_name", "date_of_birth", "gender", "blood_group", "phone", "email", "address", "insurance_id", "registration_date", "status")
}


@query(
    "a3_changed_fields",
    f"""select 'bills' as table_name, bill_id as record_id, 'status' as field, 'Unpaid' as old_value, status as new_value
        from {{bills}} where status <> 'Unpaid'
        union all select 'appointments', appt_id, 'status', 'Pending', 'Confirmed' from {{appointments}} where status = 'Pending'
        union all {_fields('appointments', 'appt_id', _APPT, "status = 'Cancelled'", 'old')}
        union all {_fields('patients', 'patient_id', _PATIENT, f"registration_date >= date '{AS_OF}'", 'new')}""",
)
def a3(h: Hospital) -> DataFrame:
    return audit.changed_fields(_changes(h), "table_name", "record_id")


# Visibility ---------------------------------------------------------------------------------------

_OWNERS = """
    select u.user_id, a.appt_id from {users} u join {roles} r on r.role_id = u.role_id and r.role_name = 'Doctor'
    join {appointments} a on a.doctor_id = u.staff_ref_id"""


@query("v1_own_appointments", _OWNERS)
def v1(h: Hospital) -> DataFrame:
    return visibility.own_rows(h, "appointments", "appt_id")


@query("v2_own_diagnoses", f"select o.user_id, x.diag_id from {{diagnoses}} x join ({_OWNERS}) o using (appt_id)")
def v2(h: Hospital) -> DataFrame:
    return visibility.own_rows(h, "diagnoses", "diag_id")


@query(
    "v3_own_prescriptions",
    f"select o.user_id, x.rx_id from {{prescriptions}} x join {{diagnoses}} g using (diag_id) join ({_OWNERS}) o using (appt_id)",
)
def v3(h: Hospital) -> DataFrame:
    return visibility.own_rows(h, "prescriptions", "rx_id")


@query("v4_own_lab_orders", f"select o.user_id, x.order_id from {{lab_orders}} x join ({_OWNERS}) o using (appt_id)")
def v4(h: Hospital) -> DataFrame:
    return visibility.own_rows(h, "lab_orders", "order_id")


@query(
    "v4b_lab_orders_per_role",
    f"""select role_name, case when role_name in ('Lab_Tech', 'Admin', 'Billing_Staff') then (select count(*) from {{lab_orders}})
               when role_name = 'Doctor' then (select count(*) from {{lab_orders}} x join ({_OWNERS}) o using (appt_id)) else 0 end as visible_rows
        from {{roles}}""",
)
def v4b(h: Hospital) -> DataFrame:
    return visibility.visible_counts(h, "lab_orders")


@query(
    "v4c_one_doctor_prescriptions",
    f"""select x.rx_id, x.diag_id, x.medicine_id from ({_OWNERS}) o join {{diagnoses}} g using (appt_id)
        join {{prescriptions}} x using (diag_id) where o.user_id = 1003""",
)
def v4c(h: Hospital) -> DataFrame:
    return visibility.visible(h, "prescriptions", role="Doctor", user_id=1003).select("rx_id", "diag_id", "medicine_id")


@query(
    "v5_privilege_matrix",
    """select g.role_name, g.table_name, string_agg(g.privilege_type, ', ' order by g.privilege_type) as privileges, any_value(n.accounts) as accounts
       from (select distinct * from {grants}) g join (select role_name, count(*) as accounts from {users} join {roles} using (role_id) group by role_name) n
         using (role_name) group by g.role_name, g.table_name""",
)
def v5(h: Hospital) -> DataFrame:
    return visibility.privilege_matrix(h)


# Streams and their batch twins --------------------------------------------------------------------


def _event_stream(h: Hospital) -> DataFrame:
    """The events file as a stream."""
    return runs.parquet_stream(h.spark, h.root, h.events.schema, names="events.parquet")


_LOCKOUT = f"""select user_id, event_id, {t('ts')}, outcome, failed_attempts, {t('locked_until')} from {{login_walk}} where rn > 0"""


@query("t1_login_lockout", _LOCKOUT)
def t1(h: Hospital) -> DataFrame:
    return lockout.lockouts(lockout.login_attempts(h.events))


@query("t1b_login_lockout_stream", _LOCKOUT)
def t1b(h: Hospital) -> DataFrame:
    """One file: everything waits until the feed has ended and the watermark has passed it."""
    attempts, tick = runs.with_last_tick(lockout.login_attempts(_event_stream(h)), "ts", "2100-01-01 00:00:00")
    return runs.run_to_parquet(lockout.lockout_stream(attempts, buckets=256), then=tick).filter("user_id is not null")


@query("t1d_login_lockout_shuffled", _LOCKOUT)
def t1d(h: Hospital) -> DataFrame:
    """The feed by four days a file, one file in a micro-batch, its rows in any order; a third of a file's rows come with the next."""
    attempts = lockout.login_attempts(h.events)
    days = F.datediff(F.to_date("ts"), attempts.agg(F.to_date(F.min("ts"))).scalar())
    file = F.floor(days / 4) + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)
    laid = cut(attempts.withColumn("file", F.least(file, F.lit(8)).cast("int")))
    folder = f"{shared_folder(h.spark)}/feeds/{uuid.uuid4().hex}"
    for number in range(9):
        part = laid.filter(F.col("file") == number).drop("file").orderBy(F.xxhash64("event_id"))
        part.coalesce(1).write.mode("append").parquet(folder)
    feed = runs.parquet_stream(h.spark, folder, attempts.schema, names="*.parquet", files_per_batch=1)
    feed, tick = runs.with_last_tick(feed, "ts", "2100-01-01 00:00:00")
    return runs.run_to_parquet(lockout.lockout_stream(feed, lateness="5 days", buckets=256), then=tick).filter("user_id is not null")


@query("t1c_login_lockout_slices", _LOCKOUT)
def t1c(h: Hospital) -> DataFrame:
    """Every account of more than three attempts cut into time slices, as those with very many are."""
    return lockout.lockouts(lockout.login_attempts(h.events), split_over=3)


_SESSIONS = f"""
    with marked as (select user_id, ts, case when lag(ts) over w is null or ts - lag(ts) over w >= interval 60 minute then 1 else 0 end as s
                    from {{events}} window w as (partition by user_id order by ts, event_id)),
         numbered as (select *, sum(s) over (partition by user_id order by ts rows unbounded preceding) as session_no from marked)
    select user_id, cast(session_no as bigint) as session_no, {t('min(ts)', 'started_at')}, {t('max(ts)', 'last_activity')}, count(*) as events
    from numbered group by user_id, session_no"""


@query("t2_activity_sessions", _SESSIONS)
def t2(h: Hospital) -> DataFrame:
    return sessions.activity_sessions(h.events)


@query(
    "t2b_activity_session_stream",
    f"""select user_id, {t('min(ts)', 'started_at')}, {t('max(ts)', 'last_activity')}, count(*) as events
        from (select user_id, ts, sum(s) over (partition by user_id order by ts rows unbounded preceding) as n from (
                select *, case when ts - lag(ts) over (partition by user_id order by ts, event_id) < interval 60 minute then 0 else 1 end as s
                from {{events}}) x) y
        group by user_id, n
        having max(ts) + interval 60 minute - interval 1 microsecond <= (select max(ts) from {{events}}) - interval 1 hour""",
)
def t2b(h: Hospital) -> DataFrame:
    """The sessions that a stream over the events has closed by its watermark."""
    return runs.run_to_parquet(sessions.activity_session_stream(_event_stream(h)))


@query(
    "t3_fixed_sessions",
    f"""select cast(event_id as varchar) as session_id, user_id, {t('ts', 'created_at')}, {t('ts + interval 30 minute', 'expires_at')},
               ts + interval 30 minute > timestamp '2024-01-15 12:00:00' as is_active
        from {{events}} where event_type = 'signup'""",
)
def t3(h: Hospital) -> DataFrame:
    opened = h.events.filter(F.col("event_type") == "signup").select(
        F.col("event_id").cast("string").alias("session_id"), "user_id", F.col("ts").alias("created_at")
    )
    return sessions.fixed_sessions(opened, as_of="2024-01-15 12:00:00")


_LIVE = f"""select {d('ts', 'day')}, {m("cast(sum(cast(value as decimal(12,2))) as decimal(18,2))", 'revenue')}, count(*) as payments
            from {{events}} where event_type = 'purchase' group by cast(ts as date)"""


def _receipts(events: DataFrame) -> DataFrame:
    return events.filter(F.col("event_type") == "purchase").select(
        F.col("ts").alias("payment_date"), F.col("value").cast("decimal(12,2)").alias("amount_paid")
    )


@query("t4_daily_revenue", _LIVE)
def t4(h: Hospital) -> DataFrame:
    return live.live_revenue(_receipts(h.events)).select("day", "revenue", "payments")


@query("t4b_daily_revenue_stream", _LIVE)
def t4b(h: Hospital) -> DataFrame:
    stream = live.live_revenue(_receipts(_event_stream(h)))
    return runs.run_latest(stream, "day").select("day", "revenue", "payments")


_HELD_BACK = "event_id % 50 = 0 and cast(ts as date) < date '2024-01-11'"


@query(
    "t4e_revenue_with_late_rows",
    f"""select {d('ts', 'day')}, coalesce(cast(cast(sum(cast(value as decimal(12,2))) filter (not ({_HELD_BACK})) as decimal(18,2)) as double), 0) as revenue,
               count(*) filter (not ({_HELD_BACK})) as payments, count(*) filter ({_HELD_BACK}) as late
        from {{events}} where event_type = 'purchase' group by cast(ts as date)""",
)
def t4e(h: Hospital) -> DataFrame:
    """Payments by ten days a file; one in fifty of the first ten days comes with the last file, weeks late."""
    sold = h.events.filter(F.col("event_type") == "purchase").withColumn("held", F.expr(_HELD_BACK))
    file = F.when(F.col("held"), 2).otherwise(F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)))
    laid = cut(sold.withColumn("file", file))
    receipts = _receipts(laid)
    base = f"{shared_folder(h.spark)}/late/{uuid.uuid4().hex}"
    for number in range(3):
        _receipts(laid.filter(F.col("file") == number)).coalesce(1).write.mode("append").parquet(f"{base}/feed")
    split = live.revenue_with_late(base, late="2 days")
    split.run(runs.parquet_stream(h.spark, f"{base}/feed", receipts.schema, names="*.parquet", files_per_batch=1))
    late = split.too_late(h.spark).groupBy(F.to_date("payment_date").alias("day")).agg(F.count("*").alias("late"))
    both = split.totals(h.spark).join(late, "day", "full")
    return both.select("day", *(F.coalesce(c, F.lit(0)).alias(c) for c in ("revenue", "payments", "late")))


@query(
    "t4c_daily_appointments",
    f"""select {d('appt_date', 'day')}, count(*) as total, count(*) filter (status = 'Completed') as completed,
               count(*) filter (status = 'Cancelled') as cancelled, count(*) filter (status in ('Pending', 'Confirmed')) as pending
        from {{appointments}} group by appt_date""",
)
def t4c(h: Hospital) -> DataFrame:
    figures = live.live_appointments(h.appointments)
    return figures.select("day", "total", "completed", "cancelled", "pending")


@query(
    "t4d_daily_appointments_stream",
    f"""select {d('appt_date', 'day')}, count(*) as total, count(*) filter (status = 'Completed') as completed
        from {{appointments}} group by appt_date""",
)
def t4d(h: Hospital) -> DataFrame:
    """The live query over appointments that arrive as files, several micro-batches of them."""
    feed = h.appointments.repartition(3, "appt_id")
    stream = runs.parquet_stream(h.spark, written(feed), feed.schema, names="*.parquet", files_per_batch=1)
    return runs.run_latest(live.live_appointments(stream, late="4000 days"), "day").select("day", "total", "completed")


@query(
    "t5_alerts",
    """select medicine_id as subject_id, 'LOW STOCK ALERT: ' || brand_name || ' has only ' || stock_left || ' units left' as message
       from {stock_after} where touched and stock_left < reorder_level
       union all
       select order_id, 'Result marked ABNORMAL' from {lab_orders} where is_abnormal and result_value is not null""",
)
def t5(h: Hospital) -> DataFrame:
    """Both alert filters over streams: the medicines after a dispense run, and the lab orders."""
    after = pharmacy.changed_medicines(h.medicines, pharmacy.dispense(h, h.dispense_requests).medicines)

    def stream(table: DataFrame) -> DataFrame:
        return runs.parquet_stream(h.spark, written(table), table.schema, names="*.parquet")

    low = pharmacy.low_stock_alerts(stream(after)).select(F.col("medicine_id").alias("subject_id"), "message")
    odd = clinical.abnormal_alerts(stream(h.lab_orders)).select(F.col("order_id").alias("subject_id"), "message")
    return runs.run_to_parquet(low).unionByName(runs.run_to_parquet(odd))


def _in_batches(h: Hospital, folder: str, feed: DataFrame, batches: int = 4) -> DataFrame:
    """The files of a feed as a stream of about so many micro-batches, each with as many tasks as its files and splits give."""
    files = len(h.spark.read.schema(feed.schema).parquet(folder).inputFiles())
    return runs.parquet_stream(h.spark, folder, feed.schema, names="*.parquet", files_per_batch=-(-files // batches))


@query(
    "t6_audit_stream",
    f"""select table_name, operation, 2 * count(*) as entries, 2 * count(*) as numbers from ({_CHANGES}) c group by table_name, operation""",
)
def t6(h: Hospital) -> DataFrame:
    """A change feed streamed into the append-only log in several micro-batches; every change occurs twice."""
    once = _changes(h).drop("changed_by", "changed_at")
    numbered = with_sequence(once, [up("table_name"), up("record_id")], "change_id").withColumn("change_id", 2 * F.col("change_id"))
    feed = numbered.withColumn("change_id", F.col("change_id") - 1).unionByName(numbered)
    stream = _in_batches(h, written(feed), feed)
    log = runs.run_to_parquet(runs.audit_stream(stream, as_of=AS_OF))
    return log.groupBy("table_name", "operation").agg(
        F.count("*").alias("entries"), F.countDistinct("log_id").alias("numbers")
    )


@query(
    "t6b_audit_stream_redelivered",
    f"""select table_name, operation, count(*) as entries, count(*) as numbers from ({_CHANGES}) c group by table_name, operation""",
)
def t6b(h: Hospital) -> DataFrame:
    """A feed that delivers half its changes twice, and after a restart a third of them once more: one entry each."""
    when = F.timestamp_add("HOUR", (F.col("record_id") % 40).cast("int"), F.lit(f"{AS_OF} 08:00:00").cast("timestamp_ntz"))
    changes = _changes(h).drop("changed_by").withColumn("changed_at", when)
    feed = with_sequence(changes, [up("table_name"), up("record_id")], "change_id")
    folder = written(feed.unionByName(feed.filter("change_id % 2 = 0")))
    base = f"{shared_folder(h.spark)}/logs/{uuid.uuid4().hex}"

    def run() -> None:
        stream = _in_batches(h, folder, feed)
        runs.run_to_audit_log(runs.audit_stream(stream, lateness="3 days"), f"{base}/log", checkpoint=f"{base}/state")

    run()
    feed.filter("change_id % 3 = 0").write.mode("append").parquet(folder)
    run()
    log = read_audit(h.spark, f"{base}/log")
    return log.groupBy("table_name", "operation").agg(F.count("*").alias("entries"), F.countDistinct("log_id").alias("numbers"))
