"""Registered sources, reports, trends, dashboards and worklists."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from wardline.catalog.oracle import d, m, t
from wardline.catalog.registry import AS_OF, query
from wardline.operators import dashboards, reports, search, trends, worklists
from wardline.sources.sql import create_views
from wardline.sources.sinks import append_audit, read_audit, write_snapshot
from wardline.sources.partitions import store_parts, with_parts
from wardline.sources.staging import cut, shared_folder
from wardline.sources.tables import Hospital, conform, open_hospital, select_one, select_rows, shown

from wardline.schema import KEYS, TABLES

DAY = f"date '{AS_OF}'"


def stored_by_month(h: Hospital) -> Hospital:
    path = f"{shared_folder(h.spark)}/by_month/{uuid.uuid4().hex}"
    store_parts(conform(h.appointments, "appointments"), path, "appointments")
    return with_parts(h, "appointments", path)


# Sources and sinks --------------------------------------------------------------------------------


@query(
    "io1_table_scan",
    f"select appt_id, patient_id, doctor_id, {d('appt_date')}, appt_time, appt_type, status, notes from {{appointments}} where appt_date >= date '1998-06-01' and appt_date < date '1998-09-01'",
)
def io1(h: Hospital) -> DataFrame:
    root = f"{shared_folder(h.spark)}/snapshots"
    path = write_snapshot(conform(h.appointments, "appointments"), root, "appointments", uuid.uuid4().hex)
    schema = StructType([*TABLES["appointments"].fields, StructField("appt_month", StringType())])
    months = F.col("appt_month").isin("1998-06", "1998-07", "1998-08")
    columns = ["appt_id", "patient_id", "doctor_id", "appt_date", "appt_time", "appt_type", "status", "notes"]
    return h.spark.read.schema(schema).parquet(path).filter(months).select(*columns)


_STORED = ("departments", "doctors", "insurance", "patients", "appointments", "medicines", "diagnoses", "prescriptions",
           "lab_tests", "lab_orders", "users", "roles", "bills", "bill_items", "payments")


@query(
    "io1b_open_hospital",
    " union all ".join(
        f"select '{t}' as table_name, count(*) as n_rows, cast(sum({KEYS[t]}) as bigint) as keys from {{{t}}}" for t in _STORED
    ),
)
def io1b(h: Hospital) -> DataFrame:
    """Every table stored and opened again by its declared schema, whole."""
    root = f"{shared_folder(h.spark)}/stored/{uuid.uuid4().hex}"
    for name in _STORED:
        conform(h.table(name), name).write.parquet(f"{root}/{name}")
    again = open_hospital(h.spark, root)
    counts = [
        again.table(t).agg(F.count("*").alias("n_rows"), F.sum(KEYS[t]).cast("long").alias("keys")).select(F.lit(t).alias("table_name"), "n_rows", "keys")
        for t in _STORED
    ]
    return reduce(DataFrame.unionByName, counts)


@query(
    "io2_parameterised_select",
    "select status, count(*) as appointments from {appointments} where appt_date >= date '1998-01-01' and appt_type = 'OPD' group by status",
)
def io2(h: Hospital) -> DataFrame:
    text = """select status, count(*) as appointments from {appointments}
              where appt_date >= :first and appt_type = :kind group by status"""
    return select_rows(h, text, ["appointments"], first=AS_OF.replace(month=1, day=1), kind="OPD")


@query(
    "io3_first_row",
    f"select appt_id, {d('appt_date')} from {{appointments}} where status = 'Completed' order by appointments.appt_date desc, appt_id desc limit 1",
)
def io3(h: Hospital) -> DataFrame:
    text = "select appt_id, appt_date from {appointments} where status = :s order by appt_date desc, appt_id desc"
    return select_one(h, text, ["appointments"], s="Completed")


@query(
    "io4_seeded_tests",
    f"select test_id, test_name, category, {m('price')}, count(o.order_id) as orders from {{lab_tests}} left join {{lab_orders}} o using (test_id) group by test_id, test_name, category, lab_tests.price",
)
def io4(h: Hospital) -> DataFrame:
    per_test = h.lab_orders.groupBy("test_id").agg(F.count("*").alias("orders"))
    tests = h.lab_tests.select("test_id", "test_name", "category", "price")
    return tests.join(per_test, "test_id", "left").fillna(0, ["orders"])


@query("io5_shown_columns", "select patient_id as \"Id\", full_name as \"Patient\", phone as \"Phone\" from {patients}")
def io5(h: Hospital) -> DataFrame:
    return shown(h.patients, {"patient_id": "Id", "full_name": "Patient", "fax": "Fax", "phone": "Phone"})


@query(
    "io6_audit_sink",
    """select 'bills' as table_name, 'UPDATE' as operation, count(*) as entries from {bills} where status <> 'Unpaid' having count(*) > 0""",
)
def io6(h: Hospital) -> DataFrame:
    from wardline.operators.audit import row_changes

    log = row_changes("bills", h.new_bills, h.bills, as_of=AS_OF).withColumn("log_id", F.col("record_id"))
    path = f"{shared_folder(h.spark)}/audit/{uuid.uuid4().hex}"
    append_audit(conform(log, "audit_log"), path)
    return read_audit(h.spark, path).groupBy("table_name", "operation").agg(F.count("*").alias("entries"))


@query(
    "io6b_audit_sink_once",
    f"""select {d('changed_at', 'changed_on')}, count(*) as entries, count(*) as numbers from (
            select timestamp '1998-06-15 00:00:00' + to_hours(cast(bill_id % 100 as int)) as changed_at from {{bills}} where status <> 'Unpaid') b
        group by cast(changed_at as date)""",
)
def io6b(h: Hospital) -> DataFrame:
    """A log that gets every change in two deliveries and a part of them in a third."""
    from wardline.operators.audit import row_changes

    when = F.timestamp_add("HOUR", (F.col("record_id") % 100).cast("int"), F.lit("1998-06-15 00:00:00").cast("timestamp_ntz"))
    log = row_changes("bills", h.new_bills, h.bills, as_of=AS_OF).withColumns({"log_id": F.col("record_id"), "changed_at": when})
    entries, path = cut(conform(log, "audit_log")), f"{shared_folder(h.spark)}/audit/{uuid.uuid4().hex}"
    for delivery in (entries.filter("log_id % 3 = 0"), entries, entries.unionByName(entries.limit(10))):
        append_audit(delivery, path, once=True)
    return read_audit(h.spark, path).groupBy(F.col("changed_on").cast("string").alias("changed_on")).agg(
        F.count("*").alias("entries"), F.countDistinct("log_id").alias("numbers")
    )


@query(
    "q06b_slots_by_month",
    f"""select s.request_id, s.doctor_id, {d('s.appt_date')}, s.appt_time,
               not exists (select 1 from {{appointments}} a where a.doctor_id = s.doctor_id and a.appt_date = s.appt_date
                           and a.appt_time = s.appt_time and a.status <> 'Cancelled') as available
        from {{slot_requests}} s where s.appt_date between date '1996-05-20' and date '1996-07-10'""",
)
def q06b(h: Hospital) -> DataFrame:
    """The slots of seven weeks against appointments stored by month: the scan reads three months."""
    asked = h.slot_requests.filter(F.col("appt_date").between("1996-05-20", "1996-07-10"))
    return reports.slot_availability(stored_by_month(h), asked)


# Reports and per-key functions --------------------------------------------------------------------


@query(
    "q01_patient_history",
    f"""with finding as (select appt_id, description as diagnosis, severity from {{diagnoses}}),
             staff as (select doctor_id, full_name as doctor from {{doctors}})
        select patient_id, full_name, {d('appt_date')}, appt_type, doctor, diagnosis, severity, visit.status
        from {{appointments}} visit join (select patient_id, full_name from {{patients}}) person using (patient_id)
        join staff using (doctor_id) left join finding using (appt_id)""",
)
def q01(h: Hospital) -> DataFrame:
    return reports.patient_history(h)


@query(
    "q02_opd_queue",
    f"""with staff as (select doctor_id, full_name as doctor, dept_name from {{doctors}} join {{departments}} using (dept_id))
        select appt_id, person.full_name as patient, doctor, dept_name, appt_time, appt_type, visit.status
        from {{appointments}} visit join {{patients}} person using (patient_id) join staff using (doctor_id)
        where appt_date between {DAY} and {DAY}""",
)
def q02(h: Hospital) -> DataFrame:
    return reports.opd_queue(h, as_of=AS_OF)


@query(
    "q03_billing_summary",
    f"""select b.bill_id, p.full_name as patient, {m('b.total_amount')}, {m('b.insurance_covered')}, {m('b.net_payable')}, b.status,
               {t('b.bill_date')}, {m('coalesce(r.paid, 0)', 'amount_received')}, {m('b.net_payable - coalesce(r.paid, 0)', 'outstanding')}
        from {{bills}} b join {{patients}} p on b.patient_id = p.patient_id left join {{received}} r on r.bill_id = b.bill_id""",
)
def q03(h: Hospital) -> DataFrame:
    return reports.billing_summary(h)


@query(
    "q04_low_stock",
    """select medicine_id, brand_name, category, stock_quantity, reorder_level, reorder_level - stock_quantity as shortage
       from {medicines} where stock_quantity <= reorder_level""",
)
def q04(h: Hospital) -> DataFrame:
    return reports.low_stock(h)


@query(
    "q05_patient_age",
    f"select patient_id, cast(date_part('year', age({DAY}, date_of_birth)) as int) as age, cast(({DAY} - date_of_birth) // 365 as int) as card_age from {{patients}}",
)
def q05(h: Hospital) -> DataFrame:
    return reports.patient_age(h, as_of=AS_OF)


@query(
    "q06_slot_available",
    f"""select s.request_id, s.doctor_id, {d('s.appt_date')}, s.appt_time,
               not exists (select 1 from {{appointments}} a where a.doctor_id = s.doctor_id and a.appt_date = s.appt_date
                           and a.appt_time = s.appt_time and a.status <> 'Cancelled') as available
        from {{slot_requests}} s""",
)
def q06(h: Hospital) -> DataFrame:
    return reports.slot_availability(h, h.slot_requests)


@query("q07_deduction", f"select bill_id, {m('net_payable', 'deduction')} from {{bills}}")
def q07(h: Hospital) -> DataFrame:
    return reports.deductions(h)


@query("q08_patient_active", "select patient_id, status = 'Active' as is_active from {patients}")
def q08(h: Hospital) -> DataFrame:
    return reports.patient_active(h)


@query(
    "q05b_functions_in_sql",
    f"""select a.appt_id, cast(date_part('year', age({DAY}, p.date_of_birth)) as int) as age, p.status = 'Active' as is_active,
               not exists (select 1 from {{appointments}} o where o.doctor_id = a.doctor_id and o.appt_date = a.appt_date
                           and o.appt_time = a.appt_time and o.status <> 'Cancelled') as slot_free
        from {{appointments}} a join {{patients}} p using (patient_id)""",
)
def q05b(h: Hospital) -> DataFrame:
    create_views(h, as_of=AS_OF)
    return h.spark.sql(
        f"""select appt_id, get_patient_age(patient_id, {DAY}) as age, is_patient_active(patient_id) as is_active,
                   is_slot_available(doctor_id, appt_date, appt_time) as slot_free
            from appointments"""
    )


@query(
    "q07b_views_in_sql",
    f"""select b.status, count(*) as bills, {m('sum(b.net_payable - coalesce(r.paid, 0))', 'outstanding')}, {m('sum(b.net_payable)', 'deduction')}
        from {{bills}} b left join {{received}} r on r.bill_id = b.bill_id group by b.status""",
)
def q07b(h: Hospital) -> DataFrame:
    create_views(h, as_of=AS_OF)
    return h.spark.sql(
        """select status, count(*) as bills, cast(sum(outstanding) as decimal(18,2)) as outstanding,
                  cast(sum(calculate_deduction(bill_id)) as decimal(18,2)) as deduction
           from vw_billing_summary group by status"""
    )


# Trends -------------------------------------------------------------------------------------------


@query(
    "q09_appointments_per_day",
    f"""select {d('appt_date', 'day')}, count(*) as total, count(*) filter (status = 'Completed') as completed,
               count(*) filter (status = 'Cancelled') as cancelled, count(*) filter (status in ('Pending', 'Confirmed')) as pending
        from {{appointments}} where appt_date >= {DAY} - 6 group by appt_date""",
)
def q09(h: Hospital) -> DataFrame:
    return trends.appointments_per_day(h, as_of=AS_OF)


@query(
    "q10_revenue_per_day",
    f"""select {d('payment_date', 'day')}, {m('sum(amount_paid)', 'revenue')} from {{payments}}
        where payment_date >= {DAY} - 29 group by cast(payment_date as date)""",
)
def q10(h: Hospital) -> DataFrame:
    return trends.revenue_per_day(h, as_of=AS_OF)


@query(
    "q11_lowest_stock",
    """select medicine_id, brand_name, stock_quantity, reorder_level,
              case when stock_quantity = 0 then 'out' when stock_quantity <= reorder_level then 'low' else 'ok' end as band
       from {medicines} order by stock_quantity, medicine_id limit 10""",
)
def q11(h: Hospital) -> DataFrame:
    return trends.lowest_stock(h)


@query(
    "q12_daily_activity",
    f"""select {d('coalesce(p.day, a.day)', 'day')}, coalesce(p.n, 0) as new_patients, coalesce(a.n, 0) as appointments
        from (select registration_date as day, count(*) as n from {{patients}} where registration_date >= {DAY} - 13 group by 1) p
        full join (select appt_date as day, count(*) as n from {{appointments}} where appt_date >= {DAY} - 13 group by 1) a
          on p.day = a.day""",
)
def q12(h: Hospital) -> DataFrame:
    return trends.daily_activity(h, as_of=AS_OF)


@query(
    "q13_appointments_per_department",
    """with staff as (select doctor_id, dept_name from {doctors} join {departments} using (dept_id))
       select dept_name, count(*) as appointments from staff join {appointments} using (doctor_id)
       where strftime(appt_date, '%Y-%m') = '1998-06' group by dept_name""",
)
def q13(h: Hospital) -> DataFrame:
    return trends.appointments_per_department(h, as_of=AS_OF)


@query(
    "q14_bills_per_status",
    f"select status, count(*) as bills, {m('sum(net_payable)', 'total_value')} from {{bills}} group by status",
)
def q14(h: Hospital) -> DataFrame:
    return trends.bills_per_status(h)


# Dashboards ---------------------------------------------------------------------------------------

_REVENUE = f"(select coalesce(sum(amount_paid), 0) from {{payments}} where cast(payment_date as date) = {DAY})"


@query(
    "q15_admin_dashboard",
    f"""select (select count(*) from {{patients}}) as patients,
               (select count(*) from {{doctors}} where status = 'Active') as active_doctors,
               (select count(*) from {{appointments}} where appt_date = {DAY}) as appointments_today,
               {m(_REVENUE, 'revenue_today')},
               (select count(*) from {{medicines}} where stock_quantity <= reorder_level) as low_stock""",
)
def q15(h: Hospital) -> DataFrame:
    return dashboards.admin_figures(h, as_of=AS_OF)


@query(
    "q16_admin_alerts",
    """select * from (
         select 'Low Stock Medicines' as alert, count(*) as n from {medicines} where stock_quantity <= reorder_level
         union all select 'Pending Lab Orders', count(*) from {lab_orders} where status = 'Pending'
         union all select 'Unpaid Bills', count(*) from {bills} where status <> 'Paid') x where n > 0""",
)
def q16(h: Hospital) -> DataFrame:
    return dashboards.admin_alerts(h)


@query(
    "q17_billing_dashboard",
    f"""select {m(_REVENUE, 'revenue_today')},
               {m('(select coalesce(sum(b.net_payable - coalesce(r.paid, 0)), 0) from {bills} b left join {received} r on r.bill_id = b.bill_id where b.status <> $$Paid$$)', 'outstanding')},
               (select count(*) from {{bills}} where status <> 'Paid') as pending_bills""",
)
def q17(h: Hospital) -> DataFrame:
    return dashboards.billing_figures(h, as_of=AS_OF)


@query(
    "q18_doctor_day",
    f"""select doctor_id, count(*) as total, count(*) filter (status = 'Completed') as completed,
               count(*) filter (status in ('Pending', 'Confirmed')) as pending
        from {{appointments}} where appt_date = {DAY} group by doctor_id""",
)
def q18(h: Hospital) -> DataFrame:
    return dashboards.doctor_day(h, as_of=AS_OF)


@query(
    "q19_reception_dashboard",
    f"""select (select count(*) from {{patients}}) as patients,
               (select count(*) from {{appointments}} where appt_date = {DAY}) as appointments_today,
               (select count(*) from {{appointments}} where appt_date = {DAY} and status = 'Pending') as pending_today""",
)
def q19(h: Hospital) -> DataFrame:
    return dashboards.reception_figures(h, as_of=AS_OF)


@query(
    "q20_lab_dashboard",
    f"""select count(*) filter (status = 'Pending') as pending,
               count(*) filter (status = 'Done' and cast(result_date as date) = {DAY}) as done_today,
               count(*) filter (is_abnormal and cast(result_date as date) = {DAY}) as abnormal_today from {{lab_orders}}""",
)
def q20(h: Hospital) -> DataFrame:
    return dashboards.lab_figures(h, as_of=AS_OF)


@query(
    "q21_pharmacy_dashboard",
    """select count(*) as medicines, count(*) filter (stock_quantity <= reorder_level) as low_stock,
              count(*) filter (stock_quantity = 0) as out_of_stock from {medicines}""",
)
def q21(h: Hospital) -> DataFrame:
    return dashboards.pharmacy_figures(h)


# Worklists ----------------------------------------------------------------------------------------

_OPEN = "('Pending', 'Confirmed')"


@query(
    "q22_schedule_today",
    f"""select a.appt_id, p.full_name as patient, d.full_name as doctor, a.appt_time, a.appt_type, a.status
        from {{appointments}} a join {{patients}} p using (patient_id) join {{doctors}} d using (doctor_id)
        where a.appt_date = {DAY} order by a.appt_time, a.appt_id limit 8""",
)
def q22(h: Hospital) -> DataFrame:
    return worklists.schedule_today(h, as_of=AS_OF)


@query(
    "q23_recent_payments",
    f"""select pay.payment_id, p.full_name as patient, {m('pay.amount_paid')}, pay.payment_mode, {t('pay.payment_date')}
        from {{payments}} pay join {{bills}} b using (bill_id) join {{patients}} p using (patient_id)
        order by pay.payment_date desc, pay.payment_id desc limit 8""",
)
def q23(h: Hospital) -> DataFrame:
    return worklists.recent_payments(h, n=8)


@query(
    "q24_recent_bills",
    f"""select b.bill_id, p.full_name as patient, {m('b.net_payable')}, b.status, {t('b.bill_date')}
        from {{bills}} b join {{patients}} p using (patient_id) order by b.bill_date desc, b.bill_id desc limit 5""",
)
def q24(h: Hospital) -> DataFrame:
    return worklists.recent_bills(h)


def _ranked(source: str, key: str, order: str, n: int, columns: str) -> str:
    return f"select {columns} from (select x.*, row_number() over (partition by {key} order by {order}) as rnk from ({source}) x) r where rnk <= {n}"


@query(
    "q25_upcoming_per_doctor",
    _ranked(
        f"""select a.*, p.full_name as patient from {{appointments}} a join {{patients}} p using (patient_id)
            where a.appt_date >= {DAY} and a.status in {_OPEN}""",
        "doctor_id", "appt_date, appt_time, appt_id", 5,
        "doctor_id, cast(rnk as int) as rank, appt_id, strftime(appt_date, '%d-%b-%Y') as appt_day, substr(appt_time, 1, 5) as appt_hour, patient, status",
    ),
)
def q25(h: Hospital) -> DataFrame:
    return worklists.upcoming_per_doctor(h, as_of=AS_OF)


_ON_DAY = f"""select a.appt_id, p.full_name as patient, p.phone, p.blood_group, d.full_name as doctor, dept.dept_name as dept,
        {d('a.appt_date')}, a.appt_time, a.appt_type, a.status
    from {{appointments}} a join {{patients}} p using (patient_id) join {{doctors}} d using (doctor_id)
    join {{departments}} dept using (dept_id) where a.appt_date = {DAY}"""


@query("q26a_management_day", f"{_ON_DAY} and a.status <> 'Cancelled'")
def q26a(h: Hospital) -> DataFrame:
    return worklists.appointments_on(h, on=AS_OF, hide_cancelled=True)


@query("q26b_queue_by_department", f"{_ON_DAY} and a.status = 'Pending' and dept.dept_name = 'NATION_3'")
def q26b(h: Hospital) -> DataFrame:
    return worklists.appointments_on(h, on=AS_OF, status="Pending", department="NATION_3")


@query("q26c_doctor_day_list", f"{_ON_DAY} and a.doctor_id = 97")
def q26c(h: Hospital) -> DataFrame:
    return worklists.appointments_on(h, on=AS_OF, doctor_id=97)


@query(
    "q27_awaiting_diagnosis",
    _ranked(
        """select a.*, p.full_name from {appointments} a anti join {diagnoses} g on g.appt_id = a.appt_id
           join {patients} p using (patient_id) where a.status = 'Completed'""",
        "doctor_id", "appt_date desc, appt_id desc", 20,
        f"doctor_id, cast(rnk as int) as rank, appt_id, full_name, {d('appt_date')}",
    ),
)
def q27(h: Hospital) -> DataFrame:
    return worklists.awaiting_diagnosis(h)


_NO_RX = _ranked(
    """select a.doctor_id, di.diag_id, p.full_name, di.icd_code from {diagnoses} di join {appointments} a using (appt_id)
       join {patients} p using (patient_id) where di.diag_id not in (select diag_id from {prescriptions})""",
    "doctor_id", "diag_id desc", 20, "doctor_id, cast(rnk as int) as rank, diag_id, full_name, icd_code",
)


@query("q28_awaiting_prescription", _NO_RX)
def q28(h: Hospital) -> DataFrame:
    return worklists.awaiting_prescription(h)


@query(
    "q28b_awaiting_prescription_null_aware",
    _NO_RX.replace("(select diag_id from {prescriptions})", "(select case when rx_id % 7 <> 0 then diag_id end from {prescriptions})"),
)
def q28b(h: Hospital) -> DataFrame:
    """Some prescriptions have no diagnosis: by the null-aware rule none then counts as awaiting."""
    loose = h.prescriptions.withColumn("diag_id", F.when(F.col("rx_id") % 7 != 0, F.col("diag_id")))
    return worklists.awaiting_prescription(h.replaced(prescriptions=loose), null_aware=True)


@query(
    "q29_awaiting_lab_order",
    _ranked(
        """select a.*, p.full_name from {appointments} a join {patients} p using (patient_id)
           where a.status in ('Confirmed', 'Completed') and not exists (select 1 from {lab_orders} lo where lo.appt_id = a.appt_id)""",
        "doctor_id", "appt_date desc, appt_id desc", 20,
        f"doctor_id, cast(rnk as int) as rank, appt_id, full_name, {d('appt_date')}",
    ),
)
def q29(h: Hospital) -> DataFrame:
    return worklists.awaiting_lab_order(h)


@query(
    "q30_awaiting_bill",
    f"""select a.appt_id, p.full_name, p.phone, {d('a.appt_date')}, d.full_name as doctor, {m('d.opd_fee')}
        from {{appointments}} a anti join {{bills}} b on b.appt_id = a.appt_id
        join {{patients}} p using (patient_id) join {{doctors}} d using (doctor_id) where a.status = 'Completed'""",
)
def q30(h: Hospital) -> DataFrame:
    return worklists.awaiting_bill(h)


@query(
    "q31a_invoice_headers",
    f"""select b.bill_id, p.full_name as patient, coalesce(d.full_name, 'N/A') as doctor, b.appt_id, {d('a.appt_date')}, a.appt_time,
               {t('b.bill_date')}, {m('b.total_amount')}, {m('b.insurance_covered')}, {m('b.net_payable')},
               {m('coalesce(r.paid, 0)', 'total_paid')}, {m('greatest(0, b.net_payable - coalesce(r.paid, 0))', 'outstanding')}, b.status
        from {{bills}} b join {{patients}} p using (patient_id) left join {{appointments}} a on a.appt_id = b.appt_id
        left join {{doctors}} d on d.doctor_id = a.doctor_id left join {{received}} r on r.bill_id = b.bill_id""",
)
def q31a(h: Hospital) -> DataFrame:
    return worklists.invoice_headers(h)


@query(
    "q31b_invoice_lines",
    f"""select bill_id, '1-charge' as section, cast(null as varchar) as line_ts, item_id as line_id,
               service_type || ': ' || description as label, quantity, {m('unit_price')}, {m('total', 'amount')} from {{bill_items}}
        union all
        select bill_id, '2-payment', {t('payment_date')}, payment_id, payment_mode, null, null, {m('amount_paid')} from {{payments}}""",
)
def q31b(h: Hospital) -> DataFrame:
    return worklists.invoice_lines(h)


@query(
    "q32_charge_preview",
    f"""select appt_id, {m("sum(case when service_type = 'Consultation' then total else 0 end)", 'consultation')},
               {m("sum(case when service_type = 'Lab' then total else 0 end)", 'lab')},
               {m("sum(case when service_type = 'Pharmacy' then total else 0 end)", 'pharmacy')}, {m('sum(total)', 'total')}
        from {{charges}} join {{appointments}} a using (appt_id)
        where a.status = 'Completed' and appt_id not in (select appt_id from {{bills}}) group by appt_id""",
)
def q32(h: Hospital) -> DataFrame:
    return worklists.charge_preview(h)


@query(
    "q33_open_bills",
    f"""select b.bill_id, p.full_name as patient, p.phone, {m('b.total_amount')}, {m('b.insurance_covered')}, {m('b.net_payable')},
               b.status, {d('b.due_date')}, {m('coalesce(r.paid, 0)', 'paid_so_far')}, {m('b.net_payable - coalesce(r.paid, 0)', 'outstanding')}
        from {{bills}} b join {{patients}} p using (patient_id) left join {{received}} r on r.bill_id = b.bill_id
        where b.status <> 'Paid'""",
)
def q33(h: Hospital) -> DataFrame:
    return worklists.open_bills(h)


@query(
    "q34_bill_history",
    f"""select b.bill_id, p.full_name, {t('b.bill_date')}, {m('b.total_amount')}, {m('b.insurance_covered')}, {m('b.net_payable')}, b.status
        from {{bills}} b join {{patients}} p using (patient_id) where lower(p.full_name) like '%mer#0000%7%' and b.status = 'Partial'""",
)
def q34(h: Hospital) -> DataFrame:
    return worklists.bill_history(h, name_like="MER#0000%7", status="Partial")


@query(
    "q35a_bill_items",
    f"select bill_id, item_id, service_type, description, quantity, {m('unit_price')}, {m('total')} from {{bill_items}}",
)
def q35a(h: Hospital) -> DataFrame:
    return worklists.bill_items(h)


@query(
    "q35b_payment_history",
    f"select bill_id, payment_id, {m('amount_paid')}, payment_mode, {t('payment_date')} from {{payments}}",
)
def q35b(h: Hospital) -> DataFrame:
    return worklists.payment_history(h)


@query(
    "q35c_bill_balance",
    f"""select b.bill_id, {m('b.net_payable')}, {m('coalesce((select sum(amount_paid) from {payments} x where x.bill_id = b.bill_id), 0)', 'paid')},
               {m('b.net_payable - coalesce((select sum(amount_paid) from {payments} x where x.bill_id = b.bill_id), 0)', 'outstanding')}
        from {{bills}} b""",
)
def q35c(h: Hospital) -> DataFrame:
    return worklists.bill_balances(h)


@query(
    "q36_dispense_queue",
    f"""select pr.rx_id, p.full_name as patient, med.brand_name, med.generic_name, {m('med.unit_price')}, pr.dosage, pr.frequency,
               pr.duration_days, pr.instructions, med.stock_quantity, med.medicine_id,
               case when med.stock_quantity = 0 then 'out of stock' when med.stock_quantity < pr.duration_days then 'short' else 'ok' end as shortfall
        from {{prescriptions}} pr join {{diagnoses}} di using (diag_id) join {{appointments}} a using (appt_id)
        join {{patients}} p using (patient_id) join {{medicines}} med on med.medicine_id = pr.medicine_id
        where not pr.is_dispensed order by pr.prescribed_at desc, pr.rx_id desc limit 30""",
)
def q36(h: Hospital) -> DataFrame:
    return worklists.dispense_queue(h)


@query(
    "q37_low_stock_short_list",
    """select medicine_id, brand_name, stock_quantity, reorder_level from {medicines} where stock_quantity <= reorder_level
       order by stock_quantity, medicine_id limit 10""",
)
def q37(h: Hospital) -> DataFrame:
    return worklists.low_stock_short_list(h)


@query(
    "q38_low_stock_detail",
    f"""select medicine_id, brand_name, generic_name, category, stock_quantity, reorder_level,
               reorder_level - stock_quantity as units_short, {d('expiry_date')} from {{medicines}} where stock_quantity <= reorder_level""",
)
def q38(h: Hospital) -> DataFrame:
    return worklists.low_stock_detail(h)


_BAND = "case when stock_quantity = 0 then 'out' when stock_quantity <= reorder_level then 'low' else 'ok' end as band"
_STOCK = f"select medicine_id, brand_name, generic_name, category, stock_quantity, reorder_level, {m('unit_price')}, {d('expiry_date')}, {_BAND} from {{medicines}}"


@query("q39a_inventory_all", _STOCK)
def q39a(h: Hospital) -> DataFrame:
    return worklists.inventory(h)


@query(
    "q39b_inventory_search",
    f"""{_STOCK} where (lower(brand_name) like '%wid%' or lower(generic_name) like '%wid%') and category = 'Brand#7'
        and stock_quantity > 0 and stock_quantity <= reorder_level""",
)
def q39b(h: Hospital) -> DataFrame:
    return worklists.inventory(h, text="WID", category="Brand#7", stock="Low Stock")


@query("q40_categories", "select distinct category from {medicines} where category is not null")
def q40(h: Hospital) -> DataFrame:
    return worklists.categories(h)


@query(
    "q41_pending_lab_orders",
    f"""select o.order_id, p.full_name as patient, p.phone, lt.test_name, lt.category, lt.normal_range, lt.unit, {t('o.ordered_at')}
        from {{lab_orders}} o join {{appointments}} a using (appt_id) join {{patients}} p using (patient_id)
        join {{lab_tests}} lt using (test_id) where o.status = 'Pending'""",
)
def q41(h: Hospital) -> DataFrame:
    return worklists.pending_lab_orders(h)


@query(
    "q42_results_today",
    f"""select o.order_id, lt.test_name, o.result_value, o.is_abnormal, p.full_name, {t('o.result_date')}
        from {{lab_orders}} o join {{appointments}} a using (appt_id) join {{patients}} p using (patient_id)
        join {{lab_tests}} lt using (test_id) where o.status = 'Done' and cast(o.result_date as date) = {DAY}
        order by o.result_date desc, o.order_id desc limit 10""",
)
def q42(h: Hospital) -> DataFrame:
    return worklists.results_on(h, as_of=AS_OF)


@query(
    "q43_recent_results_per_doctor",
    _ranked(
        """select a.doctor_id, o.order_id, o.ordered_at, p.full_name as patient, lt.test_name, o.result_value, o.is_abnormal
           from {lab_orders} o join {appointments} a using (appt_id) join {patients} p using (patient_id) join {lab_tests} lt using (test_id)""",
        "doctor_id", "ordered_at desc, order_id desc", 8,
        """doctor_id, cast(rnk as int) as rank, order_id, patient, test_name, coalesce(result_value, 'Pending') as result,
           case when is_abnormal then 'ABNORMAL' else 'Normal' end as flag""",
    ),
)
def q43(h: Hospital) -> DataFrame:
    return worklists.recent_results_per_doctor(h)


@query(
    "q44a_doctor_directory",
    f"""select d.doctor_id, d.full_name, dept.dept_name as dept, d.specialization, d.phone, {m('d.opd_fee')}, d.status
        from {{doctors}} d join {{departments}} dept using (dept_id)""",
)
def q44a(h: Hospital) -> DataFrame:
    return worklists.doctor_directory(h)


@query(
    "q44b_available_doctors",
    f"select dept_id, doctor_id, full_name, specialization, {m('opd_fee')} from {{doctors}} where status = 'Active'",
)
def q44b(h: Hospital) -> DataFrame:
    return worklists.available_doctors(h)


@query("q45_booked_slots", f"select doctor_id, {d('appt_date')}, appt_time from {{appointments}} where status <> 'Cancelled'")
def q45(h: Hospital) -> DataFrame:
    return worklists.booked_slots(h)


@query(
    "q46_changeable_appointments",
    f"select appt_id, {d('appt_date')}, appt_time from {{appointments}} where status not in ('Completed', 'Cancelled')",
)
def q46(h: Hospital) -> DataFrame:
    return worklists.changeable_appointments(h)


@query(
    "q47_visit_history",
    _ranked(
        """select a.patient_id, a.appt_id, a.appt_date, a.appt_type, d.full_name as doctor, dept.dept_name as department, di.icd_code,
                  di.description as diagnosis, di.severity, a.status, di.diag_id
           from {appointments} a join {doctors} d using (doctor_id) join {departments} dept using (dept_id)
           left join {diagnoses} di on di.appt_id = a.appt_id""",
        "patient_id", "appt_date desc, appt_id desc, diag_id desc", 20,
        f"patient_id, cast(rnk as int) as rank, {d('appt_date')}, appt_type, doctor, department, icd_code, diagnosis, severity, status",
    ),
)
def q47(h: Hospital) -> DataFrame:
    return worklists.visit_history(h)


@query(
    "q48_patient_search",
    f"""select s.term_id, cast(rnk as int) as rank, p.patient_id, p.full_name, p.phone, {d('p.date_of_birth')}, p.blood_group, p.gender,
               p.status, p.email, p.address, {d('p.registration_date')}, i.provider_name, i.policy_number, {m('i.coverage_amount')},
               {d('i.expiry_date')}
        from (select term_id, patient_id, row_number() over (partition by term_id order by full_name, patient_id) as rnk
              from (select term_id, patient_id, full_name from {{asked_terms}} join {{patients}} on lower(full_name) like lower(shape) escape '\\'
                    union select term_id, patient_id, full_name from {{asked_terms}} join {{patients}} on phone like shape escape '\\'
                    union select term_id, patient_id, full_name from {{asked_terms}} join {{patients}} on cast(patient_id as varchar) = trim(term)
                   ) found) s
        join {{patients}} p on p.patient_id = s.patient_id left join {{insurance}} i on i.insurance_id = p.insurance_id where rnk <= 10""",
)
def q48(h: Hospital) -> DataFrame:
    return search.search_patients(h, h.search_terms)


@query(
    "q49_user_directory",
    f"""select u.user_id, u.username, r.role_name, u.is_active, {d('u.last_login')}, u.failed_attempts
        from {{users}} u join {{roles}} r using (role_id)""",
)
def q49(h: Hospital) -> DataFrame:
    return worklists.user_directory(h)


@query(
    "q50a_medicine_catalogue",
    f"select medicine_id, brand_name, generic_name, {m('unit_price')}, stock_quantity from {{medicines}} where stock_quantity > 0",
)
def q50a(h: Hospital) -> DataFrame:
    return worklists.medicine_catalogue(h)


@query("q50b_department_catalogue", "select dept_id, dept_name from {departments}")
def q50b(h: Hospital) -> DataFrame:
    return worklists.department_catalogue(h)


@query(
    "q51_user_doctor_link",
    """select u.user_id, u.username, coalesce(d.doctor_id, (
              select min(x.doctor_id) from {doctors} x
              where trim(replace(replace(replace(lower(u.username), 'dr_', ''), 'dr.', ''), '_', ' ')) <> ''
                and lower(x.full_name) like '%' || trim(replace(replace(replace(lower(u.username), 'dr_', ''), 'dr.', ''), '_', ' ')) || '%')) as doctor_id
       from {users} u left join {doctors} d on d.doctor_id = u.staff_ref_id""",
)
def q51(h: Hospital) -> DataFrame:
    return search.link_users_to_doctors(h)
