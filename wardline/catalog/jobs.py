"""Registered write-side jobs: what was decided per request, and the table images that follow."""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, functions as F

from wardline.catalog.oracle import d, m, t
from wardline.catalog.registry import AS_OF, query
from wardline.plans import billing, booking, clinical, payments, pharmacy, registry
from wardline.plans.common import Outcome, decisions
from wardline.sources.partitions import LAYOUTS, merge_change, open_parts, store_parts
from wardline.sources.staging import cut, shared_folder
from wardline.sources.tables import Hospital

_NONE = "cast(null as varchar)"


def _result(source: str, reason: str, extra: str = "") -> str:
    """Decision rows from a source that carries a reason."""
    return f"select request_id, {reason} is null as accepted, {reason} as reason{extra} from ({source}) x"


def _first(condition: str, key: str, reason: str) -> str:
    """The first request per key among those that pass `condition`; `reason` for the others."""
    return (
        f"case when {condition} and row_number() over (partition by {key}, ({condition}) "
        f"order by request_ts, request_id) > 1 then {reason} end"
    )


# Registration -------------------------------------------------------------------------------------


_REGISTERED = """with decided as (
     select k.request_id, k.request_ts, r.request_id is not null as is_in,
            case when r.request_id is not null then null when k.problem is not null then k.problem
                 when k.phone_known or exists (select 1 from {registration_rounds} o where o.state = 'in' and o.phone = k.phone
                      and (o.request_ts < k.request_ts or (o.request_ts = k.request_ts and o.request_id < k.request_id)))
                   then 'A patient with phone number ' || k.phone || ' already exists.'
                 else 'A patient with email ' || k.email || ' is already registered.' end as reason
     from {registration_known} k left join (select request_id from {registration_rounds} where state = 'in') r
       on r.request_id = k.request_id)
   select request_id, is_in as accepted, reason,
          case when is_in then (select max(patient_id) from {patients})
               + row_number() over (partition by is_in order by request_ts, request_id) end as new_id
   from decided"""


@query("j01_register_patients", _REGISTERED)
def j01(h: Hospital) -> DataFrame:
    return decisions(registry.register_patients(h, h.registration_requests, as_of=AS_OF), new_id="patient_id")


@query("j01b_registration_rounds", _REGISTERED)
def j01b(h: Hospital) -> DataFrame:
    """The same without the last task that takes few requests one by one."""
    return decisions(registry.register_patients(h, h.registration_requests, as_of=AS_OF, last=0), new_id="patient_id")


@query(
    "j02_upsert_insurance",
    """with cleaned as (select *, trim(policy_number) as policy, trim(provider_name) as provider from {insurance_requests}),
       judged as (
         select *, case when (provider <> '' or policy <> '' or coverage_amount > 0) and provider = '' then 'Insurance provider name required.'
                        when (provider <> '' or policy <> '' or coverage_amount > 0) and policy = '' then 'Policy number required.'
                        when (provider <> '' or policy <> '') and coverage_amount <= 0 then 'Coverage amount must be greater than 0.'
                        when provider = '' and policy = '' then 'Policy number required.' end as reason from cleaned),
       fresh as (
         select policy, 24 + row_number() over (order by request_ts, request_id) as new_id
         from (select policy, request_ts, request_id, row_number() over (partition by policy order by request_ts, request_id) as rn
               from judged where reason is null and policy not in (select policy_number from {insurance})) f where rn = 1)
       select request_id, reason is null as accepted, reason,
              case when reason is null then coalesce(i.insurance_id, f.new_id) end as new_id
       from judged j left join {insurance} i on i.policy_number = j.policy left join fresh f on f.policy = j.policy""",
)
def j02(h: Hospital) -> DataFrame:
    return decisions(registry.upsert_insurance(h, h.insurance_requests), new_id="insurance_id")


# Appointments -------------------------------------------------------------------------------------

BOOKING_NOW = "1996-06-15 09:45:00"
_BOOK = """
    select b.*, case when p.patient_id is null then 'Patient not found.'
        when not exists (select 1 from {doctors} d where d.doctor_id = b.doctor_id and d.status = 'Active')
          then 'Selected doctor is not currently available.'
        when b.appt_date is null then 'Appointment date is required.'
        when b.appt_date < date '1996-06-15' then 'Appointment date cannot be in the past.'
        when b.appt_date - date '1996-06-15' > 365 then 'Cannot schedule more than 1 year in advance.'
        when b.appt_time is null then 'Appointment time is required.'
        when not regexp_matches(trim(b.appt_time), '^[0-9][0-9]:[0-9][0-9](:[0-9][0-9])?$')
          then 'Appointment time must be given as HH:MM or HH:MM:SS.'
        when cast(substr(appt_time, 1, 2) as int) < 8 then 'Appointments cannot be before 8:00 AM.'
        when cast(substr(appt_time, 1, 2) as int) >= 20 then 'Appointments cannot be after 8:00 PM.'
        when b.appt_date = date '1996-06-15' and appt_time < '11:45:00'
          then 'For today''s appointments, time must be at least 2 hours from now (earliest allowed: 11:45 AM).'
        when coalesce(appt_type, '') not in ('OPD', 'IPD', 'Emergency') then 'Unknown appointment type.'
        when exists (select 1 from {settled_appointments} a where a.doctor_id = b.doctor_id and a.appt_date = b.appt_date
                     and a.appt_time = b.appt_time and a.status <> 'Cancelled')
          then 'slot conflict: This time slot is already booked for the selected doctor.' end as failed
    from (select * replace (case when trim(appt_time) like '__:__' then trim(appt_time) || ':00' else appt_time end as appt_time)
          from {booking_requests}) b left join {patients} p on p.patient_id = b.patient_id"""


@query(
    "j03_book_appointments",
    f"""with checked as ({_BOOK}),
        decided as (select *, coalesce(failed, {_first('failed is null', 'doctor_id, appt_date, appt_time',
            "'slot conflict: This time slot is already booked for the selected doctor.'")}) as reason from checked)
        select request_id, reason is null as accepted, reason,
               case when reason is null then (select max(appt_id) from {{settled_appointments}})
                    + row_number() over (partition by reason is null order by request_ts, request_id) end as new_id
        from decided""",
)
def j03(h: Hospital) -> DataFrame:
    before = h.replaced(appointments=h.settled_appointments)
    return decisions(booking.book_appointments(before, h.booking_requests, as_of=BOOKING_NOW), new_id="appt_id")


@query(
    "j03b_slots_after_booking",
    f"""with checked as ({_BOOK}),
        decided as (select *, coalesce(failed, {_first('failed is null', 'doctor_id, appt_date, appt_time', "'taken'")}) as reason from checked)
        select status, count(*) as appointments from (
            select status from {{settled_appointments}} union all select 'Confirmed' from decided where reason is null) x group by status""",
)
def j03b(h: Hospital) -> DataFrame:
    before = h.replaced(appointments=h.settled_appointments)
    image = booking.book_appointments(before, h.booking_requests, as_of=BOOKING_NOW).tables["appointments"]
    return image.groupBy("status").agg(F.count("*").alias("appointments"))


_CANCEL = f"""
    select r.*, a.status, case when trim(reason_text) = '' then 'Cancellation reason required.'
        when length(trim(reason_text)) < 5 then 'Please give a more detailed reason.'
        when a.status is null or a.status in ('Completed', 'Cancelled') then 'Appointment is not open.' end as failed
    from {{cancel_requests}} r left join {{appointments}} a on a.appt_id = r.appt_id"""
_CANCELLED = f"select *, coalesce(failed, {_first('failed is null', 'appt_id', chr(39) + 'Appointment is not open.' + chr(39))}) as reason from ({_CANCEL}) c"


@query("j04_cancel_appointments", _result(_CANCELLED, "reason"))
def j04(h: Hospital) -> DataFrame:
    return decisions(booking.cancel_appointments(h, h.cancel_requests))


@query(
    "j04b_appointments_after_cancel",
    f"""select a.appt_id, case when c.appt_id is null then a.status else 'Cancelled' end as status, coalesce(c.note, a.notes) as notes
        from {{appointments}} a left join (select appt_id, trim(reason_text) as note from ({_CANCELLED}) d where reason is null) c
          on c.appt_id = a.appt_id""",
)
def j04b(h: Hospital) -> DataFrame:
    return booking.cancel_appointments(h, h.cancel_requests).tables["appointments"].select("appt_id", "status", "notes")


_MOVED = """
    select r.*, case when a.status is null or a.status in ('Completed', 'Cancelled') then 'Appointment is not open.'
        when new_date is null then 'Appointment date is required.' when new_time is null then 'Appointment time is required.'
        when new_time = 'noon' then 'Appointment time must be given as HH:MM or HH:MM:SS.'
        when new_time < '08:00:00' or new_time > '20:00:00' then 'Appointment time must be between 08:00 AM and 08:00 PM.'
        when not w.admitted then 'Slot conflict: Doctor already booked at this time' end as reason
    from {move_requests} r left join {appointments} a on a.appt_id = r.appt_id left join {move_walk} w on w.request_id = r.request_id"""


@query("j05_reschedule_appointments", _result(_MOVED, "reason"))
def j05(h: Hospital) -> DataFrame:
    return decisions(booking.reschedule_appointments(h, h.move_requests))


@query(
    "j05c_chained_moves",
    "select r.request_id, w.admitted as accepted from {chain_requests} r join {chain_walk} w on w.request_id = r.request_id",
)
def j05c(h: Hospital) -> DataFrame:
    """Every open appointment asks for the next one's slot, with most doctors the last one first; in rounds to the end."""
    return decisions(booking.reschedule_appointments(h, h.chain_requests, last=0)).select("request_id", "accepted")


@query(
    "j05b_appointments_after_moves",
    f"""select a.appt_id, {d('coalesce(m.new_date, a.appt_date)', 'appt_date')}, coalesce(m.new_time, a.appt_time) as appt_time
        from {{appointments}} a left join (
            select * from (select *, row_number() over (partition by appt_id order by request_ts desc, request_id desc) as rn
                           from ({_MOVED}) d where reason is null) e where rn = 1) m on m.appt_id = a.appt_id""",
)
def j05b(h: Hospital) -> DataFrame:
    image = booking.reschedule_appointments(h, h.move_requests).tables["appointments"]
    return image.select("appt_id", "appt_date", "appt_time")


@query(
    "j06_complete_appointments",
    _result(
        """select r.*, case when a.doctor_id is null or a.doctor_id <> r.doctor_id then 'Appointment belongs to another doctor.'
               when a.status in ('Completed', 'Cancelled') then 'Appointment is not open.' end as reason
           from {complete_requests} r left join {appointments} a on a.appt_id = r.appt_id""",
        "reason",
    ),
)
def j06(h: Hospital) -> DataFrame:
    return decisions(booking.complete_appointments(h, h.complete_requests))


# Merges into stored tables ------------------------------------------------------------------------


def _files(stored: DataFrame, part: str) -> DataFrame:
    named = stored.select(part, F.input_file_name().alias("file")).distinct()
    return named.groupBy(part).agg(F.sort_array(F.collect_set("file")).alias("files"))


def _merged(h: Hospital, name: str, outcome: Outcome) -> tuple[DataFrame, DataFrame]:
    """A table stored by partition with an outcome's change merged into it, and which partitions got new files."""
    path = f"{shared_folder(h.spark)}/merged/{uuid.uuid4().hex}"
    part = LAYOUTS[name].part
    store_parts(h.table(name), path, name)
    before = cut(_files(open_parts(h.spark, path, name), part))
    merge_change(h.spark, path, name, outcome.changes[name])
    stored = open_parts(h.spark, path, name)
    after = _files(stored, part).withColumnRenamed("files", "now")
    return stored, after.join(before, part, "left").select(part, (~F.col("now").eqNullSafe(F.col("files"))).alias("rewritten"))


@query(
    "m1_merge_one_week",
    f"""with gone as (select * from ({_CANCELLED}) c where reason is null and appt_id in (
             select appt_id from {{appointments}} where appt_date between date '1996-06-10' and date '1996-06-16'))
        select strftime(a.appt_date, '%Y-%m') as appt_month, count(*) as appointments,
               cast(sum(case when a.status = 'Cancelled' or c.appt_id is not null then 1 else 0 end) as bigint) as cancelled,
               count(c.appt_id) > 0 as rewritten
        from {{appointments}} a left join gone c on c.appt_id = a.appt_id group by 1""",
)
def m1(h: Hospital) -> DataFrame:
    """Cancellations of one week's appointments rewrite one month; all other months keep their files."""
    week = h.appointments.filter(F.col("appt_date").between(date(1996, 6, 10), date(1996, 6, 16)))
    asked = h.cancel_requests.join(week.select("appt_id"), "appt_id", "left_semi")
    stored, rewritten = _merged(h, "appointments", booking.cancel_appointments(h, asked))
    figures = stored.groupBy("appt_month").agg(
        F.count("*").alias("appointments"), F.count_if(F.col("status") == "Cancelled").alias("cancelled")
    )
    return figures.join(rewritten, "appt_month")


@query(
    "m2_merge_moves",
    f"""select a.appt_id, {d('coalesce(m.new_date, a.appt_date)', 'appt_date')}, coalesce(m.new_time, a.appt_time) as appt_time,
               strftime(coalesce(m.new_date, a.appt_date), '%Y-%m') as appt_month
        from {{appointments}} a left join (
            select * from (select *, row_number() over (partition by appt_id order by request_ts desc, request_id desc) as rn
                           from ({_MOVED}) d where reason is null) e where rn = 1) m on m.appt_id = a.appt_id""",
)
def m2(h: Hospital) -> DataFrame:
    """Moves take appointments from month to month of the stored table."""
    stored, _ = _merged(h, "appointments", booking.reschedule_appointments(h, h.move_requests))
    return stored.select("appt_id", "appt_date", "appt_time", "appt_month")


# Billing ------------------------------------------------------------------------------------------


@query(
    "j07_generate_bills",
    f"""select bill_id, patient_id, appt_id, {m('total_amount')}, {m('insurance_covered')}, {m('net_payable')}, {t('bill_date')},
               {d('due_date')}, status, generated_by from {{new_bills}}""",
)
def j07(h: Hospital) -> DataFrame:
    return billing.generate_bills(h, h.bill_requests, as_of=AS_OF, existing=None).bills


@query(
    "j07b_bill_items",
    f"select item_id, bill_id, service_type, description, quantity, {m('unit_price')}, {m('total')} from {{bill_items}}",
)
def j07b(h: Hospital) -> DataFrame:
    return billing.generate_bills(h, h.bill_requests, as_of=AS_OF, existing=None).items


@query(
    "j07c_second_billing_run",
    """select appt_id as request_id, 'A bill has already been generated for this appointment.' as reason
       from {appointments} where status = 'Completed' and appt_id in (select appt_id from {new_bills})""",
)
def j07c(h: Hospital) -> DataFrame:
    """A later run over all completed appointments refuses exactly those that have a bill."""
    again = h.appointments.filter(F.col("status") == "Completed").select(
        F.col("appt_id").alias("request_id"), "appt_id", F.lit(1).cast("long").alias("generated_by")
    )
    run = billing.admit_bill_requests(h, again, AS_OF, h.bills)
    return run.filter(F.col("reason").isNotNull()).select("request_id", "reason")


_PAY_REASON = """
    select r.request_id, w.used_before, coalesce(w.admitted, false) as accepted,
           case when w.admitted then null when b.bill_id is null then 'Bill not found.'
                when w.used_before > 0 and w.used_before >= b.net_payable then 'This bill has already been fully paid.'
                when r.payment_mode not in ('Cash', 'Card', 'UPI', 'Insurance') then 'Unknown payment mode.'
                when r.payment_mode in ('Card', 'UPI') and coalesce(trim(r.transaction_ref), '') = ''
                  then 'Transaction reference is required for ' || r.payment_mode || ' payments.'
                when r.amount <= 0 then 'Payment amount must be greater than 0.'
                else 'Payment of ₹' || cast(r.amount as varchar) || ' would exceed outstanding amount of ₹'
                     || cast(cast(b.net_payable - w.used_before as decimal(12,2)) as varchar) || '.' end as reason
    from {payment_requests} r left join {new_bills} b on b.bill_id = r.bill_id left join {pay_walk} w on w.request_id = r.request_id"""


@query("j08_record_payments", f"select request_id, accepted, reason from ({_PAY_REASON}) x")
def j08(h: Hospital) -> DataFrame:
    decided = payments.decide_payments(h.new_bills, None, h.payment_requests)
    return decided.select("request_id", F.col("admitted").alias("accepted"), "reason")


@query("j08c_payment_rounds", f"select request_id, accepted from ({_PAY_REASON}) x")
def j08c(h: Hospital) -> DataFrame:
    """Every contested bill decided in rounds, as those with very many payments are."""
    decided = payments.decide_payments(h.new_bills, None, h.payment_requests, fold_limit=0)
    return decided.select("request_id", F.col("admitted").alias("accepted"))


@query(
    "j08b_bills_after_payments",
    f"select bill_id, {m('net_payable')}, status, {m('coalesce(paid, 0)', 'paid')} from {{bills}} left join {{received}} using (bill_id)",
)
def j08b(h: Hospital) -> DataFrame:
    run = payments.record_payments(h.new_bills, None, h.payment_requests)
    paid = run.payments.groupBy("bill_id").agg(F.sum("amount_paid").alias("_paid"))
    return run.bills.join(paid, "bill_id", "left").select(
        "bill_id", "net_payable", "status", F.coalesce("_paid", F.lit(0)).cast("decimal(18,2)").alias("paid")
    )


# Pharmacy -----------------------------------------------------------------------------------------


@query(
    "j09_dispense",
    """select q.request_id, coalesce(w.admitted, false) as accepted,
              case when w.admitted then null when p.rx_id is null then 'Prescription not found.'
                   when p.is_dispensed or w.closed then 'Prescription has already been dispensed.'
                   when q.quantity < 1 then 'Quantity must be at least 1.'
                   when s.room - w.used_before = 0 then 'OUT OF STOCK — cannot dispense.'
                   else 'Cannot dispense ' || q.quantity || ' units. Only ' || cast(s.room - w.used_before as bigint) || ' in stock.' end as reason
       from {dispense_requests} q left join {prescriptions} p on p.rx_id = q.rx_id
       left join {stock_requests} s on s.request_id = q.request_id left join {hand_walk} w on w.request_id = q.request_id""",
)
def j09(h: Hospital) -> DataFrame:
    decided = pharmacy.decide_dispense(h, h.dispense_requests)
    return decided.select("request_id", F.col("admitted").alias("accepted"), "reason")


@query("j09d_dispense_rounds", "select request_id, coalesce(admitted, false) as accepted from {dispense_requests} left join {hand_walk} using (request_id)")
def j09d(h: Hospital) -> DataFrame:
    """Every contested medicine decided in rounds, as those with very many requests are."""
    decided = pharmacy.decide_dispense(h, h.dispense_requests, fold_limit=0)
    return decided.select("request_id", F.col("admitted").alias("accepted"))


@query("j09b_stock_after_dispense", "select medicine_id, stock_left as stock_quantity from {stock_after}")
def j09b(h: Hospital) -> DataFrame:
    return pharmacy.dispense(h, h.dispense_requests).medicines.select("medicine_id", "stock_quantity")


@query(
    "j09c_dispense_warnings",
    """select medicine_id, brand_name, stock_left as stock_quantity, reorder_level from {stock_after}
       where touched and stock_left <= reorder_level""",
)
def j09c(h: Hospital) -> DataFrame:
    return pharmacy.dispense(h, h.dispense_requests).warnings


@query(
    "j10_restock",
    """select m.medicine_id, cast(m.stock_quantity + coalesce(r.added, 0) as int) as stock_quantity from {medicines} m left join (
         select medicine_id, sum(quantity) as added from {restock_requests} where quantity between 1 and 100000 group by medicine_id) r
         on r.medicine_id = m.medicine_id""",
)
def j10(h: Hospital) -> DataFrame:
    return pharmacy.restock(h, h.restock_requests).tables["medicines"].select("medicine_id", "stock_quantity")


@query(
    "j11_low_stock_alerts",
    """select medicine_id, brand_name, stock_left as stock_quantity, reorder_level,
              'LOW STOCK ALERT: ' || brand_name || ' has only ' || stock_left || ' units left' as message
       from {stock_after} where touched and stock_left < reorder_level""",
)
def j11(h: Hospital) -> DataFrame:
    after = pharmacy.dispense(h, h.dispense_requests).medicines
    return pharmacy.low_stock_alerts(pharmacy.changed_medicines(h.medicines, after))


# Laboratory and clinical records ------------------------------------------------------------------

_RESULT = """
    select r.*, case when trim(r.result_value) = '' then 'Result Value is required.'
        when length(r.result_value) > 200 then 'Result Value cannot exceed 200 characters.'
        when length(trim(r.result_value)) > 100 then 'One of the fields is too long. Please shorten your input.'
        when o.status is null or o.status <> 'Pending' then 'Lab order is not pending.' end as reason
    from {lab_result_requests} r left join {lab_orders} o on o.order_id = r.order_id"""


@query("j12_apply_lab_results", _result(_RESULT, "reason"))
def j12(h: Hospital) -> DataFrame:
    return decisions(clinical.apply_lab_results(h, h.lab_result_requests))


@query(
    "j12b_lab_orders_after_results",
    f"""select o.order_id, coalesce(trim(r.result_value), o.result_value) as result_value,
               case when r.order_id is null then o.is_abnormal else r.is_abnormal end as is_abnormal,
               case when r.order_id is null then o.status else 'Done' end as status, {t('coalesce(r.request_ts, o.result_date)', 'result_date')}
        from {{lab_orders}} o left join (select * from ({_RESULT}) x where reason is null) r on r.order_id = o.order_id""",
)
def j12b(h: Hospital) -> DataFrame:
    image = clinical.apply_lab_results(h, h.lab_result_requests).tables["lab_orders"]
    return image.select("order_id", "result_value", "is_abnormal", "status", "result_date")


@query(
    "j12c_results_trigger_mode",
    f"""select count(*) as abnormal from {{lab_orders}} o left join (select * from ({_RESULT}) x where reason is null) r on r.order_id = o.order_id
        where o.is_abnormal or r.order_id is not null""",
)
def j12c(h: Hospital) -> DataFrame:
    image = clinical.apply_lab_results(h, h.lab_result_requests, mode="trigger").tables["lab_orders"]
    return image.filter("is_abnormal").agg(F.count("*").alias("abnormal"))


def _numbered(judged: str, start: str) -> str:
    return f"""select request_id, reason is null as accepted, reason,
               case when reason is null then {start} + row_number() over (partition by reason is null order by request_ts, request_id) end as new_id
               from ({judged}) x"""


@query(
    "j13a_record_diagnoses",
    _numbered(
        """select r.*, case when a.appt_id is null then 'Select an appointment.'
               when trim(icd_code) = '' then 'ICD code is required.'
               when not regexp_matches(upper(trim(icd_code)), '^[A-Z][0-9][0-9](\\.[0-9A-Z]{1,4})?$') then 'Invalid ICD-10 format. Use e.g. J18.9 or A00'
               when trim(r.description) = '' then 'Description is required.'
               when r.severity not in ('Mild', 'Moderate', 'Severe') then 'Severity required.' end as reason
           from {diagnosis_requests} r left join {appointments} a on a.appt_id = r.appt_id""",
        "(select max(diag_id) from {diagnoses})",
    ),
)
def j13a(h: Hospital) -> DataFrame:
    return decisions(clinical.record_diagnoses(h, h.diagnosis_requests), new_id="diag_id")


@query(
    "j13b_record_prescriptions",
    _numbered(
        """select r.*, case when md.medicine_id is null then 'Select a medicine.'
               when trim(r.dosage) = '' then 'Dosage is required (e.g. 500mg, 10ml, 1 tablet).'
               when length(trim(r.dosage)) > 50 then 'Dosage too long (max 50 characters).'
               when r.frequency not in ('Once daily', 'Twice daily', 'Three times daily', 'Every 8 hours', 'As needed (SOS)') then 'Frequency required.'
               when cast(r.duration_days as int) < 1 then 'Duration must be at least 1 day.'
               when cast(r.duration_days as int) > 365 then 'Duration cannot exceed 365 days.' end as reason
           from {prescription_requests} r left join {medicines} md on md.medicine_id = r.medicine_id""",
        "(select max(rx_id) from {prescriptions})",
    ),
)
def j13b(h: Hospital) -> DataFrame:
    return decisions(clinical.record_prescriptions(h, h.prescription_requests), new_id="rx_id")


@query(
    "j13c_record_lab_orders",
    _numbered(
        """select r.*, case when a.appt_id is null then 'Select an appointment.' when r.test_id > 6 then 'Select at least one test.' end as reason
           from {lab_order_requests} r left join {appointments} a on a.appt_id = r.appt_id""",
        "(select max(order_id) from {lab_orders})",
    ),
)
def j13c(h: Hospital) -> DataFrame:
    return decisions(clinical.record_lab_orders(h, h.lab_order_requests), new_id="order_id")


# Master data --------------------------------------------------------------------------------------


@query(
    "j14_add_medicines",
    _numbered(
        f"""select *, coalesce(failed, {_first('failed is null', 'lower(brand), lower(generic)', "'Medicine ' || chr(39) || brand || chr(39) || ' (' || generic || ') already exists in inventory.'")}) as reason
            from (select r.*, trim(brand_name) as brand, trim(generic_name) as generic,
                    case when length(trim(brand_name)) < 2 then 'Medicine name must be at least 2 characters.'
                         when category = '' then 'Category is required.'
                         when unit_price < 0.01 then 'Unit Price must be at least ₹0.01.'
                         when reorder_level < 1 then 'Reorder level must be at least 1.'
                         when exists (select 1 from {{medicines}} m where lower(m.brand_name) = lower(trim(r.brand_name))
                                      and lower(m.generic_name) = lower(trim(r.generic_name)))
                           then 'Medicine ' || chr(39) || trim(brand_name) || chr(39) || ' (' || trim(generic_name) || ') already exists in inventory.' end as failed
                  from {{medicine_requests}} r) f""",
        "(select max(medicine_id) from {medicines})",
    ),
)
def j14(h: Hospital) -> DataFrame:
    return decisions(registry.add_medicines(h, h.medicine_requests), new_id="medicine_id")


_PATIENT_UPDATE = """
    select r.*, coalesce(failed, case when not w.admitted then 'This record already exists. Please check for duplicates.' end) as reason
    from {update_clean} r left join {update_walk} w on w.request_id = r.request_id"""


@query("j15a_update_patients", _result(_PATIENT_UPDATE, "reason"))
def j15a(h: Hospital) -> DataFrame:
    return decisions(registry.update_patients(h, h.patient_update_requests))


@query(
    "j15b_patients_after_updates",
    f"""with last_change as (select * from (select *, row_number() over (partition by patient_id order by request_ts desc, request_id desc) as rn
                             from ({_PATIENT_UPDATE}) u where reason is null) v where rn = 1)
        select p.patient_id, case when c.patient_id is null then p.phone else c.clean end as phone,
               case when c.patient_id is null then p.email else nullif(lower(trim(c.email)), '') end as email,
               case when c.patient_id is null then p.address else nullif(trim(regexp_replace(c.address, ' +', ' ', 'g')), '') end as address,
               case when c.patient_id is null then p.status else c.status end as status
        from {{patients}} p left join last_change c on c.patient_id = p.patient_id""",
)
def j15b(h: Hospital) -> DataFrame:
    image = registry.update_patients(h, h.patient_update_requests).tables["patients"]
    return image.select("patient_id", "phone", "email", "address", "status")


@query(
    "j15c_update_doctors",
    f"""with judged as (
          select r.*, case when d.doctor_id is null then 'Record not found.' when r.opd_fee < 0 then 'Fee must not be negative.'
                           when r.status not in ('Active', 'Inactive', 'On Leave') then 'Unknown status.' end as reason
          from {{doctor_update_requests}} r left join {{doctors}} d on d.doctor_id = r.doctor_id),
        last_change as (select * from (select *, row_number() over (partition by doctor_id order by request_ts desc, request_id desc) as rn
                        from judged where reason is null) v where rn = 1)
        select d.doctor_id, {m('coalesce(c.opd_fee, d.opd_fee)', 'opd_fee')}, coalesce(c.status, d.status) as status
        from {{doctors}} d left join last_change c on c.doctor_id = d.doctor_id""",
)
def j15c(h: Hospital) -> DataFrame:
    image = registry.update_doctors(h, h.doctor_update_requests).tables["doctors"]
    return image.select("doctor_id", "opd_fee", "status")


@query(
    "j15d_update_accounts",
    """with judged as (
         select r.*, case when r.user_id = r.by_user then 'You cannot disable your own account.'
                          when u.user_id is null then 'Record not found.' end as reason
         from {account_update_requests} r left join {users} u on u.user_id = r.user_id),
       last_change as (select * from (select *, row_number() over (partition by user_id order by request_ts desc, request_id desc) as rn
                       from judged where reason is null) v where rn = 1)
       select u.user_id, coalesce(c.is_active, u.is_active) as is_active,
              case when c.user_id is null then u.failed_attempts else 0 end as failed_attempts
       from {users} u left join last_change c on c.user_id = u.user_id""",
)
def j15d(h: Hospital) -> DataFrame:
    image = registry.update_accounts(h, h.account_update_requests).tables["users"]
    return image.select("user_id", "is_active", "failed_attempts")


@query(
    "j16a_add_users",
    _numbered(
        f"""select *, coalesce(failed, {_first('failed is null', 'name', "'Username ' || chr(39) || name || chr(39) || ' already taken.'")}) as reason
            from (select r.*, lower(trim(username)) as name,
                    case when username = 'ab' then 'Username must be at least 3 characters.'
                         when username = 'has space' then 'Username can only contain letters, numbers and underscores.'
                         when username = '9lives' then 'Username cannot start with a number.'
                         when role_id > 6 then 'Role required.'
                         when exists (select 1 from {{users}} u where lower(u.username) = lower(trim(r.username)))
                           then 'Username ' || chr(39) || lower(trim(username)) || chr(39) || ' already taken.' end as failed
                  from {{user_requests}} r) f""",
        "(select max(user_id) from {users})",
    ),
)
def j16a(h: Hospital) -> DataFrame:
    return decisions(registry.add_users(h, h.user_requests), new_id="user_id")


@query(
    "j16b_add_doctors",
    _numbered(
        """select *, case when full_name = 'Dr 7' then 'Name can only contain letters, spaces, dots and hyphens.'
               when dept_id > 24 then 'Department required.' when specialization = '' then 'Specialization required.'
               when phone = '98765' then 'Phone must be exactly 10 digits. You entered 5 digit(s).'
               when email = 'nope' then 'Invalid email format. Example: name@example.com' end as reason
           from {doctor_requests}""",
        "(select max(doctor_id) from {doctors})",
    ),
)
def j16b(h: Hospital) -> DataFrame:
    return decisions(registry.add_doctors(h, h.doctor_requests), new_id="doctor_id")
