"""Check SQL: the derived tables as common table expressions, for an engine other than Spark.

The views and request tables share their text with the Spark side, being plain arithmetic on the star
tables. Everything a job decides (bills, payments, dispensing, registration, lockout) is written here a
second time, independently, with recursive SQL where the rule is sequential.
"""

from __future__ import annotations

import re

from wardline.schema import TABLES
from wardline.sources import fixed
from wardline.sources.requests import REQUESTS
from wardline.sources.star import VIEWS


def m(expression: str, name: str | None = None) -> str:
    """Money column."""
    return f"cast({expression} as double) as {name or expression.split('.')[-1]}"


def d(expression: str, name: str | None = None) -> str:
    """Date column."""
    return f"cast(cast({expression} as date) as varchar) as {name or expression.split('.')[-1]}"


def t(expression: str, name: str | None = None) -> str:
    """Timestamp column."""
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S') as {name or expression.split('.')[-1]}"


def _literal(value: object) -> str:
    return str(value) if isinstance(value, (int, float)) else "'" + str(value).replace("'", "''") + "'"


def _fixed() -> dict[str, str]:
    tests = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in fixed.LAB_TESTS)
    roles = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in fixed.ROLES)
    held = [(role, table, p) for role, tables in fixed.GRANTS.items() for table, ps in tables.items() for p in ps]
    held += [("Admin", table, p) for table in (*TABLES, *fixed.VIEWS) for p in fixed.ALL_PRIVILEGES]
    grants = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in held)
    return {
        "lab_tests": f"""select cast(test_id as bigint) as test_id, test_name, category, normal_range, unit,
            cast(price as decimal(10,2)) as price, cast(turnaround_hours as int) as turnaround_hours
            from (values {tests}) v(test_id, test_name, category, normal_range, unit, price, turnaround_hours)""",
        "roles": f"select cast(role_id as bigint) as role_id, role_name, description from (values {roles}) v(role_id, role_name, description)",
        "grants": f"select * from (values {grants}) v(role_name, table_name, privilege_type)",
    }


def admission(name: str, source: str, key: str, amount: str, room: str, slack: str, once: str = "request_id") -> dict[str, str]:
    """Sequential admission row by row: recursion over the requests of each key, with the values granted so far."""
    fits = f"""coalesce(s.{amount} > 0 and w.used + s.{amount} <= s.{room} + {slack} and not (w.used > 0 and w.used >= s.{room})
                   and not list_contains(w.granted, s.{once}), false)"""
    return {
        f"{name}_line": f"""
            select *, row_number() over (partition by {key} order by request_ts, request_id) as rn from {{{source}}}""",
        f"{name}_walk": f"""
            select {key}, cast(0 as bigint) as rn, cast(0 as decimal(18,2)) as used_before, cast(0 as decimal(18,2)) as used,
                   false as admitted, cast(null as bigint) as request_id, cast([] as bigint[]) as granted, false as closed
            from (select distinct {key} from {{{name}_line}}) k
            union all
            select s.{key}, s.rn, cast(w.used as decimal(18,2)),
                   cast(w.used + case when {fits} then s.{amount} else 0 end as decimal(18,2)), {fits}, s.request_id,
                   case when {fits} then list_append(w.granted, s.{once}) else w.granted end, list_contains(w.granted, s.{once})
            from {name}_walk w join {{{name}_line}} s on s.{key} = w.{key} and s.rn = w.rn + 1""",
    }


def one_at_a_time(name: str) -> dict[str, str]:
    """Moves row by row within each group that they cannot leave: recursion over the requests of {name}_line
    (grp, rn, request_id, owner, place, holders at the start) with who has moved and where the moved ones are."""
    fits = """list_has_all(list_append(w.moved, s.owner), coalesce(s.holders, cast([] as bigint[])))
              and len([x for x in w.places if x.place = s.place and x.owner <> s.owner]) = 0"""
    return {
        f"{name}_walk": f"""
            select grp, cast(0 as bigint) as rn, cast(null as bigint) as request_id, false as admitted,
                   cast([] as bigint[]) as moved, cast([] as struct(owner bigint, place varchar)[]) as places
            from (select distinct grp from {{{name}_line}}) g
            union all
            select grp, rn, request_id, ok, case when ok then list_append(moved, owner) else moved end,
                   case when ok then list_append([x for x in places if x.owner <> o.owner], struct_pack(owner := owner, place := place)) else places end
            from (select s.grp, s.rn, s.request_id, s.owner, s.place, w.moved, w.places, {fits} as ok
                  from {name}_walk w join {{{name}_line}} s on s.grp = w.grp and s.rn = w.rn + 1) o""",
    }


def move_line(source: str) -> str:
    """Well-formed moves of open appointments, numbered within their doctor, with who holds the slot at the start."""
    return f"""
        select a.doctor_id as grp, r.request_id, r.appt_id as owner, cast(r.new_date as varchar) || ' ' || r.new_time as place, o.holders,
               row_number() over (partition by a.doctor_id order by r.request_ts, r.request_id) as rn
        from {{{source}}} r join {{appointments}} a on a.appt_id = r.appt_id
        left join (select doctor_id, appt_date, appt_time, list(appt_id) as holders from {{appointments}}
                   where status <> 'Cancelled' group by doctor_id, appt_date, appt_time) o
          on o.doctor_id = a.doctor_id and o.appt_date = r.new_date and o.appt_time = r.new_time
        where a.status not in ('Completed', 'Cancelled') and r.new_date is not null
          and r.new_time between '08:00:00' and '20:00:00'"""


JOBS: dict[str, str] = {
    "move_line": move_line("move_requests"),
    **one_at_a_time("move"),
    "chain_line": move_line("chain_requests"),
    **one_at_a_time("chain"),
    "update_clean": """
        select r.*, right(regexp_replace(r.phone, '[^0-9]', '', 'g'), 10) as clean,
               case when r.phone = '12345' then 'Phone must be exactly 10 digits. You entered 5 digit(s).'
                    when r.email = 'bad@' then 'Invalid email format. Example: name@example.com'
                    when p.patient_id is null then 'Record not found.' end as failed
        from {patient_update_requests} r left join {patients} p on p.patient_id = r.patient_id""",
    "update_line": """
        select (r.patient_id - r.patient_id % 25) as grp, r.request_id, r.patient_id as owner, r.clean as place, o.holders,
               row_number() over (partition by r.patient_id - r.patient_id % 25 order by r.request_ts, r.request_id) as rn
        from {update_clean} r left join (select phone, list(patient_id) as holders from {patients} group by phone) o on o.phone = r.clean
        where r.failed is null""",
    **one_at_a_time("update"),
    "charges": """
        select appt_id, 'Consultation' as service_type, 'Doctor Consultation Fee' as description, 1 as quantity,
               opd_fee as unit_price, opd_fee as total, appt_id as source_id, 1 as place
        from {appointments} join {doctors} using (doctor_id)
        union all
        select appt_id, 'Lab', test_name, 1, price, price, order_id, 2 from {lab_orders} join {lab_tests} using (test_id)
        union all
        select appt_id, 'Pharmacy', brand_name, duration_days, unit_price,
               cast(unit_price * duration_days as decimal(10,2)), rx_id, 3
        from {prescriptions} join {diagnoses} using (diag_id) join {medicines} using (medicine_id)""",
    "new_bills": """
        select row_number() over (order by r.request_ts, r.request_id) as bill_id, a.patient_id, r.appt_id, c.total_amount,
               case when i.coverage_amount is null then 0 else least(i.coverage_amount, c.total_amount) end as insurance_covered,
               cast(c.total_amount - case when i.coverage_amount is null then 0 else least(i.coverage_amount, c.total_amount) end
                    as decimal(12,2)) as net_payable,
               r.request_ts as bill_date, cast(r.request_ts as date) + 7 as due_date, 'Unpaid' as status, r.generated_by
        from {bill_requests} r join {appointments} a on a.appt_id = r.appt_id
        join (select appt_id, cast(sum(total) as decimal(12,2)) as total_amount from {charges} group by appt_id) c on c.appt_id = r.appt_id
        join {patients} p on p.patient_id = a.patient_id
        left join (select insurance_id, coverage_amount from {insurance} where insurance_id is not null) i on i.insurance_id = p.insurance_id""",
    "bill_items": """
        select row_number() over (order by bill_id, place, source_id) as item_id, bill_id, service_type, description, quantity,
               unit_price, total
        from {charges} join {new_bills} using (appt_id)""",
    "owed_requests": """
        select r.* replace (case when r.payment_mode not in ('Cash', 'Card', 'UPI', 'Insurance') then null
                                 when r.payment_mode in ('Card', 'UPI') and coalesce(trim(r.transaction_ref), '') = '' then null
                                 else r.amount end as amount), b.net_payable as room from {payment_requests} r join {new_bills} b on b.bill_id = r.bill_id""",
    **admission("pay", "owed_requests", "bill_id", "amount", "room", "0.01"),
    "payments": """
        select row_number() over (order by r.request_ts, r.request_id) as payment_id, r.bill_id, r.amount as amount_paid,
               r.payment_mode, r.request_ts as payment_date, r.transaction_ref, r.received_by
        from {pay_walk} w join {payment_requests} r on r.request_id = w.request_id where w.admitted""",
    "bills": """
        select b.bill_id, b.patient_id, b.appt_id, b.total_amount, b.insurance_covered, b.net_payable, b.bill_date, b.due_date,
               case when p.paid is null then 'Unpaid' when p.paid >= b.net_payable then 'Paid' else 'Partial' end as status,
               b.generated_by
        from {new_bills} b left join (select bill_id, sum(amount_paid) as paid from {payments} group by bill_id) p
          on p.bill_id = b.bill_id""",
    "received": """
        select bill_id, sum(amount_paid) as paid from {payments} group by bill_id""",
    "stock_requests": """
        select q.*, p.medicine_id, p.is_dispensed, m.stock_quantity as room,
               case when not p.is_dispensed then q.quantity end as units
        from {dispense_requests} q join {prescriptions} p on p.rx_id = q.rx_id join {medicines} m on m.medicine_id = p.medicine_id""",
    **admission("hand", "stock_requests", "medicine_id", "units", "room", "0", "rx_id"),
    "stock_after": """
        select m.*, cast(m.stock_quantity - coalesce(h.taken, 0) as int) as stock_left, h.taken is not null as touched
        from {medicines} m left join (
            select s.medicine_id, sum(s.units) as taken from {hand_walk} w join {stock_requests} s on s.request_id = w.request_id
            where w.admitted group by s.medicine_id) h on h.medicine_id = m.medicine_id""",
    "asked_terms": """
        select term_id, term, '%' || regexp_replace(term, '\\\\([^%_\\\\])|(\\\\[%_\\\\])', '\\1\\2', 'g') || '%' as shape
        from {search_terms} where length(trim(term)) >= 2""",
    "registration_clean": """
        select request_id, request_ts,
               case when coalesce(trim(full_name), '') = '' then 'Full Name is required.'
                    when length(trim(full_name)) < 2 then 'Full Name must be at least 2 characters.'
                    when not regexp_matches(trim(full_name), '^[A-Za-z .''-]+$')
                      then 'Full Name can only contain letters, spaces, dots and hyphens.'
                    when date_of_birth is null then 'Date of birth is required.'
                    when date_of_birth >= date '1998-06-15' then 'Date of birth must be in the past.'
                    when (date '1998-06-15' - date_of_birth) // 365 > 120 then 'Age cannot exceed 120 years.'
                    when coalesce(gender, '') not in ('Male', 'Female', 'Other') then 'Gender is required.'
                    when blood_group is null then 'Blood Group is required.'
                    when trim(phone) = '' then 'Phone number is required.'
                    when length(phone) < 10 then 'Phone must be exactly 10 digits. You entered ' || length(phone) || ' digit(s).'
                    when trim(email) <> '' and not regexp_matches(lower(trim(email)), '^[a-z0-9._%+-]+@[a-z0-9.-]+\\.[a-z][a-z]+$')
                      then 'Invalid email format. Example: name@example.com' end as problem,
               case when length(regexp_replace(phone, '[^0-9]', '', 'g')) = 12 and starts_with(regexp_replace(phone, '[^0-9]', '', 'g'), '91')
                    then substr(regexp_replace(phone, '[^0-9]', '', 'g'), 3) else right(regexp_replace(phone, '[^0-9]', '', 'g'), 10) end as phone,
               nullif(lower(trim(email)), '') as email
        from {registration_requests}""",
    "registration_known": """
        select c.*, exists (select 1 from {patients} p where p.phone = c.phone) as phone_known,
               exists (select 1 from {patients} p where p.email = c.email) as email_known
        from {registration_clean} c""",
    "registration_rounds": """
        select request_id, request_ts, phone, email, 'open' as state from {registration_known} where problem is null and not phone_known and not email_known
        union all
        select request_id, request_ts, phone, email,
               case when ready then 'in'
                    when max(case when ready then 1 else 0 end) over (partition by phone) = 1
                      or (email is not null and max(case when ready then 1 else 0 end) over (partition by email) = 1) then 'out'
                    else 'open' end as state
        from (select *, row_number() over (partition by phone order by request_ts, request_id) = 1
                        and (email is null or row_number() over (partition by email order by request_ts, request_id) = 1) as ready
              from registration_rounds where state = 'open') r""",
    "login_line": """
        select user_id, event_id, ts, event_type <> 'error' as succeeded,
               row_number() over (partition by user_id order by ts, event_id) as rn
        from {events} where event_type in ('error', 'signup', 'purchase')""",
    "login_walk": """
        select user_id, cast(0 as bigint) as rn, cast(null as bigint) as event_id, cast(0 as bigint) as failed_attempts,
               cast(null as timestamp) as locked_until, cast(null as timestamp) as ts, cast('' as varchar) as outcome
        from (select distinct user_id from {login_line}) u
        union all
        select s.user_id, s.rn, s.event_id,
               case when w.locked_until > s.ts then w.failed_attempts when s.succeeded then 0 else w.failed_attempts + 1 end,
               case when w.locked_until > s.ts then w.locked_until when s.succeeded then null
                    when w.failed_attempts + 1 >= 5 then s.ts + interval 30 minute end,
               s.ts,
               case when w.locked_until > s.ts then 'locked' when s.succeeded then 'success'
                    when w.failed_attempts + 1 >= 5 then 'lockout' else 'failure' end
        from login_walk w join {login_line} s on s.user_id = w.user_id and s.rn = w.rn + 1""",
}

DERIVED: dict[str, str] = {**VIEWS, **REQUESTS, **_fixed(), **JOBS}


def check_sql(body: str) -> str:
    """A query over {table} names with the tables it needs, each after those it is made from."""
    order: list[str] = []

    def visit(text: str) -> None:
        for name in dict.fromkeys(re.findall(r"\{(\w+)\}", text)):
            if name in DERIVED and name not in order:
                visit(DERIVED[name])
                order.append(name)

    visit(body)
    plain = {name: re.sub(r"\{(\w+)\}", r"\1", DERIVED[name]).strip() for name in order}
    ctes = ", ".join(f"{name} as ({sql})" for name, sql in plain.items())
    text = re.sub(r"\{(\w+)\}", r"\1", body).strip()
    if not ctes:
        return text
    return f"with recursive {ctes} {text}" if not text.startswith("with ") else f"with recursive {ctes}, {text[5:]}"
