"""Request tables for the batch jobs over the star schema: every order, appointment, prescription or line
makes requests, sound and faulty ones. Same notation as the views in star.py."""

from __future__ import annotations

REQUESTS: dict[str, str] = {
    "registration_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               case o_orderkey % 61 when 0 then ' ' when 1 then 'X' when 2 then 'R2 D2'
                    else concat(' New  Patient ', translate(cast(o_orderkey as string), '0123456789', 'abcdefghij')) end as full_name,
               case o_orderkey % 67 when 0 then null when 1 then date '1999-01-01' when 2 then date '1860-01-01'
                    else date '1960-01-01' + cast(o_orderkey % 9000 as int) end as date_of_birth,
               case when o_orderkey % 71 = 0 then '?' else 'Female' end as gender,
               case when o_orderkey % 73 = 0 then null else 'O+' end as blood_group,
               case when o_orderkey % 79 = 0 then '12345' when o_orderkey % 83 = 0 then ' ' when o_orderkey % 10 = 0 then concat('+91 ', cast(6000000000 + o_custkey * 7 as string))
                    when o_orderkey % 4 = 0 then cast(7000000000 + o_custkey as string)
                    else cast(8000000000 + o_orderkey as string) end as phone,
               case when o_orderkey % 3 = 0 then '' when o_orderkey % 89 = 0 then 'not-an-email'
                    when o_orderkey % 35 = 1 then concat('P', cast(o_custkey as string), '@Mail.example')
                    when o_orderkey % 7 = 0 then concat(' Family', cast(o_custkey as string), '@mail.example')
                    else concat('n', cast(o_orderkey as string), '@mail.example') end as email,
               'Some  street' as address, cast(null as string) as emergency_contact,
               cast(null as bigint) as insurance_id
        from {orders}""",
    "insurance_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               case when o_orderkey % 6 in (1, 2) then ' ' else concat('Provider ', cast(o_custkey % 9 as string)) end as provider_name,
               case o_orderkey % 6 when 0 then concat('POL-', cast(o_orderkey % 25 as string)) when 1 then ''
                    else concat(' NEW-', cast(o_custkey as string)) end as policy_number,
               cast(case when o_orderkey % 13 = 0 or o_orderkey % 6 = 1 then 0 else 1000 + o_orderkey end as decimal(12,2)) as coverage_amount,
               date '2002-01-01' as expiry_date
        from {orders}""",
    "settled_appointments": """
        select * from {appointments} where status <> 'Pending'""",
    "booking_requests": """
        select appt_id as request_id, created_at as request_ts,
               patient_id + case when appt_id % 50 = 0 then 10000000000 else 0 end as patient_id, doctor_id, appt_date,
               case when appt_id % 41 = 0 then 'noon' when appt_id % 53 = 0 then '9:5' when appt_id % 59 = 0 then ' 10:00'
                    when appt_id % 37 <> 0 then concat(lpad(cast(7 + appt_id % 14 as string), 2, '0'), ':00:00') end as appt_time,
               case when appt_id % 43 = 0 then 'Weird' else appt_type end as appt_type,
               case when appt_id % 2 = 0 then ' first visit ' else '' end as notes
        from {appointments} where status = 'Pending'""",
    "cancel_requests": """
        select appt_id * 2 as request_id, created_at as request_ts, appt_id,
               case appt_id % 5 when 0 then '  ' when 1 then 'no' when 2 then ' Patient unwell ' else 'Changed plans' end as reason_text
        from {appointments}
        union all
        select appt_id * 2 + 1, created_at + interval 1 hour, appt_id, 'Second call'
        from {appointments} where appt_id % 9 = 0""",
    "move_requests": """
        select appt_id * 2 as request_id, created_at as request_ts, appt_id,
               appt_date + cast(1 + appt_id % 3 as int) as new_date,
               concat(lpad(cast(7 + appt_id % 15 as string), 2, '0'), ':00:00') as new_time
        from {appointments}
        union all
        select appt_id * 2 + 1, created_at + interval 2 hour, appt_id, appt_date, '10:00:00'
        from {appointments} where appt_id % 4 = 0
        union all
        select appt_id * 2 + 20000000000, created_at + interval 3 hour, appt_id,
               case when appt_id % 2 = 0 then appt_date end, case when appt_id % 3 = 0 then '10:00:00' when appt_id % 5 = 0 then 'noon' end
        from {appointments} where appt_id % 50 = 7 or appt_id % 50 = 8""",
    "chain_requests": """
        select appt_id as request_id,
               case when doctor_id % 3 = 0 then row_number() over (partition by doctor_id order by appt_date, appt_time, appt_id)
                    else row_number() over (partition by doctor_id order by appt_date desc, appt_time desc, appt_id desc) end as request_ts,
               appt_id,
               coalesce(lead(appt_date) over (partition by doctor_id order by appt_date, appt_time, appt_id), date '2001-01-01') as new_date,
               coalesce(lead(appt_time) over (partition by doctor_id order by appt_date, appt_time, appt_id), '09:30:00') as new_time
        from {appointments} where status not in ('Cancelled', 'Completed')""",
    "complete_requests": """
        select appt_id as request_id, created_at as request_ts, appt_id,
               doctor_id + case when appt_id % 7 = 0 then 1 else 0 end as doctor_id
        from {appointments}""",
    "dispense_requests": """
        select rx_id * 4 as request_id, prescribed_at + interval 1 hour as request_ts, rx_id,
               duration_days + cast(rx_id % 3 as int) - 1 as quantity
        from {prescriptions}
        union all
        select rx_id * 4 + 1, prescribed_at + interval 2 hour, rx_id, 1
        from {prescriptions} where rx_id % 11 = 0
        union all
        select rx_id * 4 + 2, prescribed_at, rx_id + 1000000000000, 1
        from {prescriptions} where rx_id % 101 = 0
        union all
        select rx_id * 4 + 3, prescribed_at, rx_id, case when rx_id % 2 = 0 then 0 else 115 end
        from {prescriptions} where rx_id % 7 = 0""",
    "restock_requests": """
        select line_id as request_id,
               l_partkey + case when l_orderkey % 400 = 0 then 10000000000 else 0 end as medicine_id,
               cast(l_quantity as int) - 2 as quantity
        from {rx_lines}""",
    "lab_result_requests": """
        select order_id as request_id, ordered_at + interval 5 hour as request_ts, order_id,
               case order_id % 7 when 0 then '  ' when 1 then repeat('9', 120) when 2 then repeat('9', 220)
                    else concat(' ', cast(order_id % 50 as string), ' mg/dL ') end as result_value,
               order_id % 4 = 0 as is_abnormal
        from {lab_orders}""",
    "diagnosis_requests": """
        select appt_id as request_id, created_at + interval 84 hour as request_ts,
               appt_id + case when appt_id % 60 = 0 then 10000000000 else 0 end as appt_id,
               case appt_id % 6 when 0 then '' when 1 then 'j18.9' when 2 then 'X1' when 3 then ' a00 '
                    when 4 then 'B20.12345' else 'C50.1A' end as icd_code,
               case when appt_id % 10 = 0 then ' ' else concat(' some  finding ', cast(appt_id as string)) end as description,
               case when appt_id % 8 = 0 then 'Unknown' else 'Mild' end as severity
        from {appointments}""",
    "prescription_requests": """
        select diag_id as request_id, diagnosed_at as request_ts, diag_id,
               case when diag_id % 40 = 0 then 10000000000 else diag_id % (select count(*) from {part}) end as medicine_id,
               case diag_id % 9 when 0 then '' when 1 then repeat('x', 51) else ' 500mg ' end as dosage,
               case when diag_id % 11 = 0 then 'Hourly' else 'Twice daily' end as frequency,
               cast(diag_id % 380 as string) as duration_days,
               case when diag_id % 2 = 0 then ' ' else ' with water ' end as instructions
        from {diagnoses}""",
    "lab_order_requests": """
        select appt_id as request_id, created_at as request_ts,
               appt_id + case when appt_id % 60 = 0 then 10000000000 else 0 end as appt_id,
               cast(1 + appt_id % 7 as bigint) as test_id
        from {appointments}""",
    "medicine_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               case when o_orderkey % 8 = 0 then 'RED WIDGET' when o_orderkey % 31 = 0 then ' m '
                    when o_orderkey % 2 = 0 then concat('Med ', cast(o_custkey as string))
                    else concat('med ', cast(o_custkey as string)) end as brand_name,
               case when o_orderkey % 8 = 0 then 'Economy' else concat('Generic ', cast(o_custkey % 5 as string)) end as generic_name,
               case when o_orderkey % 17 = 0 then '' else 'Antacid' end as category,
               cast(o_orderkey % 900 as int) as stock_quantity,
               cast(o_orderkey % 60 as int) as reorder_level,
               cast(o_orderkey % 50 as decimal(10,2)) as unit_price, date '2003-01-01' as expiry_date
        from {orders}""",
    "patient_update_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               o_custkey + case when o_orderkey % 70 = 0 then 10000000000 else 0 end as patient_id,
               case o_orderkey % 6 when 0 then cast(6000000000 + o_custkey * 7 as string) when 1 then '12345'
                    when 2 then cast(6000000000 + (o_custkey - o_custkey % 25 + (o_custkey + 1) % 25) * 7 as string)
                    else concat('+91-', cast(9000000000 + (o_custkey - o_custkey % 25) * 40 + o_orderkey % 300 as string)) end as phone,
               case o_orderkey % 4 when 0 then '' when 1 then 'bad@' else concat('New', cast(o_custkey as string), '@Mail.example') end as email,
               case when o_orderkey % 3 = 0 then ' ' else concat('House  ', cast(o_orderkey as string)) end as address,
               ' Kin  1 ' as emergency_contact,
               case when o_orderkey % 2 = 0 then 'Active' else 'Discharged' end as status
        from {orders}""",
    "doctor_update_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               (o_orderkey * 17) % (2 + (select count(*) from {supplier})) as doctor_id,
               cast(o_orderkey % 1500 - 20 as decimal(10,2)) as opd_fee,
               case o_orderkey % 5 when 0 then 'Inactive' when 1 then 'Retired' when 2 then 'On Leave' else 'Active' end as status
        from {orders}""",
    "account_update_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               1000 + (o_orderkey * 13) % (2 + (select count(*) from {supplier})) as user_id,
               o_orderkey % 2 = 0 as is_active,
               1000 + o_orderkey % (select count(*) from {supplier}) as by_user
        from {orders}""",
    "user_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               case o_orderkey % 10 when 0 then 'STAFF_1' when 1 then 'ab' when 2 then '9lives' when 3 then 'has space'
                    when 4 then concat('User_', cast(o_custkey as string))
                    else concat('user_', cast(o_custkey as string)) end as username,
               cast(1 + o_orderkey % 7 as bigint) as role_id
        from {orders}""",
    "doctor_requests": """
        select o_orderkey as request_id, o_orderdate as request_ts,
               case when o_orderkey % 9 = 0 then 'Dr 7' else ' Dr.  New  Name ' end as full_name,
               o_orderkey % 30 as dept_id, case when o_orderkey % 12 = 0 then '' else 'Cardiologist' end as specialization,
               'MBBS' as qualification,
               case when o_orderkey % 7 = 0 then '98765' else concat('98', lpad(cast(o_orderkey as string), 8, '0')) end as phone,
               case when o_orderkey % 5 = 0 then 'nope' else '' end as email,
               cast(800 as decimal(10,2)) as opd_fee
        from {orders}""",
    "search_terms": """
        select s_suppkey as term_id,
               case s_suppkey % 4 when 0 then concat('MER#', right(s_name, 9)) when 1 then cast(6000000000 + s_suppkey * 7 as string)
                    when 2 then cast(s_suppkey as string) when 3 then case s_suppkey % 3 when 0 then concat('Custo', chr(92), 'mer#', right(s_name, 4))
                        when 1 then concat('%', right(s_name, 3), '%') else concat(right(s_name, 2), chr(92), '%') end end as term
        from {supplier}""",
    "slot_requests": """
        select appt_id as request_id, doctor_id, appt_date + cast(appt_id % 2 as int) as appt_date, appt_time
        from {appointments}""",
    "intake": """
        select c_custkey as row_id,
               case c_custkey % 9 when 0 then null when 1 then '' when 2 then concat('u', cast(c_custkey as string), '@mail.example')
                    when 3 then concat(' U', cast(c_custkey as string), '@Mail.Example ') when 4 then concat('u..', cast(c_custkey as string), '@mail.example')
                    when 5 then concat('u', cast(c_custkey as string), '@mail') when 6 then concat(repeat('x', 250), '@mail.example')
                    when 7 then 'no at sign' else concat('a+b_', cast(c_custkey as string), '@sub.mail.example') end as email,
               case c_custkey % 9 when 0 then null when 1 then '  ' when 2 then concat('+91 98', lpad(cast(c_custkey as string), 8, '0'))
                    when 3 then concat('(98) ', lpad(cast(c_custkey as string), 8, '0')) when 4 then concat('12', lpad(cast(c_custkey as string), 8, '0'))
                    when 5 then '98-76' when 6 then 'call me' when 7 then concat('91', lpad(cast(c_custkey as string), 10, '7'))
                    else concat('98765', cast(c_custkey as string)) end as phone,
               case c_custkey % 8 when 0 then null when 1 then 'A' when 2 then concat('Dr. O''Neil-', 'Smith') when 3 then 'R2 D2'
                    when 4 then repeat('ab', 60) when 5 then '   ' when 6 then ' Jane   Doe ' else c_name end as full_name,
               case c_custkey % 7 when 0 then null when 1 then date '1998-06-15' when 2 then date '2001-01-01' when 3 then date '1860-01-01'
                    else date '1930-01-01' + cast((c_custkey * 37) % 23000 as int) end as date_of_birth,
               case c_custkey % 6 when 0 then null when 1 then date '1998-06-14' when 2 then date '1998-06-15' when 3 then date '1999-06-15'
                    when 4 then date '1999-06-16' else date '1998-06-15' + cast(c_custkey % 400 as int) end as visit_date,
               case when c_custkey % 13 = 0 then null when c_custkey % 31 = 0 then 'noon' when c_custkey % 37 = 0 then ' '
                    when c_custkey % 41 = 0 then '9:5' when c_custkey % 43 = 0 then '24:00:00' when c_custkey % 47 = 0 then ' 12:30'
                    else concat(lpad(cast(c_custkey % 24 as string), 2, '0'),
                    case when c_custkey % 2 = 0 then ':00:00' else ':30:00' end) end as visit_time,
               case c_custkey % 8 when 0 then null when 1 then 'ab' when 2 then '9lives' when 3 then 'has space' when 4 then repeat('u', 51)
                    when 5 then ' padded_name ' else concat('user_', cast(c_custkey as string)) end as username,
               case c_custkey % 8 when 0 then null when 1 then '0' when 2 then '0.01' when 3 then 'ten' when 4 then '10000000.01'
                    when 5 then '-5' when 6 then '10000000' else cast(c_acctbal as string) end as amount,
               case c_custkey % 7 when 0 then null when 1 then 'J18.9' when 2 then 'a00' when 3 then ' b20.1234 ' when 4 then 'B20.12345'
                    when 5 then 'J1' else concat('C', lpad(cast(c_custkey % 100 as string), 2, '0')) end as icd_code,
               case c_custkey % 6 when 0 then null when 1 then ' ' when 2 then repeat('t', 1001) when 3 then repeat('t', 1000)
                    else 'plain   text' end as remark,
               case c_custkey % 5 when 0 then null when 1 then '' when 2 then repeat('m', 51) else concat(cast(c_custkey as string), 'mg') end as dosage,
               case c_custkey % 8 when 0 then null when 1 then '0' when 2 then '366' when 3 then '365' when 4 then 'week' when 5 then '-3'
                    when 6 then '2.5' else cast(c_custkey % 365 as string) end as duration_days,
               case c_custkey % 4 when 0 then 'Cash' when 1 then 'Card' when 2 then 'UPI' else 'Insurance' end as payment_mode,
               case c_custkey % 3 when 0 then null when 1 then ' ' else concat('TX', cast(c_custkey as string)) end as transaction_ref,
               case c_custkey % 5 when 0 then null when 1 then 'x' when 2 then repeat('m', 101) else c_name end as medicine_name,
               case c_custkey % 7 when 0 then null when 1 then '-1' when 2 then '1000001' when 3 then '1000000' when 4 then 'many'
                    else cast(c_custkey as string) end as stock_quantity,
               case when c_custkey % 3 = 0 then '' else 'Star' end as provider_name,
               case when c_custkey % 4 = 0 then ' ' else concat('P-', cast(c_custkey as string)) end as policy_number,
               cast(case when c_custkey % 5 < 2 then 0 else 1000 end as decimal(12,2)) as coverage_amount
        from {customer}""",
    "error_log": """
        select event_id,
               case event_id % 14 when 0 then 'ERROR: duplicate key value violates unique constraint "patients_phone_key"'
                    when 1 then 'insert violates foreign key constraint' when 2 then 'new row violates check constraint "chk_net"'
                    when 3 then 'null value in column "phone"' when 4 then 'value too long for type character varying(100)'
                    when 5 then 'invalid input syntax for type date' when 6 then 'Slot Conflict: doctor booked; duplicate key value violates unique constraint'
                    when 7 then 'slot conflict here' when 8 then 'Connection refused' when 9 then 'order already marked done'
                    when 10 then 'insufficient stock' when 11 then concat('odd failure ', cast(event_id as string))
                    when 12 then concat(repeat('long ', 50), cast(event_id as string)) else concat(event_type, chr(10), 'second line') end as message
        from {events}""",
}
