"""Hospital tables over a TPC-H-like star schema plus an events table.

Each view is plain arithmetic over whole star tables, in SQL that Spark and other engines read alike;
{name} stands for another view or a star table. Views that join or aggregate the line items, and the
outputs of the billing jobs, are written once per application (see staging) as they would be in a
warehouse; the others stay lazy, so that filters and column choices reach the star scan.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wardline.sources import fixed
from wardline.sources.requests import REQUESTS
from wardline.sources.staging import staged
from wardline.sources.tables import Hospital

STAR_TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")

VIEWS: dict[str, str] = {
    "departments": """
        select cast(n_nationkey as bigint) as dept_id, n_name as dept_name,
               concat('Wing ', cast(n_regionkey as string)) as location
        from {nation}""",
    "doctors": """
        select s_suppkey as doctor_id, s_name as full_name, cast(s_nationkey as bigint) as dept_id,
               concat('Specialty ', cast(s_suppkey % 12 as string)) as specialization,
               cast(7000000000 + s_suppkey * 11 as string) as phone,
               cast(500 + (s_suppkey % 6) * 100 as decimal(10,2)) as opd_fee,
               case when s_suppkey % 10 = 0 then 'On Leave' else 'Active' end as status
        from {supplier}""",
    "insurance": """
        select cast(n_nationkey as bigint) as insurance_id, n_name as provider_name,
               concat('POL-', cast(n_nationkey as string)) as policy_number,
               cast(2000 + n_nationkey * 800 as decimal(12,2)) as coverage_amount,
               date '2000-01-01' + cast(n_nationkey * 30 as int) as expiry_date
        from {nation}""",
    "patients": """
        select c_custkey as patient_id, c_name as full_name,
               date '1930-01-01' + cast((c_custkey * 37) % 23000 as int) as date_of_birth,
               case c_custkey % 3 when 0 then 'Male' when 1 then 'Female' else 'Other' end as gender,
               case c_custkey % 8 when 0 then 'A+' when 1 then 'A-' when 2 then 'B+' when 3 then 'B-'
                    when 4 then 'AB+' when 5 then 'AB-' when 6 then 'O+' else 'O-' end as blood_group,
               cast(6000000000 + c_custkey * 7 as string) as phone,
               case when c_custkey % 5 = 0 then null
                    else concat('p', cast(c_custkey as string), '@mail.example') end as email,
               concat('Street ', cast(c_custkey % 100 as string)) as address,
               case when c_custkey % 4 = 0 then null else cast(c_nationkey as bigint) end as insurance_id,
               date '1995-01-01' + cast((c_custkey * 13) % 2400 as int) as registration_date,
               case when c_custkey % 7 = 0 then 'Discharged' else 'Active' end as status
        from {customer}""",
    "appointments": """
        select o_orderkey as appt_id, o_custkey as patient_id,
               (o_orderkey * 31) % (select count(*) from {supplier}) as doctor_id,
               cast(o_orderdate as date) as appt_date,
               concat(lpad(cast(8 + o_orderkey % 12 as string), 2, '0'),
                      case when o_orderkey % 2 = 0 then ':00:00' else ':30:00' end) as appt_time,
               case o_orderpriority when '1-URGENT' then 'Emergency' when '2-HIGH' then 'IPD' else 'OPD' end as appt_type,
               case when o_orderkey % 11 = 0 then 'Cancelled' when o_orderstatus = 'F' then 'Completed'
                    when o_orderstatus = 'O' then 'Confirmed' else 'Pending' end as status,
               case when o_orderkey % 6 = 0 then concat('note ', cast(o_orderkey as string)) end as notes,
               o_orderdate - interval 72 hour as created_at
        from {orders}""",
    "medicines": """
        select p_partkey as medicine_id, p_name as brand_name, p_type as generic_name, p_brand as category,
               cast((p_partkey * 7919) % 120 as int) as stock_quantity, p_size as reorder_level,
               cast(p_retailprice as decimal(10,2)) as unit_price,
               date '2001-01-01' + cast(p_partkey % 720 as int) as expiry_date
        from {part}""",
    "diagnoses": """
        select appt_id as diag_id, appt_id,
               concat('J', lpad(cast(appt_id % 100 as string), 2, '0')) as icd_code,
               concat('Finding ', cast(appt_id % 100 as string)) as description,
               case appt_id % 3 when 0 then 'Mild' when 1 then 'Moderate' else 'Severe' end as severity,
               created_at + interval 82 hour as diagnosed_at
        from {appointments} where status = 'Completed' and appt_id % 5 <> 0""",
    "rx_lines": """
        select l_orderkey, l_linenumber, l_partkey, l_quantity, l_shipdate, l_returnflag,
               l_orderkey * 1000 + row_number() over (
                 partition by l_orderkey
                 order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_shipdate, l_returnflag) as line_id
        from {lineitem}""",
    "prescriptions": """
        select line_id as rx_id, l_orderkey as diag_id, l_partkey as medicine_id,
               concat(cast(5 * l_linenumber as string), 'mg') as dosage,
               case l_linenumber % 3 when 0 then 'Once daily' when 1 then 'Twice daily' else 'Every 8 hours' end as frequency,
               1 + cast(l_quantity as int) % 14 as duration_days,
               case when l_linenumber % 2 = 0 then 'After food' end as instructions,
               l_shipdate as prescribed_at, l_returnflag = 'R' as is_dispensed
        from {rx_lines} join {diagnoses} on l_orderkey = diag_id""",
    "lab_orders": """
        select line_id as order_id, l_orderkey as appt_id,
               cast(1 + l_linenumber % 6 as bigint) as test_id, l_shipdate as ordered_at,
               case when l_returnflag = 'N' then null
                    else concat(cast(cast(l_quantity as int) as string), ' mg/dL') end as result_value,
               l_returnflag = 'R' as is_abnormal,
               case when l_returnflag = 'N' then 'Pending' else 'Done' end as status,
               case when l_returnflag = 'N' then null else l_shipdate + interval 6 hour end as result_date
        from {rx_lines} join {appointments} on l_orderkey = appt_id
        where status in ('Confirmed', 'Completed')""",
    "users": """
        select cast(n_nationkey as bigint) as user_id, concat('staff_', cast(n_nationkey as string)) as username,
               cast(case n_nationkey % 5 when 0 then 1 else 2 + n_nationkey % 5 end as bigint) as role_id,
               cast(null as bigint) as staff_ref_id, true as is_active, 0 as failed_attempts, date '1998-06-01' as last_login
        from {nation}
        union all
        select 1000 + s_suppkey as user_id,
               case when s_suppkey % 3 = 2 then concat('dr_', lpad(cast(cast(floor(s_suppkey / 10) as bigint) as string), 8, '0'))
                    else concat('Dr_', lower(s_name)) end as username,
               cast(2 as bigint) as role_id,
               case s_suppkey % 3 when 0 then s_suppkey when 1 then null else s_suppkey + 9000000000 end as staff_ref_id,
               s_suppkey % 9 <> 0 as is_active, cast(s_suppkey % 6 as int) as failed_attempts,
               date '1998-06-01' + cast(s_suppkey % 14 as int) as last_login
        from {supplier}""",
    "bill_requests": """
        select appt_id as request_id, appt_id, 100 + appt_id % 5 as generated_by,
               created_at + interval 90 hour as request_ts
        from {appointments} where status = 'Completed' and appt_type <> 'IPD'""",
    "payment_requests": """
        select bill_id * 4 as request_id, bill_id,
               cast(cast(case bill_id % 4 when 1 then cents when 2 then cast((cents - cents % 2) / 2 as bigint)
                         else cast((cents * 6 - (cents * 6) % 10) / 10 as bigint) end as decimal(14,0))
                    * cast('0.01' as decimal(3,2)) as decimal(12,2)) as amount,
               case bill_id % 3 when 0 then 'Cash' when 1 then case when bill_id % 53 = 0 then 'Bitcoin' else 'Card' end
                    else 'UPI' end as payment_mode,
               case bill_id % 41 when 0 then null when 1 then ' ' else concat('TX', cast(bill_id as string)) end as transaction_ref,
               cast(7 as bigint) as received_by, bill_date + interval 1 hour as request_ts
        from (select bill_id, bill_date, cast(net_payable * 100 as bigint) as cents from {new_bills}
              where net_payable > 0) b where bill_id % 4 <> 0
        union all
        select bill_id * 4 + 1, bill_id,
               cast(cast(cast((cents * 6 - (cents * 6) % 10) / 10 as bigint) as decimal(14,0))
                    * cast('0.01' as decimal(3,2)) as decimal(12,2)),
               'Insurance', cast(null as string), cast(8 as bigint), bill_date + interval 30 hour
        from (select bill_id, bill_date, cast(net_payable * 100 as bigint) as cents from {new_bills}
              where net_payable > 0) b where bill_id % 4 in (1, 3)
        union all
        select bill_id * 4 + 2, case when bill_id % 97 = 0 then bill_id + 1000000000 else bill_id end,
               cast(0 as decimal(12,2)), 'Cash', cast(null as string), cast(8 as bigint), bill_date + interval 31 hour
        from {new_bills} where bill_id % 97 = 0 or bill_id % 89 = 0""",
}

# Views written once per application: a shuffle over the line items.
_STAGED_VIEWS = ("prescriptions", "lab_orders")

_hospitals: dict[tuple[str, str], Hospital] = {}


def references(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


def star(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def hospital(spark: SparkSession, sf_dir: str) -> Hospital:
    """The hospital over one star directory; kept per application so that written tables are shared."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _hospitals:
        _hospitals[key] = _build(spark, sf_dir)
    return _hospitals[key]


def _build(spark: SparkSession, sf_dir: str) -> Hospital:
    digest = hashlib.sha1(sf_dir.encode()).hexdigest()[:10]

    def name_of(table: str) -> str:
        return f"{table}-{digest}"

    def view(name: str, sql: str) -> Callable[[], DataFrame]:
        def build() -> DataFrame:
            return spark.sql(sql, **{r: h.table(r) for r in references(sql)})

        if name in _STAGED_VIEWS:
            return lambda: staged(spark, name_of(name), build)
        return build

    done: dict[str, object] = {}

    def billing() -> object:
        if "billing" not in done:
            from wardline.plans.billing import generate_bills

            done["billing"] = generate_bills(h, h.bill_requests, as_of="1998-06-15", existing=None)
        return done["billing"]

    def paying() -> object:
        if "paying" not in done:
            from wardline.plans.payments import record_payments

            done["paying"] = record_payments(h.new_bills, None, h.payment_requests)
        return done["paying"]

    def output(name: str, job: Callable[[], object], part: str) -> Callable[[], DataFrame]:
        return lambda: staged(spark, name_of(name), lambda: getattr(job(), part))

    tables: dict[str, Callable[[], DataFrame]] = {t: (lambda t=t: star(spark, sf_dir, t)) for t in STAR_TABLES}
    tables.update({name: view(name, sql) for name, sql in {**VIEWS, **REQUESTS}.items()})
    tables["roles"] = lambda: fixed.roles(spark)
    tables["lab_tests"] = lambda: fixed.lab_tests(spark)
    tables["grants"] = lambda: fixed.grants(spark)
    tables["new_bills"] = output("new_bills", billing, "bills")
    tables["bill_items"] = output("bill_items", billing, "items")
    tables["bills"] = output("bills", paying, "bills")
    tables["payments"] = output("payments", paying, "payments")
    h = Hospital(spark, tables, sf_dir.rstrip("/"))
    return h
