"""Plans stay what they should be: filters at the scan, reduction before the shuffle, no nested loops."""

import os
import re

import pytest
from pyspark.sql import functions as F

from wardline.operators import audit, reports, search, trends, visibility, worklists
from wardline.sources.sinks import write_snapshot
from wardline.sources.staging import shared_folder
from wardline.sources.star import hospital
from wardline.sources.tables import conform, open_hospital, scan

FOLDER = f"{os.environ.get('TESTDATA', '/root/testdata')}/sf0.001"
AS_OF = "1998-06-15"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def h(spark):
    return hospital(spark, FOLDER)


def plan(df):
    df.sparkSession.conf.set("spark.sql.maxMetadataStringLength", "10000")
    return df._jdf.queryExecution().executedPlan().toString()


def test_filters_reach_the_scan(h):
    text = plan(reports.opd_queue(h, as_of=AS_OF))
    assert "GreaterThanOrEqual(o_orderdate,1998-06-15T00:00)" in text and "LessThan(o_orderdate,1998-06-16T00:00)" in text
    assert "GreaterThanOrEqual(payment_date,1998-05-17T00:00)" in plan(trends.revenue_per_day(h, as_of=AS_OF))


def test_columns_are_pruned(h):
    read = re.findall(r"ReadSchema: (struct<[^>]*>)", plan(trends.bills_per_status(h)))
    assert read == ["struct<net_payable:decimal(12,2),status:string>"]


def test_top_k_is_cut_before_the_shuffle(h):
    for df in (worklists.upcoming_per_doctor(h, as_of=AS_OF), worklists.recent_results_per_doctor(h), worklists.visit_history(h)):
        text = plan(df)
        assert re.search(r"WindowGroupLimit .* Partial", text)
    assert "TakeOrderedAndProject" in plan(worklists.recent_bills(h))


def test_payments_are_reduced_before_the_join(h):
    text = plan(reports.billing_summary(h))
    assert "partial_sum(amount_paid" in text and text.index("Join") < text.index("partial_sum")


def test_no_nested_loops(h):
    frames = [
        search.search_patients(h, h.search_terms),
        search.link_users_to_doctors(h),
        visibility.own_rows(h, "prescriptions", "rx_id"),
        worklists.awaiting_prescription(h),
        worklists.awaiting_bill(h),
        audit.row_changes("bills", h.new_bills, h.bills, as_of=AS_OF),
    ]
    for df in frames:
        assert not re.search("NestedLoop|Cartesian", plan(df))


def test_months_are_pruned(spark, h):
    path = write_snapshot(conform(h.appointments, "appointments"), f"{shared_folder(spark)}/plans", "appointments", "one")
    df = spark.read.parquet(path).filter(F.col("appt_month") == "1998-06")
    assert "PartitionFilters: [isnotnull(appt_month" in plan(df)
    assert df.count() == h.appointments.filter("appt_date >= '1998-06-01' and appt_date < '1998-07-01'").count()


def test_scans_by_schema(spark, h):
    root = f"{shared_folder(spark)}/scans"
    conform(h.patients, "patients").write.mode("overwrite").parquet(f"{root}/patients")
    assert open_hospital(spark, root).patients.count() == h.patients.count()
    assert scan(spark, root, "patients").schema["registration_date"].dataType.typeName() == "timestamp_ntz"
