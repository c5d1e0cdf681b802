"""Merges into stored tables: only touched partitions get new files, and doing one again changes nothing."""

import os

import mini
from pyspark.sql import functions as F

from wardline.plans import booking
from wardline.plans.common import Change
from wardline.sources import partitions
from wardline.sources.partitions import append_parts, merge_change, open_parts, put_in_place, store_parts, with_parts


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(spark, path, name):
    return sorted(map(tuple, open_parts(spark, path, name).collect()), key=str)


def partitions_read(spark, df):
    """Partitions that each parquet scan of a collected frame has read."""
    java = lambda seq: list(spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(seq))
    read, leaves = [], java(df._jdf.queryExecution().executedPlan().collectLeaves())
    while leaves:
        leaf = leaves.pop()
        if "QueryStage" in leaf.nodeName() or leaf.nodeName() == "AdaptiveSparkPlan":
            leaves += java((leaf.plan() if "QueryStage" in leaf.nodeName() else leaf.executedPlan()).collectLeaves())
        elif "parquet" in leaf.nodeName():
            read.append(leaf.metrics().apply("numPartitions").value())
    return read


def year(spark):
    from wardline.sources.tables import load_rows

    made = [
        {"appt_id": i, "patient_id": 1, "doctor_id": 1, "appt_date": f"1998-{1 + i % 12:02d}-{1 + i // 12:02d}", "appt_time": "09:00:00", "appt_type": "OPD", "status": "Confirmed"}
        for i in range(60)
    ]
    return load_rows(spark, "appointments", made)


def test_a_change_of_one_day_rewrites_one_month(spark, tmp_path):
    path, table = str(tmp_path / "appts"), year(spark)
    store_parts(table, path, "appointments")
    h = mini.build(spark, appointments=table)
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, appt_id long, reason_text string", (1, 1, 5, "not well today"), (2, 2, 5, "again"), (3, 3, 999, "nobody")
    )
    outcome = booking.cancel_appointments(h, asked)
    before = files(path)
    assert merge_change(spark, path, "appointments", outcome.changes["appointments"]) == ["1998-06"]
    after = files(path)
    assert {k for k in before if "1998-06" not in k} == {k for k in after if "1998-06" not in k}
    assert all(after[k] == before[k] for k in before if "1998-06" not in k) and not set(before) <= set(after)
    want = sorted(map(tuple, outcome.tables["appointments"].collect()), key=str)
    assert sorted((r[:-1] for r in rows(spark, path, "appointments")), key=str) == want
    once = rows(spark, path, "appointments")
    assert merge_change(spark, path, "appointments", outcome.changes["appointments"]) == ["1998-06"]
    assert rows(spark, path, "appointments") == once


def test_moves_between_months_empty_and_new_ones(spark, tmp_path):
    path, table = str(tmp_path / "appts"), year(spark)
    store_parts(table, path, "appointments")
    # all of March goes to a month that is not there yet, one of May to no date
    moved = table.filter("month(appt_date) = 3").selectExpr("appt_id", "date '1999-02-01' + cast(appt_id as int) as appt_date").unionByName(
        spark.sql("select 4L as appt_id, cast(null as date) as appt_date")
    )
    change = Change(moved, "appt_id", ["appt_date"])
    assert merge_change(spark, path, "appointments", change) == ["1998-03", "1998-05", "1999-02", "1999-03", "none"]
    got = {r["appt_id"]: (str(r["appt_date"]), r["appt_month"]) for r in open_parts(spark, path, "appointments").collect()}
    assert len(got) == 60 and got[4] == ("None", "none") and got[2] == ("1999-02-03", "1999-02")
    assert not [m for _, m in got.values() if m == "1998-03"]
    once = rows(spark, path, "appointments")
    merge_change(spark, path, "appointments", change)
    assert rows(spark, path, "appointments") == once
    assert merge_change(spark, path, "appointments", Change(moved.limit(0), "appt_id", ["appt_date"])) == []


def test_a_merge_that_broke_off_can_be_finished(spark, tmp_path, monkeypatch):
    path, table = str(tmp_path / "appts"), year(spark)
    store_parts(table, path, "appointments")
    change = Change(spark.sql("select 0L as appt_id, date '1998-02-20' as appt_date"), "appt_id", ["appt_date"])
    kept = []
    monkeypatch.setattr(partitions, "put_in_place", lambda *a: kept.append(a))
    merge_change(spark, path, "appointments", change)
    image, *rest = kept[0]
    put_in_place(image.filter("appt_month = '1998-02'"), rest[0], "appointments", ["1998-02"])  # as far as it came
    put_in_place(image, *rest)
    got = [r["appt_month"] for r in open_parts(spark, path, "appointments").filter("appt_id = 0").collect()]
    assert got == ["1998-02"] and open_parts(spark, path, "appointments").count() == 60


def test_buckets_and_appends(spark, tmp_path):
    path, h = str(tmp_path / "patients"), mini.build(spark)
    store_parts(h.patients, path, "patients")
    before = files(path)
    change = Change(spark.sql("select 2L as patient_id, 'Active' as status"), "patient_id", ["status"])
    parts = merge_change(spark, path, "patients", change)
    assert len(parts) == 1 and len(set(before) - set(files(path))) == 1
    assert {r["patient_id"]: r["status"] for r in open_parts(spark, path, "patients").collect()} == {1: "Active", 2: "Active", 3: "Active"}
    held = set(files(path))
    append_parts(h.patients.withColumn("patient_id", h.patients["patient_id"] + 100), path, "patients")
    assert held <= set(files(path)) and open_parts(spark, path, "patients").count() == 6


def test_wanted_months_prune_the_scan_when_the_query_runs(spark, tmp_path):
    from wardline.operators.reports import slot_availability

    path, table = str(tmp_path / "appts"), year(spark)
    store_parts(table, path, "appointments")
    h = with_parts(mini.build(spark), "appointments", path)
    asked = spark.createDataFrame(
        [(1, 1, "1998-06-01", "09:00:00"), (2, 1, "1998-06-01", "10:00:00"), (3, 1, "1998-07-02", "09:00:00"), (4, 1, None, "09:00:00"), (5, 1, "2005-01-01", "09:00:00")],
        "request_id long, doctor_id long, appt_date string, appt_time string",
    ).withColumn("appt_date", F.col("appt_date").cast("date"))
    free = slot_availability(h, asked)
    assert {r["request_id"]: r["available"] for r in free.collect()} == {1: False, 2: True, 3: False, 4: True, 5: True}
    plan = free._jdf.queryExecution().executedPlan().toString()
    assert "dynamicpruning" in plan.lower()
    assert partitions_read(spark, free) == [2]  # of twelve months


def test_booking_and_moves_by_month_equal_those_of_the_plain_table(spark, tmp_path):
    path = str(tmp_path / "appts")
    plain = mini.build(spark)
    store_parts(plain.appointments, path, "appointments")
    stored = with_parts(plain, "appointments", path)
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, patient_id long, doctor_id long, appt_date date, appt_time string, appt_type string, notes string",
        (1, 1, 1, 1, "1998-06-15", "10:00", "OPD", ""), (2, 2, 1, 1, "1998-06-16", " 11:00:00", "OPD", ""), (3, 3, 1, 1, "1998-06-20", "noon", "OPD", ""), (4, 4, 1, 1, "1998-06-20", "9:5", "OPD", ""),
    )
    moves = mini.requests(
        spark, "request_id long, request_ts timestamp, appt_id long, new_date date, new_time string",
        (1, 1, 2, "1998-06-18", "20:00:00"), (2, 2, 5, "1998-06-15", "10:00:00"), (3, 3, 2, None, "10:00:00"), (4, 4, 2, "1998-06-15", None), (5, 5, 2, "1998-06-17", "11:00"), (6, 6, 2, "1998-06-15", "noon"),
    )
    for job, rows in ((booking.book_appointments, asked), (booking.reschedule_appointments, moves)):
        one, other = job(plain, rows), job(stored, rows)
        assert sorted(one.rejected.collect()) == sorted(other.rejected.collect())
        assert sorted(map(str, one.tables["appointments"].collect())) == sorted(map(str, other.tables["appointments"].collect()))
    # the slot that the first move gives up is taken by the second, whose old slot the fifth gets
    assert sorted(r["request_id"] for r in one.accepted.collect()) == [1, 2, 5]
    assert {r["request_id"]: r["reason"] for r in one.rejected.collect()} == {
        3: "Appointment date is required.", 4: "Appointment time is required.", 6: "Appointment time must be given as HH:MM or HH:MM:SS.",
    }


def test_a_changed_row_reads_one_bucket_of_each_image(spark, tmp_path):
    from wardline.operators.audit import image_changes, row_changes
    from wardline.sources.images import differing_buckets, read_image, write_image

    old = year(spark)
    edits = {
        "same": old.repartition(5),
        "one": old.withColumn("notes", F.when(F.col("appt_id") == 7, "seen").otherwise(F.col("notes"))),
        # two columns swap a null and a value: equal to a hash that passes nulls over
        "swap": old.withColumn("appt_type", F.when(F.col("appt_id") == 9, F.lit(None)).otherwise(F.col("appt_type"))).withColumn(
            "notes", F.when(F.col("appt_id") == 9, F.lit("OPD")).otherwise(F.col("notes"))
        ),
        "many": old.filter("appt_id % 5 <> 0").unionByName(old.limit(3).withColumn("appt_id", F.col("appt_id") + 1000)),
    }
    write_image(old, f"{tmp_path}/old", "appt_id", buckets=16)
    for name, new in edits.items():
        write_image(new, f"{tmp_path}/{name}", "appt_id", buckets=16)
        buckets = differing_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/{name}")
        assert len(buckets) == {"same": 0, "one": 1, "swap": 1}.get(name, len(buckets))
        got = image_changes(spark, "appointments", f"{tmp_path}/old", f"{tmp_path}/{name}", as_of="1998-06-15")
        found = sorted(map(str, got.drop("old_values", "new_values").collect()))
        # the plan that drops columns is another frame: this one is collected for its metrics
        got.collect()
        assert all(n <= len(buckets) for n in partitions_read(spark, got))
        want = row_changes("appointments", old, new, as_of="1998-06-15").drop("old_values", "new_values")
        assert found == sorted(map(str, want.collect()))
    assert sorted(map(str, read_image(spark, f"{tmp_path}/old").select(*old.columns).collect())) == sorted(map(str, old.collect()))
