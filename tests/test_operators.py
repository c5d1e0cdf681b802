"""Read-side operators on hand-made rows: the behaviours that are easy to get wrong."""

from datetime import date

import mini
import pytest
from pyspark.sql import DataFrameWriter, functions as F

from wardline.functions import rules, text
from wardline.functions.dates import completed_years, years_by_days
from wardline.functions.ordering import with_sequence
from wardline.operators import audit, dashboards, quality, reports, search, trends, visibility, worklists
from wardline.sources.tables import conform, load_rows, select_one, select_rows, shown


@pytest.fixture(scope="module")
def h(spark):
    return mini.build(spark)


def test_age_on_leap_days(spark):
    df = spark.createDataFrame([(date(2000, 2, 29),)], "b date")
    for as_of, years in (("2023-02-28", 22), ("2023-03-01", 23), ("2024-02-28", 23), ("2024-02-29", 24)):
        assert df.select(completed_years("b", as_of)).first()[0] == years
    assert df.select(years_by_days("b", "2023-02-24")).first()[0] == 23


def test_low_stock_includes_the_level(h):
    assert [r.medicine_id for r in reports.low_stock(h).collect()] == [2, 1]


def test_slots(spark, h):
    asked = spark.createDataFrame(
        [(1, date(1998, 6, 15), "10:00:00"), (1, date(1998, 6, 16), "11:00:00"), (9, date(1998, 6, 15), "10:00:00")],
        "doctor_id long, appt_date date, appt_time string",
    )
    got = {(r.doctor_id, str(r.appt_date)): r.available for r in reports.slot_availability(h, asked).collect()}
    assert got == {(1, "1998-06-15"): False, (1, "1998-06-16"): True, (9, "1998-06-15"): True}


def test_daily_activity_keeps_days_of_either_side(h):
    rows = {str(r.day): (r.new_patients, r.appointments) for r in trends.daily_activity(h, as_of="1998-06-15").collect()}
    assert rows["1998-06-15"] == (1, 2) and rows["1998-06-10"] == (1, 0) and rows["1998-06-16"] == (0, 1)
    assert "1998-06-11" not in rows
    filled = trends.fill_days(trends.daily_activity(h, as_of="1998-06-15"), "1998-06-15", 14, {"new_patients": 0, "appointments": 0})
    assert filled.count() == 14


def test_sum_over_nothing(h):
    assert reports.revenue_total(h.payments).first().revenue == 0
    assert trends.revenue_per_day(h, as_of="1998-06-15").count() == 0
    row = dashboards.billing_figures(h, as_of="1998-06-15").first()
    assert (float(row.revenue_today), float(row.outstanding), row.pending_bills) == (0.0, 0.0, 0)
    assert [r.alert for r in dashboards.admin_alerts(h).collect()] == ["Low Stock Medicines", "Pending Lab Orders"]


def test_awaiting_prescription_and_nulls(spark, h):
    assert [r.diag_id for r in worklists.awaiting_prescription(h).collect()] == [2]
    orphan = load_rows(spark, "prescriptions", [{"rx_id": 9, "medicine_id": 1}])
    broken = h.replaced(prescriptions=h.prescriptions.unionByName(orphan))
    assert [r.diag_id for r in worklists.awaiting_prescription(broken).collect()] == [2]
    assert worklists.awaiting_prescription(broken, null_aware=True).count() == 0


def test_all_means_different_things(h):
    day = "1998-06-16"
    assert worklists.appointments_on(h, on=day).count() == 1
    assert worklists.appointments_on(h, on=day, hide_cancelled=True).count() == 0
    assert worklists.appointments_on(h, on="1998-06-15", status="Confirmed", department="Heart").count() == 1


def test_stock_bands(h):
    assert [r.medicine_id for r in worklists.inventory(h, stock="In Stock").collect()] == [3]
    assert [r.medicine_id for r in worklists.inventory(h, stock="Low Stock").collect()] == [1]
    assert [r.medicine_id for r in worklists.inventory(h, stock="Out of Stock").collect()] == [2]
    assert [r.medicine_id for r in worklists.inventory(h, text="PARA", category="Pain").collect()] == [1, 3]
    assert [r.category for r in worklists.categories(h).collect()] == ["Pain"]


def test_search_matches_a_nested_loop(spark, h):
    terms = ["ra", "MIA_", "a%j", "_e_", "%%", "50%", "00000003", "3 ", "2", "zz", "i__50", "RAJ"]
    asked = spark.createDataFrame(list(enumerate(terms)), "term_id long, term string")
    got = {(r.term_id, r.patient_id) for r in search.search_patients(h, asked).collect()}
    people = h.patients.select("patient_id", "full_name", "phone").collect()

    def like(value, pattern):
        return spark.sql("select :v like :p", args={"v": value, "p": pattern}).first()[0]

    expected = {
        (i, p.patient_id)
        for i, term in enumerate(terms)
        if len(term.strip()) >= 2
        for p in people
        if like(p.full_name.lower(), f"%{term}%".lower()) or like(p.phone, f"%{term}%") or str(p.patient_id) == term.strip()
    }
    assert got == expected and len(got) > 8


def test_search_joins_the_first_of_a_pattern_only_and_never_broadcasts_grams(spark, monkeypatch):
    people = spark.range(300).select("id", F.format_string("Ann %09d", "id").alias("name"))
    asked = spark.range(40).select("id", F.lit("%0000%").alias("shape")).withColumnRenamed("id", "term")
    pairs = search.like_pairs(people, "name", asked, "shape", order=[F.col("name")], n=3)
    assert sorted((r.term, r.id) for r in pairs.collect()) == [(t, i) for t in range(40) for i in range(3)]
    one = spark.createDataFrame([("%00000017%",), ("%017%",)], "shape string")
    grams = one.select("shape", search._pattern_grams(F.col("shape")).alias("g")).collect()
    assert {len(g) for r in grams for g in r.g if r.shape == "%00000017%"} == {8}
    for limit, kind in ((search.BROADCAST_PATTERNS, "ResolvedHint (strategy=broadcast)"), (0, "ResolvedHint (strategy=merge)")):
        monkeypatch.setattr(search, "BROADCAST_PATTERNS", limit)
        found = search.like_pairs(people, "name", one, "shape")
        assert kind in found._jdf.queryExecution().analyzed().toString()
        assert {r.id for r in found.collect()} == {17, *range(170, 180)}


def test_user_links(h):
    got = {r.user_id: r.doctor_id for r in search.link_users_to_doctors(h).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: None, 5: None}


def test_visibility(h):
    assert visibility.visible(h, "appointments", role="Lab_Tech").count() == 5
    assert visibility.visible(h, "lab_orders", role="Pharmacist").count() == 0
    assert visibility.visible(h, "appointments", role="Doctor", user_id=1).count() == 4
    assert visibility.visible(h, "prescriptions", role="Doctor", user_id=1).count() == 4
    assert visibility.visible(h, "diagnoses", role="Doctor", user_id=2).count() == 0
    text_of = {(r.role_name, r.table_name): r.privileges for r in visibility.privilege_matrix(h).collect()}
    assert text_of["Receptionist", "patients"] == "INSERT, SELECT, UPDATE"


def test_audit(spark, h):
    new = h.patients.filter("patient_id <> 3").withColumn("email", F.when(F.col("patient_id") == 1, None).otherwise(F.col("email")))
    new = new.unionByName(load_rows(spark, "patients", [{"patient_id": 8, "full_name": "New", "date_of_birth": "1990-01-01", "phone": "1"}]))
    log = audit.row_changes("patients", h.patients, new, as_of="1998-06-15 10:00:00")
    assert {(r.operation, r.record_id) for r in log.collect()} == {("UPDATE", 1), ("DELETE", 3), ("INSERT", 8)}
    fields = {(r.record_id, r.field): (r.old_value, r.new_value) for r in audit.changed_fields(log, "record_id").collect()}
    assert fields[1, "email"] == ("raj@mail.example", None)
    assert fields[8, "full_name"] == (None, "New") and (8, "email") not in fields
    numbered = with_sequence(log, [F.col("record_id")], "log_id").withColumn("changed_by", F.when(F.col("record_id") == 1, 4))
    shown_log = audit.audit_entries(h, numbered, on="1998-06-15", table="patients").collect()
    assert [(r.log_id, r.changed_by) for r in shown_log] == [(3, "System"), (2, "System"), (1, "desk")]
    assert audit.audit_entries(h, numbered, on="1998-06-16").count() == 0


def test_rules(spark):
    cases = [
        (rules.email, ["", None, " A@b.co ", "a@b", "a..b@c.de"], [None, None, None, "Invalid", "Email cannot"]),
        (rules.phone, [" ", "+91 98765-43210", "919876543210", "98x", "123", "1234567890", "(987)654 3210"],
         ["Phone number is", None, None, "Phone number must", "Phone must be exactly 10 digits. You entered 3 digit(s).", "Indian", None]),
        (rules.name, ["A", "O'Neil Jr.", "R2", " ", "x" * 101], ["Name must be at", None, "Name can", "Name is required.", "Name must be under"]),
        (rules.username, ["ab", "9abc", "a b c", " ok_1 "], ["Username must", "Username cannot", "Username can only", None]),
        (rules.amount, [None, "abc", "0", "10000000", "10000000.5", " 12 "],
         ["Amount is required.", "Amount must be a valid", "Amount must be at least ₹0.01.", None, "Amount cannot exceed ₹10,000,000.00.", None]),
        (rules.icd_code, ["j18.9", "A00", "A0", "B20.12345"], [None, None, "Invalid", "Invalid"]),
        (rules.duration_days, ["0", "1", "365", "366", "x", "2.5"], ["Duration must be at", None, None, "Duration cannot", "Duration must be a", "Duration must be a"]),
        (rules.stock_quantity, ["-1", "0", "1000000", "1000001"], ["Stock quantity cannot", None, None, "Stock quantity seems"]),
    ]
    for rule, values, expected in cases:
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
        got = [r.p for r in df.select("i", rule("v").alias("p")).orderBy("i").collect()]
        for value, want, have in zip(values, expected, got):
            assert (have is None) == (want is None) and (have or "").startswith(want or ""), (rule.__name__, value, have)


def test_time_rule(spark):
    df = spark.createDataFrame([(1, "07:59:00"), (2, "08:00:00"), (3, "11:45:00"), (4, "20:00:00"), (5, None)], "i int, v string")
    rule = rules.appointment_time("v", F.lit(date(1998, 6, 15)), "1998-06-15 09:45:30")
    got = {r.i: r.p for r in df.select("i", rule.alias("p")).collect()}
    assert got[1].startswith("Appointments cannot be before") and got[3] is None and got[4].startswith("Appointments cannot be after")
    assert got[2].endswith("(earliest allowed: 11:45 AM).") and got[5] == "Appointment time is required."


def test_sanitisers(spark):
    df = spark.createDataFrame([(" a  b\t", "+91 98765 43210", " X@Y.Z "), (None, "12345", None)], "s string, p string, e string")
    got = df.select(text.sanitize_string("s"), text.sanitize_phone("p"), text.sanitize_email("e")).collect()
    assert [tuple(r) for r in got] == [("a b", "9876543210", "x@y.z"), ("", "12345", "")]


def test_quality_scan_and_constraints(spark, h):
    scan = quality.quality_scan(h.patients, {"email": rules.email("email"), "phone": rules.phone("phone"), "short": rules.name("full_name")})
    assert scan.valid.count() == 2 and scan.quarantined.first().patient_id == 2
    assert {r.rule: r.failures for r in scan.failures.collect()} == {"email": 0, "phone": 0, "short": 1}
    broken = h.replaced(
        appointments=h.appointments.unionByName(
            conform(h.appointments.filter("appt_id = 2").withColumn("appt_id", F.lit(2)).withColumn("doctor_id", F.lit(77)), "appointments")
        )
    )
    found = {(r.rule): r.violations for r in quality.constraint_findings(broken, ["appointments"]).collect()}
    assert found["appt_id unique"] == 1 and found["doctor_id exists in doctors"] == 1 and found["status in allowed values"] == 0


def test_selects(spark, h):
    rows = select_rows(h, "select appt_id from {appointments} where status = :s order by appt_id", ["appointments"], s="Completed")
    assert [r.appt_id for r in rows.collect()] == [1, 3]
    assert select_one(h, "select appt_id from {appointments} where status = :s", ["appointments"], s="No such").count() == 0
    assert shown(h.roles, {"role_name": "Role", "missing": "X", "role_id": "Id"}).columns == ["Role", "Id"]


def test_sequences_are_dense_and_ordered(spark):
    df = spark.range(5000).withColumn("k", F.xxhash64("id")).repartition(9)
    rows = with_sequence(df, [F.col("k")], "n", 10).orderBy("k").collect()
    assert [r.n for r in rows] == list(range(11, 5011))


def test_screening_in_one_pass_equals_the_scan(spark, tmp_path):
    from wardline.operators.quality import quality_scan, screen

    df = spark.createDataFrame([(i, [None, "ann@mail.example", "no"][i % 3], f"{i % 5}") for i in range(100)], "i int, e string, d string").repartition(4)
    checks = {"email": rules.email("e"), "days": rules.duration_days("d")}
    scan, got = quality_scan(df, checks), screen(df, checks, str(tmp_path / "out"))
    assert got.rows == 100 and got.failures == {r["rule"]: r["failures"] for r in scan.failures.collect()}
    assert sorted(map(tuple, got.valid.collect())) == sorted(map(tuple, scan.valid.collect()))
    assert sorted(map(str, got.quarantined.collect())) == sorted(map(str, scan.quarantined.collect()))
    nothing = screen(df.filter("false"), checks, str(tmp_path / "none"))
    assert nothing.rows == 0 and nothing.failures == {"email": 0, "days": 0} and nothing.valid.collect() == []


def test_screening_writes_both_outcomes_without_a_sort(spark, tmp_path, monkeypatch):
    name, at_write, write = "spark.sql.maxConcurrentOutputFileWriters", [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda w, *a, **k: at_write.append(int(spark.conf.get(name))) or write(w, *a, **k))
    before = spark.conf.get(name)
    df = spark.range(100).coalesce(1)
    got = quality.screen(df, {"odd": F.when(F.col("id") % 2 == 1, "odd")}, str(tmp_path / "out"))
    assert at_write == [2] and spark.conf.get(name) == before
    assert (got.valid.count(), got.quarantined.count(), got.failures) == (50, 50, {"odd": 50})
    with pytest.raises(Exception):
        quality.screen(df, {"odd": F.when(F.col("id") % 2 == 1, "odd")}, str(tmp_path / "out"))
    assert spark.conf.get(name) == before


def test_a_value_that_is_no_time_has_its_own_reason(spark):
    df = spark.createDataFrame([(1, "noon"), (2, ""), (3, "9:5"), (4, " 12:30 "), (5, "24:00:00"), (6, "12:60"), (7, "\u0661\u0662:30")], "i int, v string")
    got = {r.i: r.p for r in df.select("i", rules.appointment_time("v", None, "1998-06-15").alias("p")).collect()}
    bad = "Appointment time must be given as HH:MM or HH:MM:SS."
    assert got == {1: bad, 2: "Appointment time is required.", 3: bad, 4: None, 5: bad, 6: bad, 7: bad}
