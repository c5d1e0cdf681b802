"""Batch jobs on hand-made rows, and against sequential rules on random requests."""

import random

import mini
import pytest

from wardline.plans import billing, booking, clinical, payments, pharmacy, registry


def reasons(outcome):
    return {r.request_id: r.reason for r in outcome.rejected.collect()}


@pytest.fixture(scope="module")
def h(spark):
    return mini.build(spark)


@pytest.fixture(scope="module")
def billed(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, appt_id long, generated_by long",
        (1, 0, 1, 7), (2, 1, 1, 7), (3, 2, 3, 7), (4, 3, 77, 7), (5, 4, 2, 7),
    )
    return billing.generate_bills(h, asked, as_of="1998-06-15", existing=None)


def test_bills(billed):
    rows = {r.appt_id: r for r in billed.bills.collect()}
    # 800 fee + 350 + 300 lab + 4*2.50 + 3*8 + 8*2.50 + 1 pharmacy; the expired policy still covers 1000.
    assert (float(rows[1].total_amount), float(rows[1].insurance_covered), float(rows[1].net_payable)) == (1505.0, 1000.0, 505.0)
    # A doctor without a fee charges nothing; no policy covers nothing.
    assert (float(rows[3].total_amount), float(rows[3].net_payable)) == (0.0, 0.0)
    # A policy without an amount covers nothing.
    assert (float(rows[2].total_amount), float(rows[2].insurance_covered)) == (800.0, 0.0)
    assert str(rows[1].due_date) == "1998-06-22"
    assert sorted(r.bill_id for r in rows.values()) == [1, 2, 3]
    assert {r.request_id: r.reason for r in billed.rejected.collect()} == {
        2: "A bill has already been generated for this appointment.", 4: "Appointment not found.",
    }


def test_bill_items_add_up(billed):
    total = {r.bill_id: r["sum(total)"] for r in billed.items.groupBy("bill_id").sum("total").collect()}
    assert total == {r.bill_id: r.total_amount for r in billed.bills.collect()}
    first = [r.service_type for r in billed.items.orderBy("item_id").collect()][:3]
    assert first == ["Consultation", "Lab", "Lab"]


def test_billing_completes_the_appointment(billed):
    assert {r.appt_id: r.status for r in billed.appointments.collect()}[2] == "Completed"


def test_second_run_refuses_billed_appointments(spark, h, billed):
    again = mini.requests(spark, "request_id long, request_ts timestamp, appt_id long, generated_by long", (9, 0, 1, 7), (10, 1, 5, 7))
    after = h.replaced(bills=billed.bills, bill_items=billed.items)
    run = billing.generate_bills(after, again, as_of="1998-06-15", existing=billed.bills)
    assert [r.bill_id for r in run.bills.collect()] == [4]
    assert run.items.agg({"item_id": "min"}).first()[0] == billed.items.count() + 1
    assert [r.request_id for r in run.rejected.collect()] == [9]


def test_payments(spark, billed):
    ids = {r.appt_id: r.bill_id for r in billed.bills.collect()}
    owed, nothing = ids[1], ids[3]
    asked = mini.requests(
        spark, "request_id long, bill_id long, amount decimal(12,2), payment_mode string, transaction_ref string, received_by long, request_ts timestamp",
        (1, owed, "300", "Cash", None, 1, 1), (2, owed, "300", "Cash", None, 1, 2), (3, owed, "0", "Cash", None, 1, 3),
        (4, owed, "205.01", "Card", "T", 1, 4), (5, owed, "0.01", "Cash", None, 1, 5), (6, 999, "5", "Cash", None, 1, 6),
        (7, nothing, "0.02", "Cash", None, 1, 7), (8, nothing, "0.01", "Cash", None, 1, 8), (9, nothing, "-1", "Cash", None, 1, 9),
    )
    run = payments.record_payments(billed.bills, None, asked)
    assert sorted(r.request_id for r in run.payments.collect()) == [1, 4, 8]
    assert {r.request_id: r.reason for r in run.rejected.collect()} == {
        2: "Payment of ₹300.00 would exceed outstanding amount of ₹205.00.",
        3: "Payment amount must be greater than 0.",
        5: "This bill has already been fully paid.",
        6: "Bill not found.",
        7: "Payment of ₹0.02 would exceed outstanding amount of ₹0.00.",
        9: "This bill has already been fully paid.",
    }
    status = {r.bill_id: r.status for r in run.bills.collect()}
    assert status[owed] == "Paid" and status[nothing] == "Paid" and status[ids[2]] == "Unpaid"
    # A later run starts from what has been paid.
    more = mini.requests(
        spark, "request_id long, bill_id long, amount decimal(12,2), payment_mode string, transaction_ref string, received_by long, request_ts timestamp",
        (20, ids[2], "800", "Cash", None, 1, 20), (21, owed, "1", "Cash", None, 1, 21),
    )
    later = payments.record_payments(run.bills, run.payments, more)
    assert [(r.payment_id, r.request_id) for r in later.payments.collect()] == [(4, 20)]
    assert [r.reason for r in later.rejected.collect()] == ["This bill has already been fully paid."]


def test_dispense(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, rx_id long, quantity int",
        (1, 1, 1, 4), (2, 2, 3, 8), (3, 3, 2, 1), (4, 4, 4, 1), (5, 5, 1, 1), (6, 6, 55, 1), (7, 0, 99, 0),
    )
    run = pharmacy.dispense(h, asked)
    assert [(r.request_id, r.stock_after) for r in run.accepted.collect()] == [(1, 6)]
    assert {r.request_id: r.reason for r in run.rejected.collect()} == {
        2: "Cannot dispense 8 units. Only 6 in stock.",
        3: "OUT OF STOCK — cannot dispense.",
        4: "Prescription has already been dispensed.",
        5: "Prescription has already been dispensed.",
        6: "Prescription not found.",
        7: "Prescription not found.",
    }
    assert {r.rx_id: r.is_dispensed for r in run.prescriptions.collect()} == {1: True, 2: False, 3: False, 4: True}
    assert [(r.brand_name, r.stock_quantity) for r in run.warnings.collect()] == [("Crocin", 6)]
    changed = pharmacy.changed_medicines(h.medicines, run.medicines)
    assert [r.message for r in pharmacy.low_stock_alerts(changed).collect()] == ["LOW STOCK ALERT: Crocin has only 6 units left"]


def test_alert_is_strict_by_default(h):
    at_level = h.medicines.filter("medicine_id = 1")
    assert pharmacy.low_stock_alerts(at_level).count() == 0
    assert pharmacy.low_stock_alerts(at_level, strict=False).count() == 1


def test_booking(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, patient_id long, doctor_id long, appt_date date, appt_time string, appt_type string, notes string",
        (1, 5, 1, 1, "1998-06-15", "10:00:00", "OPD", ""), (2, 4, 1, 1, "1998-06-16", "11:00:00", "OPD", " hi "),
        (3, 1, 99, 1, "1998-06-20", "11:00:00", "OPD", ""), (4, 2, 2, 2, "1998-06-20", "11:00:00", "OPD", ""),
        (5, 3, 2, 1, "1998-06-20", "20:00:00", "OPD", ""), (6, 9, 3, 1, "1998-06-16", "11:00:00", "OPD", ""),
        (7, 0, 99, 1, "1998-06-16", "11:00:00", "OPD", ""), (8, 8, 2, 1, "1998-06-20", "08:00:00", "OPD", ""),
    )
    run = booking.book_appointments(h, asked)
    assert {r.request_id: r.appt_id for r in run.accepted.collect()} == {2: 6, 8: 7}
    got = reasons(run)
    assert got[1] == got[6] == "slot conflict: This time slot is already booked for the selected doctor."
    assert got[3] == got[7] == "Patient not found."
    assert got[4] == "Selected doctor is not currently available."
    assert got[5] == "Appointment time must be between 8:00 AM and 8:00 PM."
    image = {r.appt_id: (r.status, r.notes) for r in run.tables["appointments"].collect()}
    assert image[6] == ("Confirmed", "hi") and image[7] == ("Confirmed", None) and len(image) == 7
    assert reasons(booking.book_appointments(h, asked, require_active=True))[8] == "Patient is not active."


def test_cancel(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, appt_id long, reason_text string",
        (1, 1, 2, " not feeling well "), (2, 2, 2, "second try"), (3, 3, 5, "meh"), (4, 4, 5, " "), (5, 5, 1, "too late now"),
    )
    run = booking.cancel_appointments(h, asked)
    assert [r.request_id for r in run.accepted.collect()] == [1]
    assert reasons(run) == {
        2: "Appointment is not open.", 3: "Please give a more detailed reason.", 4: "Cancellation reason required.", 5: "Appointment is not open.",
    }
    assert {r.appt_id: r.notes for r in run.tables["appointments"].collect()}[2] == "not feeling well"
    loose = booking.cancel_appointments(h, asked, strict=False)
    assert sorted(r.request_id for r in loose.accepted.collect()) == [1, 2, 3, 5]
    assert {r.appt_id: r.notes for r in loose.tables["appointments"].collect()}[2] == "second try"


def test_reschedule(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, appt_id long, new_date date, new_time string",
        (1, 1, 2, "1998-06-15", "09:00:00"), (2, 2, 2, "1998-06-18", "20:00:00"), (3, 3, 5, "1998-06-18", "20:00:00"),
        (4, 4, 5, "1998-06-18", "20:30:00"), (5, 5, 5, "1998-06-16", "11:00:00"), (6, 6, 2, "1998-06-15", "10:00:00"), (7, 7, 1, "1998-06-19", "10:00:00"),
    )
    run = booking.reschedule_appointments(h, asked)
    assert sorted(r.request_id for r in run.accepted.collect()) == [2, 5, 6]
    assert reasons(run) == {
        1: "Slot conflict: Doctor already booked at this time", 3: "Slot conflict: Doctor already booked at this time",
        4: "Appointment time must be between 08:00 AM and 08:00 PM.", 7: "Appointment is not open.",
    }
    image = {r.appt_id: (str(r.appt_date), r.appt_time) for r in run.tables["appointments"].collect()}
    assert image[2] == ("1998-06-15", "10:00:00") and image[5] == ("1998-06-16", "11:00:00")


def test_lab_results(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, order_id long, result_value string, is_abnormal boolean",
        (1, 2, 1, " 12 ", "false"), (2, 1, 1, "  ", "true"), (3, 3, 1, "13", "true"), (4, 4, 2, "7", "true"), (5, 0, 1, "x" * 150, "true"),
    )
    run = clinical.apply_lab_results(h, asked)
    image = {r.order_id: r for r in run.tables["lab_orders"].collect()}
    assert (image[1].result_value, image[1].is_abnormal, image[1].status) == ("12", False, "Done")
    assert image[2].result_value == "ok"
    assert sorted(reasons(run)) == [2, 3, 4, 5]
    forced = clinical.apply_lab_results(h, asked, mode="trigger").tables["lab_orders"]
    assert {r.order_id: r.is_abnormal for r in forced.collect()} == {1: True, 2: False}


def test_registration_matches_one_by_one(spark, h):
    rng = random.Random(7)
    rows = []
    for rid in range(400):
        phone = f"98{rng.randint(0, 60):08d}" if rng.random() < 0.5 else f"97{rid:08d}"
        mail = "" if rng.random() < 0.2 else f"U{rng.randint(0, 90)}@Mail.example"
        rows.append((rid, rng.randint(0, 200), "A B", "1990-01-01", "Male", "A+", phone, mail, None, None, None))
    rows.append((900, 0, "A B", "1990-01-01", "Male", "A+", "+91 9000000001", "new@mail.example", None, None, None))
    rows.append((901, 0, "A B", "1990-01-01", "Male", "A+", "9111111111", "RAJ@mail.example", None, None, None))
    phones, mails, expected, why = {"9000000001", "9000000002", "9000000003"}, {"raj@mail.example"}, [], {}
    for r in sorted(rows, key=lambda r: (r[1], r[0])):
        phone, mail = r[6][-10:], r[7].strip().lower()
        if phone in phones:
            why[r[0]] = f"A patient with phone number {phone} already exists."
        elif mail and mail in mails:
            why[r[0]] = f"A patient with email {mail} is already registered."
        else:
            phones.add(phone)
            mails |= {mail} if mail else set()
            expected.append(r[0])
    asked = mini.requests(
        spark,
        "request_id long, request_ts timestamp, full_name string, date_of_birth date, gender string, blood_group string, phone string, "
        "email string, address string, emergency_contact string, insurance_id long",
        *rows,
    ).repartition(5)
    run = registry.register_patients(h, asked)
    numbered = {r.request_id: r.patient_id for r in run.accepted.collect()}
    assert reasons(run) == why
    assert [numbered[r] for r in expected] == list(range(4, 4 + len(expected)))
    assert run.tables["patients"].count() == 3 + len(expected)


def test_insurance(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, provider_name string, policy_number string, coverage_amount decimal(12,2), expiry_date date",
        (1, 1, "Star", "S-1", "5", "2001-01-01"), (2, 3, "Sun", " N-1 ", "9", "2001-01-01"), (3, 2, "Sun", "N-1", "8", "2001-01-01"), (4, 4, "", "N-2", "8", "2001-01-01"),
    )
    run = registry.upsert_insurance(h, asked)
    assert {r.request_id: r.insurance_id for r in run.accepted.collect()} == {1: 1, 2: 3, 3: 3}
    image = {r.policy_number: float(r.coverage_amount or 0) for r in run.tables["insurance"].collect()}
    assert image == {"S-1": 1000.0, "M-1": 0.0, "N-1": 8.0}
    assert reasons(run) == {4: "Insurance provider name required."}


def test_order_of_rows_does_not_matter(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, rx_id long, quantity int", *[(i, 50 - i, 1 + i % 3, 1 + i % 4) for i in range(40)]
    )
    one = sorted(pharmacy.decide_dispense(h, asked.coalesce(1)).select("request_id", "admitted", "reason").collect())
    other = sorted(pharmacy.decide_dispense(h, asked.repartition(7, "quantity")).select("request_id", "admitted", "reason").collect())
    assert one == other


def test_a_refused_request_does_not_close_its_prescription(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, rx_id long, quantity int",
        (1, 1, 1, 11), (2, 2, 1, 0), (3, 3, 1, 3), (4, 4, 1, 1), (5, 5, 3, 8), (6, 6, 3, 7), (7, 7, 3, 0),
    )
    for limit in (0, 1000):
        got = {r.request_id: (r.admitted, r.reason) for r in pharmacy.decide_dispense(h, asked, limit).collect()}
        assert got == {
            1: (False, "Cannot dispense 11 units. Only 10 in stock."),
            2: (False, "Quantity must be at least 1."),
            3: (True, None),
            4: (False, "Prescription has already been dispensed."),
            5: (False, "Cannot dispense 8 units. Only 7 in stock."),
            6: (True, None),
            7: (False, "Prescription has already been dispensed."),
        }


def test_booking_rules_of_the_form(spark, h):
    asked = mini.requests(
        spark, "request_id long, request_ts timestamp, patient_id long, doctor_id long, appt_date date, appt_time string, appt_type string, notes string",
        (1, 1, 1, 1, "1998-06-14", "10:00:00", "OPD", ""), (2, 2, 1, 1, "1999-06-16", "11:00:00", "OPD", ""),
        (3, 3, 1, 1, "1998-06-15", "10:30:00", "OPD", ""), (4, 4, 1, 1, "1998-06-15", "11:00:00", "OPD", ""),
        (5, 5, 1, 1, None, "11:00:00", "OPD", ""), (6, 6, 1, 1, "1998-06-20", None, "OPD", ""),
        (7, 7, 1, 1, "1998-06-20", "11:00:00", "Weird", ""), (8, 8, 1, 1, "1998-06-20", "11:30:00", None, ""),
    )
    run = booking.book_appointments(h, asked, as_of="1998-06-15 08:45:00")
    assert [r.request_id for r in run.accepted.collect()] == [4]
    got = reasons(run)
    assert got[1] == "Appointment date cannot be in the past." and got[2] == "Cannot schedule more than 1 year in advance."
    assert got[3].startswith("For today's appointments, time must be at least 2 hours from now")
    assert got[5] == "Appointment date is required." and got[6] == "Appointment time is required."
    assert got[7] == got[8] == "Unknown appointment type."
    unchecked = reasons(booking.book_appointments(h, asked))
    assert 1 not in unchecked and set(unchecked) == {5, 6, 7, 8}


def test_payments_in_exact_cents_with_mode_and_reference(spark, h):
    bills = spark.createDataFrame([(1, 11.25, "Unpaid")], "bill_id long, net_payable double, status string")
    bills = bills.withColumn("net_payable", bills.net_payable.cast("decimal(12,2)"))
    asked = spark.createDataFrame(
        [(i, 1, 1.13, "Cash", None, 1, i) for i in range(10)]
        + [(20, 1, 0.5, "Bitcoin", "T", 1, -3), (21, 1, 0.5, "Card", " ", 1, -2), (22, 1, 0.5, None, "T", 1, -1)],
        "request_id long, bill_id long, amount double, payment_mode string, transaction_ref string, received_by long, request_ts long",
    )
    got = {r.request_id: (r.admitted, r.reason) for r in payments.decide_payments(bills, None, asked).collect()}
    assert sum(ok for ok, _ in got.values()) == 9 and not got[9][0]
    assert got[20][1] == got[22][1] == "Unknown payment mode."
    assert got[21][1] == "Transaction reference is required for Card payments."
