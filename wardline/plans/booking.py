"""Appointments: book, cancel, move and complete, for whole request tables.

A batch is decided against the appointments as they stand when it starts plus what earlier requests of
the batch, in (request_ts, request_id) order, have done: moves also give up slots for later ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wardline.functions.ordering import first_of, highest, with_sequence
from wardline.functions.dates import AsOf
from wardline.functions.rules import CLOSING_HOUR, OPENING_HOUR, appointment_date, appointment_time, clock, time_form
from wardline.functions.text import blank, strip
from wardline.plans.common import REASON, Change, Outcome, changed, first_failure, known
from wardline.plans.moves import LAST_ROWS, admit_moves
from wardline.sources.partitions import live_slots
from wardline.sources.staging import cut
from wardline.sources.tables import Hospital, conform

# Reason texts and limits.
NO_PATIENT = "Patient not found."
NOT_ACTIVE = "Patient is not active."
NO_DOCTOR = "Selected doctor is not currently available."
HOURS = "Appointment time must be between 8:00 AM and 8:00 PM."
SLOT_TAKEN = "slot conflict: This time slot is already booked for the selected doctor."
MOVE_HOURS = "Appointment time must be between 08:00 AM and 08:00 PM."
MOVE_TAKEN = "Slot conflict: Doctor already booked at this time"
NO_REASON = "Cancellation reason required."
SHORT_REASON = "Please give a more detailed reason."
NOT_OPEN = "Appointment is not open."
NOT_OWN = "Appointment belongs to another doctor."
REASON_MIN = 5
TYPES = ("OPD", "IPD", "Emergency")
NO_TYPE = "Unknown appointment type."
NO_DATE = "Appointment date is required."
SLOT = ["doctor_id", "appt_date", "appt_time"]
ORDER = ["request_ts", "request_id"]


def _open() -> Column:
    return ~F.col("status").isin("Completed", "Cancelled")


def book_appointments(
    h: Hospital, requests: DataFrame, *, as_of: AsOf | None = None, require_active: bool = False
) -> Outcome:
    """requests: request_id, request_ts, patient_id, doctor_id, appt_date, appt_time, appt_type, notes.

    As the rule stands, the patient only has to exist; require_active asks for an active one. With as_of, the
    date may not be past nor over a year ahead, and on the day itself the time is two hours ahead. A date, a
    time and a known type are required always.
    """
    requests = requests.withColumn("appt_time", clock("appt_time"))
    hour = F.substring("appt_time", 1, 2).try_cast("int")
    form = [
        (F.col("appt_date").isNull(), NO_DATE),
        time_form("appt_time"),
        ((hour < OPENING_HOUR) | (hour >= CLOSING_HOUR), HOURS),
    ]
    if as_of is not None:
        form = [appointment_date("appt_date", as_of), appointment_time("appt_time", "appt_date", as_of)]
    patients = h.patients.select("patient_id", F.col("status").alias("_patient"))
    active = h.doctors.filter(F.col("status") == "Active").select("doctor_id", F.lit(True).alias("_active"))
    held = live_slots(h, requests).select(*SLOT).distinct().withColumn("_held", F.lit(True))
    checked = (
        requests.join(patients, "patient_id", "left").join(active, "doctor_id", "left").join(held, SLOT, "left")
    )
    static = first_failure(
        (F.col("_patient").isNull(), NO_PATIENT),
        (F.lit(require_active) & (F.col("_patient") != "Active"), NOT_ACTIVE),
        (F.col("_active").isNull(), NO_DOCTOR),
        *form,
        (~F.coalesce(F.col("appt_type").isin(*TYPES), F.lit(False)), NO_TYPE),
        (F.col("_held").isNotNull(), SLOT_TAKEN),
    )
    checked = cut(checked.withColumn(REASON, static).drop("_patient", "_active", "_held"))
    # One winner per slot by aggregation; winners are marked by request id, so a wanted slot makes no hot join key.
    winners = first_of(checked.filter(F.col(REASON).isNull()), SLOT, ORDER, "request_id")
    decided = known(checked, winners, "request_id", "_won").withColumn(
        REASON, F.coalesce(REASON, F.when(~F.col("_won"), SLOT_TAKEN))
    )
    rejected = decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON)
    accepted = with_sequence(
        decided.filter(F.col(REASON).isNull()).drop(REASON, "_won"),
        [F.col(c) for c in ORDER],
        "appt_id",
        highest(h.appointments, "appt_id"),
    )
    new = conform(
        accepted.withColumn("status", F.lit("Confirmed"))
        .withColumn("created_at", F.col("request_ts"))
        .withColumn("notes", F.when(~blank("notes"), strip("notes"))),
        "appointments",
    )
    columns = h.appointments.columns
    return Outcome(accepted, rejected, {"appointments": h.appointments.unionByName(new.select(*columns))})


def cancel_appointments(h: Hospital, requests: DataFrame, *, strict: bool = True) -> Outcome:
    """requests: request_id, request_ts, appt_id, reason_text.

    strict is the front-desk rule: open appointments only, a reason of at least five characters. Otherwise
    any appointment may be cancelled with any reason, and the last request leaves its note.
    """
    current = h.appointments.select("appt_id", "status")
    checked = requests.join(current, "appt_id", "left")
    text = strip("reason_text")
    checks = [(blank("reason_text"), NO_REASON)]
    if strict:
        checks.append((F.length(text) < REASON_MIN, SHORT_REASON))
        checks.append((F.coalesce(~_open(), F.lit(True)), NOT_OPEN))
    else:
        checks.append((F.col("status").isNull(), NOT_OPEN))
    checked = cut(checked.withColumn(REASON, first_failure(*checks)).drop("status"))
    if strict:
        winners = first_of(checked.filter(F.col(REASON).isNull()), ["appt_id"], ORDER, "request_id")
        checked = known(checked, winners, "request_id", "_won").withColumn(
            REASON, F.coalesce(REASON, F.when(~F.col("_won"), NOT_OPEN))
        )
    accepted = checked.filter(F.col(REASON).isNull()).drop(REASON)
    note = F.max_by(strip("reason_text"), F.struct(*ORDER)).alias("notes")
    changes = accepted.groupBy("appt_id").agg(note).withColumn("status", F.lit("Cancelled"))
    rejected = checked.filter(F.col(REASON).isNotNull()).select("request_id", REASON)
    return changed(accepted, rejected, "appointments", h.appointments, Change(changes, "appt_id", ["status", "notes"]))


def reschedule_appointments(h: Hospital, requests: DataFrame, *, last: int = LAST_ROWS) -> Outcome:
    """requests: request_id, request_ts, appt_id, new_date, new_time (08:00 to 20:00, both included).

    A slot is taken while another live appointment holds it: one that was there from the start and has not been
    moved by an earlier request, or one that an earlier request moved there. An appointment moved twice ends where
    its last accepted move put it.
    """
    current = h.appointments.select("appt_id", "doctor_id", "status")
    checked = requests.join(current, "appt_id", "left").withColumnsRenamed(
        {"new_date": "appt_date", "new_time": "appt_time"}
    ).withColumn("appt_time", clock("appt_time"))
    static = first_failure(
        (F.coalesce(~_open(), F.lit(True)), NOT_OPEN),
        (F.col("appt_date").isNull(), NO_DATE),
        time_form("appt_time"),
        ((F.col("appt_time") < "08:00:00") | (F.col("appt_time") > "20:00:00"), MOVE_HOURS),
    )
    checked = cut(checked.withColumn(REASON, static).drop("status"))
    valid = checked.filter(F.col(REASON).isNull())
    holders = live_slots(h, valid).select("appt_id", *SLOT)
    won = admit_moves(valid, holders, place=SLOT, owner="appt_id", order=ORDER, row_id="request_id", last=last)
    decided = known(checked, won, "request_id", "_won").withColumn(
        REASON, F.coalesce(REASON, F.when(~F.col("_won"), MOVE_TAKEN))
    )
    accepted = decided.filter(F.col(REASON).isNull()).drop(REASON, "_won")
    final = F.max_by(F.struct("appt_date", "appt_time"), F.struct(*ORDER)).alias("_slot")
    changes = accepted.groupBy("appt_id").agg(final).select("appt_id", "_slot.*")
    rejected = decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON)
    return changed(accepted, rejected, "appointments", h.appointments, Change(changes, "appt_id", ["appt_date", "appt_time"]))


def complete_appointments(h: Hospital, requests: DataFrame) -> Outcome:
    """requests: request_id, request_ts, appt_id, doctor_id. A doctor completes own open appointments."""
    current = h.appointments.select("appt_id", "status", F.col("doctor_id").alias("_own"))
    checked = requests.join(current, "appt_id", "left")
    reason = first_failure(
        (F.coalesce(F.col("_own") != F.col("doctor_id"), F.lit(True)), NOT_OWN),
        (~_open(), NOT_OPEN),
    )
    checked = cut(checked.withColumn(REASON, reason).drop("_own", "status"))
    winners = first_of(checked.filter(F.col(REASON).isNull()), ["appt_id"], ORDER, "request_id")
    decided = known(checked, winners, "request_id", "_won").withColumn(
        REASON, F.coalesce(REASON, F.when(~F.col("_won"), NOT_OPEN))
    )
    accepted = decided.filter(F.col(REASON).isNull()).drop(REASON, "_won")
    changes = accepted.select("appt_id", F.lit("Completed").alias("status"))
    rejected = decided.filter(F.col(REASON).isNotNull()).select("request_id", REASON)
    return changed(accepted, rejected, "appointments", h.appointments, Change(changes, "appt_id", ["status"]))
