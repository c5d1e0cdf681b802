"""Validation rules as Column builders: NULL means the value passes, otherwise the message.

Each rule is an ordered list of checks; the first one that fails names the problem. All of it is
built-in expressions, so a scan with many rules stays one pass inside generated code.
"""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, functions as F

from wardline.functions.dates import AsOf, day, shifted, to_datetime, years_by_days
from wardline.functions.text import WHITE_SPACE, blank, strip, without
from wardline.plans.common import first_failure

# Patterns and limits of the rules.
EMAIL_PATTERN = r"^[a-zA-Z0-9._%+\-]+@[a-zA-Z0-9.\-]+\.[a-zA-Z]{2,}$"
EMAIL_MAX = 254
NAME_PATTERN = r"(?U)^[A-Za-z\s.\-']+$"
USERNAME_PATTERN = r"^[a-zA-Z0-9_]+$"
ICD_PATTERN = r"^[A-Z][0-9]{2}(\.[0-9A-Z]{1,4})?$"
AMOUNT_MIN, AMOUNT_MAX = 0.01, 10_000_000
STOCK_MAX = 1_000_000
DAYS_MAX = 365
OPENING_HOUR, CLOSING_HOUR = 8, 20
TIME_PATTERN = r"^([01][0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9])?$"
NO_TIME = "Appointment time is required."
BAD_TIME = "Appointment time must be given as HH:MM or HH:MM:SS."
LEAD_HOURS = 2
TEXT_MAX = 1000
MODES_WITH_REFERENCE = ("Card", "UPI")


def _c(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def email(value: str | Column) -> Column:
    v = F.lower(strip(value))
    return first_failure(
        (blank(value), F.lit(None).cast("string")),
        (~v.rlike(EMAIL_PATTERN), "Invalid email format. Example: name@example.com"),
        (F.length(v) > EMAIL_MAX, "Email is too long (max 254 characters)."),
        (v.contains(".."), "Email cannot contain consecutive dots."),
    )


def phone(value: str | Column) -> Column:
    clean = without(value, WHITE_SPACE + "-+()")
    clean = F.when((F.length(clean) == 12) & clean.startswith("91"), F.substring(clean, 3, 10)).otherwise(clean)
    wrong_length = F.concat(
        F.lit("Phone must be exactly 10 digits. You entered "), F.length(clean).cast("string"), F.lit(" digit(s).")
    )
    return first_failure(
        (blank(value), "Phone number is required."),
        (~clean.rlike(r"(?U)^\d+$"), "Phone number must contain digits only."),
        (F.length(clean) != 10, wrong_length),
        (~F.substring(clean, 1, 1).isin("6", "7", "8", "9"), "Indian mobile numbers must start with 6, 7, 8, or 9."),
    )


def name(value: str | Column, field: str = "Name") -> Column:
    v = strip(value)
    return first_failure(
        (blank(value), f"{field} is required."),
        (F.length(v) < 2, f"{field} must be at least 2 characters."),
        (F.length(v) > 100, f"{field} must be under 100 characters."),
        (~v.rlike(NAME_PATTERN), f"{field} can only contain letters, spaces, dots and hyphens."),
    )


def date_of_birth(value: str | Column, as_of: AsOf) -> Column:
    v = _c(value)
    return first_failure(
        (v.isNull(), "Date of birth is required."),
        (v >= day(as_of), "Date of birth must be in the past."),
        (years_by_days(v, as_of) > 120, "Age cannot exceed 120 years."),
    )


def appointment_date(value: str | Column, as_of: AsOf) -> Column:
    v = _c(value)
    return first_failure(
        (v.isNull(), "Appointment date is required."),
        (v < day(as_of), "Appointment date cannot be in the past."),
        (v > F.lit(shifted(as_of, DAYS_MAX)), "Cannot schedule more than 1 year in advance."),
    )


def time_form(value: str | Column) -> Column:
    """A time of day is given, with two digits for each of its parts."""
    return first_failure((blank(value), NO_TIME), (~strip(value).rlike(TIME_PATTERN), BAD_TIME))


def clock(value: str | Column) -> Column:
    """A well-formed time with its seconds."""
    v = strip(value)
    return F.when(F.length(v) == 5, F.concat(v, F.lit(":00"))).otherwise(v)


def appointment_time(value: str | Column, appt_date: str | Column | None, as_of: AsOf) -> Column:
    """Well-formed and within opening hours; on the as-of day at least two hours ahead, by wall-clock minutes."""
    v = clock(value)
    hour = F.substring(v, 1, 2).try_cast("int")
    checks = [
        time_form(value),
        (hour < OPENING_HOUR, "Appointments cannot be before 8:00 AM."),
        (hour >= CLOSING_HOUR, "Appointments cannot be after 8:00 PM."),
    ]
    if appt_date is not None:
        earliest = to_datetime(as_of) + timedelta(hours=LEAD_HOURS)
        too_soon = (_c(appt_date) == day(as_of)) & (v < F.lit(earliest.strftime("%H:%M:00")))
        text = (
            "For today's appointments, time must be at least 2 hours from now "
            f"(earliest allowed: {earliest.strftime('%I:%M %p')})."
        )
        checks.append((F.coalesce(too_soon, F.lit(False)), text))
    return first_failure(*checks)


def username(value: str | Column) -> Column:
    v = strip(value)
    return first_failure(
        (blank(value), "Username is required."),
        (F.length(v) < 3, "Username must be at least 3 characters."),
        (F.length(v) > 50, "Username must be under 50 characters."),
        (~v.rlike(USERNAME_PATTERN), "Username can only contain letters, numbers and underscores."),
        (F.substring(v, 1, 1).between("0", "9"), "Username cannot start with a number."),
    )


def amount(value: str | Column, field: str = "Amount", least: float = AMOUNT_MIN, most: float = AMOUNT_MAX) -> Column:
    v = _c(value).try_cast("double")
    return first_failure(
        (_c(value).isNull(), f"{field} is required."),
        (v.isNull(), f"{field} must be a valid number."),
        (F.isnan(v), F.lit(None).cast("string")),
        (v < least, f"{field} must be at least ₹{least:.2f}."),
        (v > most, f"{field} cannot exceed ₹{most:,.2f}."),
    )


def icd_code(value: str | Column) -> Column:
    return first_failure(
        (blank(value), "ICD code is required."),
        (~F.upper(strip(value)).rlike(ICD_PATTERN), "Invalid ICD-10 format. Use e.g. J18.9 or A00"),
    )


def text(value: str | Column, field: str = "Field", required: bool = True, max_len: int = TEXT_MAX) -> Column:
    too_long = (F.coalesce(F.length(_c(value)), F.lit(0)) > max_len, f"{field} cannot exceed {max_len} characters.")
    return first_failure((blank(value), f"{field} is required."), too_long) if required else first_failure(too_long)


def dosage(value: str | Column) -> Column:
    return first_failure(
        (blank(value), "Dosage is required (e.g. 500mg, 10ml, 1 tablet)."),
        (F.length(strip(value)) > 50, "Dosage too long (max 50 characters)."),
    )


def duration_days(value: str | Column) -> Column:
    v = _c(value).try_cast("bigint")
    return first_failure(
        (v.isNull(), "Duration must be a whole number."),
        (v < 1, "Duration must be at least 1 day."),
        (v > DAYS_MAX, "Duration cannot exceed 365 days."),
    )


def transaction_ref(value: str | Column, mode: str | Column) -> Column:
    missing = F.coalesce(_c(mode).isin(*MODES_WITH_REFERENCE), F.lit(False)) & blank(value)
    return first_failure(
        (missing, F.concat(F.lit("Transaction reference is required for "), _c(mode), F.lit(" payments.")))
    )


def medicine_name(value: str | Column) -> Column:
    return first_failure(
        (blank(value), "Medicine name is required."),
        (F.length(strip(value)) < 2, "Medicine name must be at least 2 characters."),
        (F.length(strip(value)) > 100, "Medicine name too long."),
    )


def stock_quantity(value: str | Column) -> Column:
    v = _c(value).try_cast("bigint")
    return first_failure(
        (v.isNull(), "Stock quantity must be a whole number."),
        (v < 0, "Stock quantity cannot be negative."),
        (v > STOCK_MAX, "Stock quantity seems too high."),
    )


def insurance_block(provider: str, policy: str, coverage: str) -> Column:
    """All or nothing: once one insurance field is given, the three are required."""
    covered = F.coalesce(F.col(coverage) > 0, F.lit(False))
    given = ~blank(provider) | ~blank(policy) | covered
    return first_failure(
        (given & blank(provider), "Insurance provider name required."),
        (given & blank(policy), "Policy number required."),
        (given & ~covered, "Coverage amount must be greater than 0."),
    )
