"""Database error text to the wording shown to people."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Substring to wording; the first match in this order counts.
WORDING = (
    ("duplicate key value violates unique constraint", "This record already exists. Please check for duplicates."),
    ("violates foreign key constraint", "Cannot complete — a related record is missing."),
    ("violates check constraint", "The value entered is not allowed for this field."),
    ("null value in column", "A required field is missing. Please fill all required fields."),
    ("value too long for type", "One of the fields is too long. Please shorten your input."),
    ("invalid input syntax for type", "Invalid format — please check dates, numbers and special characters."),
    ("slot conflict", "This appointment slot is already taken. Please choose a different time."),
    ("connection refused", "Cannot connect to database. Please ensure PostgreSQL is running."),
    ("already marked", "This record has already been processed."),
    ("insufficient stock", "Not enough stock available for this medicine."),
)
SHOWN_LENGTH = 200


def friendly_error(message: str | Column) -> Column:
    """Known wording, or the first line of the message, cut to a readable length."""
    text = F.col(message) if isinstance(message, str) else message
    first_line = F.substring_index(text, "\n", 1)
    shown = F.when(
        F.length(first_line) > SHOWN_LENGTH, F.concat(F.substring(first_line, 1, SHOWN_LENGTH), F.lit("..."))
    ).otherwise(first_line)
    result = F.concat(F.lit("Database error: "), shown)
    for part, wording in reversed(WORDING):
        result = F.when(F.lower(text).contains(part), F.lit(wording)).otherwise(result)
    return result
