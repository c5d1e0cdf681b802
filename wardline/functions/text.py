"""String helpers that treat white space the way the sanitising rules do (any Unicode space)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The characters that count as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)
_SPACES = r"(?U)[\s\x1c-\x1f]+"


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(value: str | Column) -> Column:
    """Without white space at both ends; no pattern matching, so it may be repeated in a rule."""
    return F.btrim(_column(value), F.lit(WHITE_SPACE))


def without(value: str | Column, characters: str) -> Column:
    """All occurrences of some characters removed."""
    return F.translate(_column(value), characters, "")


def blank(value: str | Column) -> Column:
    """NULL, empty or white space only."""
    return F.coalesce(F.length(strip(value)) == 0, F.lit(True))


def sanitize_string(value: str | Column) -> Column:
    """Collapse inner white space to single spaces; NULL becomes empty."""
    return F.coalesce(strip(F.regexp_replace(_column(value), _SPACES, " ")), F.lit(""))


def sanitize_phone(value: str | Column) -> Column:
    """Digits only, without a leading 91 of twelve digits, at most the last ten."""
    digits = F.regexp_replace(F.coalesce(_column(value), F.lit("")), r"(?U)[^\d]", "")
    local = F.when((F.length(digits) == 12) & digits.startswith("91"), F.substring(digits, 3, 10)).otherwise(digits)
    return F.when(F.length(local) >= 10, F.right(local, F.lit(10))).otherwise(local)


def sanitize_email(value: str | Column) -> Column:
    return F.lower(strip(F.coalesce(_column(value), F.lit(""))))


def blank_to_null(value: str | Column) -> Column:
    return F.when(~blank(value), _column(value))


def plain_pattern(term: Column) -> Column:
    """Substring pattern for a search term; % and _ in the term stay wildcards.

    A backslash takes the next character literally, whatever it is; before a plain character it is left out.
    """
    return F.concat(F.lit("%"), F.regexp_replace(term, r"\\([^%_\\])|(\\[%_\\])", "$1$2"), F.lit("%"))
