"""Lenient text parsing; a value that cannot be read becomes null, never an error."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens a CSV reader treats as missing.
NA_VALUES = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def squash(c: Column | str) -> Column:
    """Strip every kind of white space from both ends (``trim`` alone knows only blanks)."""
    return F.btrim(_col(c), F.lit(WHITE_SPACE))


def parse_amount(c: Column | str) -> Column:
    """Keep digits, point and minus, then read a number.

    ``$1,234.00`` is 1234, ``(100)`` is 100, ``1e5`` is 15; ``1-2``, ``.`` and
    text are null.
    """
    return F.regexp_replace(_col(c), r"[^0-9.\-]", "").try_cast("double")


def _iso(s: Column, marks: str, month_first: bool) -> Column:
    """Text with a leading ``aa?bb?yyyy`` in ISO order; any other text unchanged."""
    return F.regexp_replace(s, rf"^(\d\d?)([{marks}])(\d\d?)\2(\d{{4}})", "$4-$1-$3" if month_first else "$4-$3-$1")


_MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
_CLOCK = r"(?i)^(.*?)(\d\d?)(:\d\d(?::\d\d)?) ?([ap])\.?m\.?$"


def _named_month(s: Column) -> Column:
    """``Jan 5 2026``, ``January 5, 2026`` and ``5 Jan 2026`` in ISO order; any other text unchanged."""
    out = s
    for i, name in enumerate(_MONTHS, 1):
        out = F.regexp_replace(out, rf"(?i)^{name}[a-z]*\.? (\d\d?),? (\d{{4}})", f"$2-{i:02d}-$1")
        out = F.regexp_replace(out, rf"(?i)^(\d\d?)[ -]{name}[a-z]*\.?,?[ -](\d{{4}})", f"$2-{i:02d}-$1")
    return F.when(s.rlike("(?i)[a-z]{3}"), out).otherwise(s)


def _twelve_hours(s: Column) -> Column:
    """A closing AM or PM clock as hours of the day; any other text unchanged."""
    hour = F.regexp_extract(s, _CLOCK, 2).try_cast("int")
    day_hour = F.pmod(hour, F.lit(12)) + F.when(F.lower(F.regexp_extract(s, _CLOCK, 4)) == "p", 12).otherwise(0)
    return F.when(s.rlike(_CLOCK) & hour.between(1, 12), F.concat(
        F.regexp_extract(s, _CLOCK, 1), day_hour.cast("string"), F.regexp_extract(s, _CLOCK, 3))).otherwise(s)


def parse_ts(c: Column | str, day_first: bool = False) -> Column:
    """Read ISO text with a blank or a T, month-first dates with slashes, dashed dates, year-first slashes and month names.

    Fields may have one digit, and the clock AM or PM.

    ``05-01-2026`` is ambiguous. The default takes the month first and falls
    back to the day when that is impossible, which is what a lenient date
    parser does; ``day_first=True`` is the layout the exports are written in.

    The text is rearranged to ISO order and cast: the cast is many times
    faster than pattern parsers, above all on text they reject.
    """
    s = _twelve_hours(_named_month(squash(c)))
    s = F.regexp_replace(s, r"^(\d{4})/(\d\d?)/(\d\d?)", "$1-$2-$3")
    usual = _iso(_iso(s, "/", True), "-", not day_first)
    other = _iso(_iso(s, "/", False), "-", day_first)
    return F.coalesce(usual.try_cast("timestamp"), other.try_cast("timestamp"))


def parse_date(c: Column | str) -> Column:
    """Date from text, day first, unreadable values null."""
    s = squash(c)
    return F.coalesce(_iso(s, "/-", False).try_cast("date"), _iso(s, "/-", True).try_cast("date"))


def normalise_code(c: Column | str) -> Column:
    """Trimmed upper-case code; null stays null."""
    return F.upper(squash(c))


def snake(name: str) -> str:
    """Column name of an upload: blanks to underscores, lower case."""
    return name.replace(" ", "_").lower()
