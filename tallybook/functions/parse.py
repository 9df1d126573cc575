"""Expressions that turn text into dates and signed money.

Each parser yields NULL for text it cannot read. ``or_fail`` turns that NULL
into an error naming the value; callers that quarantine keep the NULL.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallybook.functions.text import strip
from tallybook.schema import MONEY

# Tried in order; the first that fits the whole text wins.
MONTH_FIRST = (
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "M/d/yyyy",
    "M/d/yy",
    "M-d-yyyy",
    "d-MMM-yyyy",
    "d MMM yyyy",
    "MMM d, yyyy",
    "MMM d yyyy",
    "MMMM d, yyyy",
    "d MMMM yyyy",
    "yyyyMMdd",
    "yyyy.MM.dd",
    "d MMM yy",
)
DAY_FIRST = (
    "d/M/yy",
    "d/M/yyyy",
    "yyyy-MM-dd",
    "d-M-yyyy",
    "d-M-yy",
    "d.M.yyyy",
    "d-MMM-yyyy",
    "d-MMM-yy",
    "d MMM yyyy",
    "d MMMM yyyy",
)

# Numbers written with a power of ten; how many digits they have shows only in their value.
_POWER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)[eE][+-]?[0-9]+$"
_UNSIGNED = r"^[0-9]+\.?[0-9]*$"


# A time of day after a date, with fraction, half of the day and zone; the date counts as written.
_TIME = (
    r"[T ] ?([01]?[0-9]|2[0-3]):[0-5][0-9](:[0-5][0-9]([.,][0-9]+)?)?( ?[AaPp][Mm])?"
    r"( ?(Z|UTC|[+-][0-9]{2}:?[0-9]{2}))?$"
)

# What the letters of a format stand for, longest first.
_LETTERS = (
    ("yyyy", "[0-9]{4}"),
    ("yy", "[0-9]{2}"),
    ("MMM", r"\p{L}+\.?"),
    ("MM", "[0-9]{2}"),
    ("M", "[0-9]{1,2}"),
    ("dd", "[0-9]{2}"),
    ("d", "[0-9]{1,2}"),
    ("HH", "[0-9]{2}"),
    ("mm", "[0-9]{2}"),
    ("ss", "[0-9]{2}"),
)


def format_shape(fmt: str) -> str:
    """Regular expression for texts that a date format may fit."""
    parts = []
    for found in re.finditer(r"'([^']*)'|([a-zA-Z])\2*|.", fmt):
        token = found.group(0)
        if found.group(1) is not None:
            parts.append(re.escape(found.group(1)))
        elif found.group(2) is not None:
            parts.append(next((p for x, p in _LETTERS if token.startswith(x)), ".+"))
        else:
            parts.append(re.escape(token))
    return "^" + "".join(parts) + "$"


def default_pivot_year() -> int:
    return datetime.date.today().year + 50


def day_text(text: Column) -> Column:
    """Without white space around, time of day, or the long form of September's short name."""
    clean = strip(text)
    # The test looks at the text as it came, so that a row is stripped once.
    timeless = F.when(F.contains(text, F.lit(":")), F.regexp_replace(clean, _TIME, "")).otherwise(clean)
    return F.replace(timeless, F.lit("Sept "), F.lit("Sep "))


def _numeric_day(clean: Column, fmt: str) -> Column | None:
    """``clean``, of the shape of a format of digits only, as a date; None for other formats.

    A cast of yyyy-MM-dd costs a small part of what Spark's parser for formats takes.
    """
    if fmt == "yyyyMMdd":
        parts = {"yyyy": F.substring(clean, 1, 4), "MM": F.substring(clean, 5, 2), "dd": F.substring(clean, 7, 2)}
    else:
        names = re.findall("[a-zA-Z]+", fmt)
        between = set(re.findall("[^a-zA-Z]+", fmt))
        known = {"yyyy", "yy", "MM", "M", "dd", "d"}
        if sorted(n[0] for n in names) != ["M", "d", "y"] or not known.issuperset(names) or len(between) != 1 or not between <= set("/-."):
            return None
        parts = {n: F.split_part(clean, F.lit(*between), F.lit(i)) for i, n in enumerate(names, 1)}
    part = {n[0]: p for n, p in parts.items()}
    year = part["y"] if "yyyy" in parts else F.concat(F.lit("20"), part["y"])
    return F.concat_ws("-", year, part["M"], part["d"]).try_cast("date")


def read_day(clean: Column, fmt: str, pivot_year: int | None = None) -> Column:
    """The date that ``clean`` (from ``day_text``) writes in one format; NULL if it does not fit.

    A format is tried only on texts of its shape: a failed attempt costs an
    exception inside Spark, many times the price of the test. Two-digit years
    at or past the pivot go back a century.
    """
    numeric = _numeric_day(clean, fmt)
    day = F.when(clean.rlike(format_shape(fmt)), F.try_to_date(clean, fmt) if numeric is None else numeric)
    if "yy" in fmt and "yyyy" not in fmt:
        pivot = default_pivot_year() if pivot_year is None else pivot_year
        # The day itself stands here once, as a repeated expression is worked out again.
        days = F.transform(F.array(day), lambda d: F.when(F.year(d) >= pivot, F.add_months(d, -1200)).otherwise(d))
        day = F.get(days, F.lit(0))
    return day


def read_any_day(clean: Column, formats: Sequence[str], pivot_year: int | None = None) -> Column:
    """The first format that fits. ``clean`` is best a column of its own, which is then worked out once."""
    return F.coalesce(*[read_day(clean, fmt, pivot_year) for fmt in formats])


def parse_date(
    text: Column, formats: Sequence[str] = MONTH_FIRST, pivot_year: int | None = None
) -> Column:
    """First format that fits; a time of day behind it is dropped."""
    return read_any_day(day_text(text), formats, pivot_year)


def bare_number(text: Column) -> Column:
    """Without currency symbols, commas and white space around."""
    return strip(F.translate(text, "£$€₹,", ""))


def _number(s: Column, dtype: str) -> Column:
    """The number that ``s`` writes, if ``dtype`` holds all its digits."""
    places = int(dtype.rpartition(",")[2].rstrip(") "))
    plain = rf"^[+-]?([0-9]+(\.[0-9]{{0,{places}}}0*)?|\.[0-9]{{1,{places}}}0*)$"
    exact = s.try_cast("decimal(38,18)")
    return F.when(s.rlike(plain), s.try_cast(dtype)).when(
        s.rlike(_POWER) & (exact == exact.try_cast(dtype)), exact.try_cast(dtype)
    )


def read_amount(s: Column, dtype: str = MONEY) -> Column:
    """The signed number that ``s`` (from ``bare_number``) writes: CR +, DR -."""
    side = F.upper(F.right(s, F.lit(2)))
    magnitude = strip(F.substr(s, F.lit(1), F.length(s) - 2))
    unsigned = F.when(magnitude.rlike(_UNSIGNED), _number(magnitude, dtype))
    return (
        F.when(side == "CR", unsigned)
        .when(side == "DR", (-unsigned).cast(dtype))
        .otherwise(_number(s, dtype))
    )


def parse_amount(text: Column, dtype: str = MONEY) -> Column:
    """Money text to a signed number. Digits that ``dtype`` has no place for make it unreadable."""
    return read_amount(bare_number(text), dtype)


def bare_side(text: Column) -> Column:
    """A cell of a one-sided column without commas and white space; missing, empty and ``nan`` become 0."""
    s = F.replace(strip(text), F.lit(","), F.lit(""))
    return F.when(text.isNull() | s.isin("", "nan"), F.lit("0")).otherwise(s)


def read_side(s: Column, dtype: str = MONEY) -> Column:
    """The number that ``s`` (from ``bare_side``) writes."""
    return _number(s, dtype)


def parse_amount_or_zero(text: Column, dtype: str = MONEY) -> Column:
    """One-sided column of a statement: empty or ``nan`` is zero."""
    return read_side(bare_side(text), dtype)


def or_fail(parsed: Column, text: Column, what: str, nullable: bool) -> Column:
    """Raise at run time for a value that did not parse.

    ``nullable`` says whether a missing value is allowed (and stays NULL).
    """
    message = F.concat(
        F.lit(f"Cannot parse {what} value: '"), F.coalesce(text, F.lit("NULL")), F.lit("'")
    )
    # ``parsed`` stands here once: a repeated expression is worked out again.
    refused = F.raise_error(message)
    return F.coalesce(parsed, F.when(text.isNotNull(), refused) if nullable else refused)
