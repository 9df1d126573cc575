"""Row filters on date, category, sign and text."""

from __future__ import annotations

import datetime
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.text import has_keyword
from tallybook.schema import MONTH_FOLDER, UNCATEGORIZED


def expenses(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Amount") < 0)


def income(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Amount") > 0)


def uncategorized(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Category") == UNCATEGORIZED)


def labelled(df: DataFrame) -> DataFrame:
    return df.filter(F.col("Category") != UNCATEGORIZED)


def in_category(df: DataFrame, category: str) -> DataFrame:
    """Whole category name, any letter case."""
    return df.filter(F.lower("Category") == category.lower())


def in_last_months(df: DataFrame, months: int) -> DataFrame:
    """Rows later than the latest date of ``df`` less ``months`` calendar months.

    The cutoff is a scalar subquery over the date column alone, of the latest
    month only where the table is stored by month. It is known before the
    main scan starts, so it prunes folders and row groups.
    """
    if months < 1:
        raise ValueError(f"last N months needs N >= 1, got {months}")
    stored_by_month = MONTH_FOLDER in df.columns
    newest = df
    if stored_by_month:
        newest = df.filter(F.col(MONTH_FOLDER) == df.agg(F.max(MONTH_FOLDER)).scalar())
    cutoff = newest.agg(F.add_months(F.max("Date"), -months).alias("cutoff"))
    recent = df.filter(F.col("Date") > cutoff.scalar())
    if stored_by_month:
        first_month = cutoff.select(F.date_format("cutoff", "yyyy-MM")).scalar()
        recent = recent.filter(F.col(MONTH_FOLDER) >= first_month)
    return recent


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Inclusive at both ends."""
    first, last = datetime.date.fromisoformat(start), datetime.date.fromisoformat(end)
    rows = df.filter(F.col("Date").between(F.lit(first), F.lit(last)))
    return in_month_folders(rows, start[:7], end[:7])


def in_month_folders(df: DataFrame, first: str, last: str) -> DataFrame:
    """Repeat a date range on the folder column of a table stored by month."""
    if MONTH_FOLDER not in df.columns:
        return df
    return df.filter(F.col(MONTH_FOLDER).between(first, last))


def month_bounds(month: str) -> tuple[datetime.date, datetime.date]:
    """First day of ``YYYY-MM`` and first day of the month after it."""
    if not re.fullmatch(r"\d{4}-\d{2}", month):
        raise ValueError(f"month must be YYYY-MM, got {month!r}")
    first = datetime.date.fromisoformat(month + "-01")
    after = (first + datetime.timedelta(days=32)).replace(day=1)
    return first, after


def is_in_month(day: Column, month: str) -> Column:
    """A range on the date itself, so that it reaches the scan."""
    first, after = month_bounds(month)
    return (day >= F.lit(first)) & (day < F.lit(after))


def containing(df: DataFrame, keyword: str) -> DataFrame:
    """Description holds the literal keyword, any letter case."""
    return df.filter(has_keyword(F.col("Description"), keyword))
