"""Numeric and date expressions shared by the analytic operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Inclusive bounds, in days, of each charge frequency.
FREQUENCY_BANDS = (
    (4.0, 10.0, "Weekly"),
    (11.0, 18.0, "Biweekly"),
    (25.0, 35.0, "Monthly"),
    (85.0, 95.0, "Quarterly"),
    (350.0, 380.0, "Annual"),
)
IRREGULAR = "Irregular"


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def is_expense(amount: Column) -> Column:
    return amount < 0


def is_income(amount: Column) -> Column:
    return amount > 0


def spent(amount: Column) -> Column:
    """Sum of expense magnitudes; zero where there is none."""
    return F.coalesce(F.sum(F.when(amount < 0, -amount)), F.lit(0).cast("decimal(28,2)"))


def earned(amount: Column) -> Column:
    """Sum of income; zero where there is none."""
    return F.coalesce(F.sum(F.when(amount > 0, amount)), F.lit(0).cast("decimal(28,2)"))


def frequency_band(median_days: Column) -> Column:
    band = F
    for low, high, name in FREQUENCY_BANDS:
        band = band.when(median_days.between(low, high), F.lit(name))
    return band.otherwise(F.lit(IRREGULAR))


def budget_status(pct_used: Column, warn_threshold: float = 0.80) -> Column:
    return (
        F.when(pct_used >= 100, F.lit("EXCEEDED"))
        .when(pct_used >= warn_threshold * 100, F.lit("APPROACHING"))
        .otherwise(F.lit("OK"))
    )


def pct_change(current: Column, previous: Column) -> Column:
    """Change in percent of ``previous``; NULL where that is zero."""
    cur, prev = current.cast("double"), previous.cast("double")
    return F.when(prev != 0, (cur - prev) / prev * 100)


def calendar_months(first: Column, last: Column) -> Column:
    """Calendar months touched by an inclusive date span, at least one."""
    span = F.months_between(F.trunc(last, "MM"), F.trunc(first, "MM")).cast("int") + 1
    return F.greatest(F.lit(1), span)


def cents(amount: Column) -> Column:
    """Exact whole cents of a money value."""
    return (amount * 100).cast("bigint")
