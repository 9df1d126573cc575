"""The named queries: one function, one plan, one DataFrame each.

Every query works on whatever scope it is given, so ``between`` and ``last``
compose with all others: ``average(between(df, a, b), "Groceries", last=2)``
counts its two months back from the latest date inside the range.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallybook.functions.measures import month_key
from tallybook.operators import filters, totals
from tallybook.schema import ANALYSIS, require_columns

_ORDER = ("Date", "Description", "Amount")


def _scope(df: DataFrame, last: int | None) -> DataFrame:
    require_columns(df, ANALYSIS, "query")
    return df if last is None else filters.in_last_months(df, last)


def _spending(df: DataFrame, category: str, last: int | None) -> DataFrame:
    return filters.expenses(filters.in_category(_scope(df, last), category))


def _listed(df: DataFrame) -> DataFrame:
    return df.select("Date", "Description", "Amount", "Category")


def categories(df: DataFrame) -> DataFrame:
    """Spend per category, largest first."""
    return totals.category_totals(_scope(df, None))


def show(df: DataFrame, category: str, last: int | None = None) -> DataFrame:
    """All rows of a category, income and refunds included."""
    return _listed(filters.in_category(_scope(df, last), category))


def top(df: DataFrame, n: int, category: str | None = None, last: int | None = None) -> DataFrame:
    """The ``n`` largest expenses."""
    scope = _scope(df, last)
    if category is not None:
        scope = filters.in_category(scope, category)
    return _listed(filters.expenses(scope)).orderBy("Amount", "Date", "Description").limit(n)


def biggest(df: DataFrame, category: str, last: int | None = None) -> DataFrame:
    return top(df, 1, category, last)


def sum_of(df: DataFrame, category: str, last: int | None = None) -> DataFrame:
    """Total and count of a category's expenses; no row if there are none."""
    return (
        _spending(df, category, last)
        .agg(
            F.min("Category").alias("category"),
            F.sum(-F.col("Amount")).alias("total"),
            F.count("*").alias("transactions"),
        )
        .filter(F.col("transactions") > 0)
    )


def monthly(df: DataFrame, category: str, last: int | None = None) -> DataFrame:
    return (
        _spending(df, category, last)
        .groupBy(month_key(F.col("Date")).alias("month"))
        .agg(F.sum(-F.col("Amount")).alias("total"))
        .orderBy("month")
    )


def average(df: DataFrame, category: str, last: int | None = None) -> DataFrame:
    """Mean of the monthly totals over months that have expenses; no row if none."""
    by_month = (
        _spending(df, category, last)
        .groupBy(F.trunc("Date", "MM").alias("month"))
        .agg(F.sum(-F.col("Amount")).alias("total"), F.min("Category").alias("category"))
    )
    return (
        by_month.agg(
            F.min("category").alias("category"),
            F.round(F.sum("total") / F.count("*"), 2).cast("decimal(28,2)").alias("average"),
            F.sum("total").alias("total"),
            F.count("*").alias("months"),
        )
        .filter(F.col("months") > 0)
    )


def compare(df: DataFrame, month_a: str, month_b: str) -> DataFrame:
    return totals.compare_months(_scope(df, None), month_a, month_b)


def search(df: DataFrame, keyword: str, last: int | None = None) -> DataFrame:
    return _listed(filters.containing(_scope(df, last), keyword))


def between(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows of an inclusive date range, as a scope for any other query."""
    return filters.between(_scope(df, None), start, end)


def last(df: DataFrame, months: int) -> DataFrame:
    """Rows of the latest months, as a scope for any other query."""
    return _scope(df, months)


def catalogue(df: DataFrame) -> DataFrame:
    """One row: the sorted category names and the span of dates."""
    by_category = df.groupBy("Category").agg(
        F.min("Date").alias("first"), F.max("Date").alias("last")
    )
    return by_category.agg(
        F.sort_array(F.collect_list("Category")).alias("categories"),
        F.min("first").alias("first_date"),
        F.max("last").alias("last_date"),
    )
