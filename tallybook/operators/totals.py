"""Totals by category, merchant, month and currency, and the full summary.

Operators that need several small groupings of the same transactions start
from one coarse table (``by_category_currency`` or ``by_category_month``). It
is aggregated on the map side to a handful of rows per task and stored, so the
transactions are read once however many figures are derived from it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.measures import earned, is_expense, month_key, pct_change, spent
from tallybook.operators.filters import expenses, in_month_folders, is_in_month, uncategorized
from tallybook.schema import ANALYSIS, DEFAULT_CURRENCY, UNCATEGORIZED, require_columns
from tallybook.session import stored

TOP_MERCHANTS = 10
SAMPLE_ROWS = 5


def period(df: DataFrame) -> DataFrame:
    return df.agg(F.min("Date").alias("period_start"), F.max("Date").alias("period_end"))


def totals(df: DataFrame) -> DataFrame:
    """One row: income, expenses as a magnitude, net. Zero amounts are neither."""
    both = df.agg(earned(F.col("Amount")).alias("income"), spent(F.col("Amount")).alias("expenses"))
    return both.select("income", "expenses", (F.col("income") - F.col("expenses")).alias("net"))


def cover_statistics(df: DataFrame) -> DataFrame:
    """One row: totals plus the number of rows and of uncategorized rows."""
    one = df.agg(
        earned(F.col("Amount")).alias("income"),
        spent(F.col("Amount")).alias("expenses"),
        F.count("*").alias("transactions"),
        F.count_if(F.col("Category") == UNCATEGORIZED).alias("uncategorized"),
    )
    return one.withColumn("net", F.col("income") - F.col("expenses"))


def category_totals(df: DataFrame) -> DataFrame:
    """Spend per category, largest first; rows without a category are left out."""
    return (
        expenses(df)
        .filter(F.col("Category").isNotNull())
        .groupBy(F.col("Category").alias("category"))
        .agg(F.sum(-F.col("Amount")).alias("total"))
        .orderBy(F.desc("total"), "category")
    )


def with_share(category_sums: DataFrame) -> DataFrame:
    """Add ``pct_of_total`` (one decimal); NULL where there is no spend at all."""
    category_sums = stored(category_sums)
    grand = category_sums.agg(F.sum("total").cast("double")).scalar()
    share = F.round(F.try_divide(F.col("total").cast("double"), grand) * 100, 1)
    return category_sums.withColumn("pct_of_total", share)


def top_merchants(df: DataFrame, n: int = TOP_MERCHANTS) -> DataFrame:
    """The ``n`` descriptions with the largest spend; a per-task heap, no full sort.

    Rows without a description have no merchant and are left out.
    """
    return (
        expenses(df)
        .filter(F.col("Description").isNotNull())
        .groupBy(F.col("Description").alias("merchant"))
        .agg(F.sum(-F.col("Amount")).alias("total"))
        .orderBy(F.desc("total"), "merchant")
        .limit(n)
    )


def currency_totals(df: DataFrame) -> DataFrame:
    """Income, expenses and net per currency. No conversion is made."""
    sums = (
        df.filter(F.col("Currency").isNotNull())
        .groupBy(F.col("Currency").alias("currency"))
        .agg(earned(F.col("Amount")).alias("income"), spent(F.col("Amount")).alias("expenses"))
    )
    return sums.withColumn("net", F.col("income") - F.col("expenses")).orderBy("currency")


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    return df.select(column).filter(F.col(column).isNotNull()).distinct().orderBy(column)


def monthly_totals(df: DataFrame) -> DataFrame:
    """Expenses and income per month; months with only zero amounts are absent."""
    return (
        df.filter(F.col("Amount") != 0)
        .groupBy(month_key(F.col("Date")).alias("Month"))
        .agg(spent(F.col("Amount")).alias("Expenses"), earned(F.col("Amount")).alias("Income"))
        .orderBy("Month")
    )


def uncategorized_rows(df: DataFrame) -> DataFrame:
    return uncategorized(df).select("Date", "Description", "Amount")


def uncategorized_sample(df: DataFrame, n: int = SAMPLE_ROWS) -> DataFrame:
    """A report's first few uncategorized rows, in date order."""
    return uncategorized_rows(df).orderBy("Date", "Description", "Amount").limit(n)


def compare_months(df: DataFrame, month_a: str, month_b: str) -> DataFrame:
    """Spend per category in two months and ``diff = b - a``; a missing month is zero."""
    in_a, in_b = is_in_month(F.col("Date"), month_a), is_in_month(F.col("Date"), month_b)
    zero = F.lit(0).cast("decimal(28,2)")
    out = -F.col("Amount")
    scope = in_month_folders(expenses(df), min(month_a, month_b), max(month_a, month_b))
    sums = (
        scope.filter((in_a | in_b) & F.col("Category").isNotNull())
        .groupBy(F.col("Category").alias("category"))
        .agg(
            F.coalesce(F.sum(F.when(in_a, out)), zero).alias("month_a"),
            F.coalesce(F.sum(F.when(in_b, out)), zero).alias("month_b"),
        )
    )
    return sums.withColumn("diff", F.col("month_b") - F.col("month_a")).orderBy("category")


def by_category_month(df: DataFrame) -> DataFrame:
    """Spend per (category, month): the coarse table of month comparisons."""
    return (
        expenses(df)
        .filter(F.col("Category").isNotNull())
        .groupBy(F.col("Category").alias("category"), F.trunc("Date", "MM").alias("month"))
        .agg(F.sum(-F.col("Amount")).alias("total"))
    )


def month_over_month(df: DataFrame) -> DataFrame:
    """Change per category between the two latest months that have expenses.

    Fewer than two such months give no rows. Largest relative change first,
    categories without earlier spend last.
    """
    require_columns(df, ["Date", "Amount", "Category"], "month_over_month")
    table = stored(by_category_month(df))
    latest = table.agg(F.max("month")).scalar()
    earlier = table.filter(F.col("month") < latest).agg(F.max("month")).scalar()
    zero = F.lit(0).cast("decimal(28,2)")
    pair = table.withColumns({"_latest": latest, "_earlier": earlier}).filter(
        F.col("_earlier").isNotNull()
        & ((F.col("month") == F.col("_latest")) | (F.col("month") == F.col("_earlier")))
    )
    sums = pair.groupBy("category", "_latest", "_earlier").agg(
        F.coalesce(F.sum(F.when(F.col("month") == F.col("_latest"), F.col("total"))), zero).alias("current"),
        F.coalesce(F.sum(F.when(F.col("month") == F.col("_earlier"), F.col("total"))), zero).alias("previous"),
    )
    return sums.select(
        F.date_format("_latest", "yyyy-MM").alias("current_month"),
        F.date_format("_earlier", "yyyy-MM").alias("previous_month"),
        "category",
        "current",
        "previous",
        (F.col("current") - F.col("previous")).alias("diff"),
        F.round(pct_change(F.col("current"), F.col("previous")), 1).alias("pct_change"),
    ).orderBy(F.desc(F.coalesce(F.abs("pct_change"), F.lit(-1.0))), "category")


def by_category_currency(df: DataFrame) -> DataFrame:
    """The coarse table of the summary: figures per (category, currency)."""
    currency = F.col("Currency") if "Currency" in df.columns else F.lit(None).cast("string")
    return df.groupBy(F.col("Category").alias("category"), currency.alias("currency")).agg(
        F.min("Date").alias("first"),
        F.max("Date").alias("last"),
        earned(F.col("Amount")).alias("income"),
        spent(F.col("Amount")).alias("expenses"),
        F.count_if(is_expense(F.col("Amount"))).alias("n_expenses"),
        F.count("*").alias("rows"),
    )


def summary(df: DataFrame) -> DataFrame:
    """The spending summary, as one row with nested fields.

    ``currency_totals`` is NULL unless there are several currencies. Three scans
    feed it: coarse table, merchants and sample. Each list it holds is a
    report's top rows or has one entry per category or currency.
    """
    require_columns(df, ANALYSIS, "summary")
    coarse = stored(by_category_currency(df))
    by_category = (
        coarse.groupBy("category")
        .agg(F.sum("expenses").alias("total"), F.sum("n_expenses").alias("n"))
        .filter((F.col("n") > 0) & F.col("category").isNotNull())
    )
    by_currency = (
        coarse.filter(F.col("currency").isNotNull())
        .groupBy("currency")
        .agg(F.sum("income").alias("income"), F.sum("expenses").alias("expenses"))
    )

    def listed(table: DataFrame, *order) -> Column:
        return table.agg(F.array_sort(F.collect_list(F.struct(*order)))).scalar()

    categories = listed(
        by_category.withColumn("_rank", -F.col("total")), "_rank", "category", "total"
    )
    merchants = listed(
        top_merchants(df).withColumn("_rank", -F.col("total")), "_rank", "merchant", "total"
    )
    sample = listed(uncategorized_sample(df), "Date", "Description", "Amount")
    currencies = listed(
        by_currency.withColumn("net", F.col("income") - F.col("expenses")),
        "currency",
        "income",
        "expenses",
        "net",
    )
    head = coarse.agg(
        F.min("first").alias("period_start"),
        F.max("last").alias("period_end"),
        F.sum("income").alias("total_income"),
        F.sum("expenses").alias("total_expenses"),
        (F.sum("income") - F.sum("expenses")).alias("net"),
        F.coalesce(
            F.sum(F.when(F.col("category") == UNCATEGORIZED, F.col("rows"))), F.lit(0)
        ).alias("uncategorized_count"),
    )
    parts = head.select(
        "*",
        categories.alias("_categories"),
        merchants.alias("_merchants"),
        sample.alias("uncategorized_sample"),
        currencies.alias("_currencies"),
    )
    codes = F.transform("_currencies", lambda c: c["currency"])
    figures = ("income", "expenses", "net")
    return parts.select(
        *head.columns,
        F.map_from_entries(
            F.transform("_categories", lambda c: F.struct(c["category"], c["total"]))
        ).alias("category_totals"),
        F.transform(
            "_merchants",
            lambda m: F.struct(m["merchant"].alias("merchant"), m["total"].alias("total")),
        ).alias("top_merchants"),
        "uncategorized_sample",
        F.when(F.size(codes) > 0, codes)
        .otherwise(F.array(F.lit(DEFAULT_CURRENCY)))
        .alias("currencies"),
        F.when(
            F.size(codes) > 1,
            F.map_from_entries(
                F.transform(
                    "_currencies",
                    lambda c: F.struct(c["currency"], F.struct(*[c[f].alias(f) for f in figures])),
                )
            ),
        ).alias("currency_totals"),
    )
