"""Monthly budgets against actual spend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.measures import budget_status, calendar_months, spent
from tallybook.schema import ANALYSIS, require_columns
from tallybook.session import stored

WARN_THRESHOLD = 0.80


def override_budgets(base: DataFrame, overrides: DataFrame) -> DataFrame:
    """Base budgets with the overrides laid over them; an override must be positive."""
    name = F.coalesce("category", F.lit("?"))
    checked = overrides.select(
        "category",
        F.when(F.col("budget") > 0, F.col("budget"))
        .otherwise(F.raise_error(F.concat(F.lit("Budget must be positive for '"), name, F.lit("'"))))
        .alias("_new"),
    )
    return base.join(checked, "category", "full").select(
        "category", F.coalesce("_new", "budget").cast("decimal(18,2)").alias("budget")
    )


def _measured(budgets: DataFrame, spend: DataFrame, months: Column, warn: float) -> DataFrame:
    actual = budgets.join(spend, "category", "left").select(
        "category",
        "budget",
        F.coalesce("total", F.lit(0)).cast("decimal(26,2)").alias("total"),
        months.alias("num_months"),
    )
    average = F.col("total") / F.col("num_months")
    pct = F.col("total").cast("double") / F.col("num_months") / F.col("budget").cast("double") * 100
    return actual.select(
        "category",
        "budget",
        F.round(average, 2).cast("decimal(18,2)").alias("monthly_avg"),
        F.round(pct, 2).alias("pct_used"),
        budget_status(pct, warn).alias("status"),
        F.col("num_months").cast("bigint").alias("num_months"),
    )


def _spend(coarse: DataFrame) -> DataFrame:
    return coarse.groupBy("category").agg(F.sum("total").alias("total"))


def budget_alerts(df: DataFrame, budgets: DataFrame, warn_threshold: float = WARN_THRESHOLD) -> DataFrame:
    """Every budget against the average over the calendar months of the period.

    A category without spend counts as zero, one without a budget is left
    out. Spend and period come from one stored pass over the transactions.
    """
    require_columns(df, ANALYSIS, "budget_alerts")
    coarse = stored(
        df.groupBy(F.col("Category").alias("category")).agg(
            spent(F.col("Amount")).alias("total"),
            F.min("Date").alias("first"),
            F.max("Date").alias("last"),
        )
    )
    months = coarse.agg(calendar_months(F.min("first"), F.max("last"))).scalar()
    months = F.coalesce(months, F.lit(1))
    return _measured(budgets, _spend(coarse), months, warn_threshold).orderBy(
        F.desc("pct_used"), "category"
    )


def budget_vs_actual(df: DataFrame, budgets: DataFrame, warn_threshold: float = WARN_THRESHOLD) -> DataFrame:
    """As the alerts, but averaged over the months that hold any row; by category."""
    require_columns(df, ANALYSIS, "budget_vs_actual")
    coarse = stored(
        df.groupBy(
            F.col("Category").alias("category"), F.trunc("Date", "MM").alias("month")
        ).agg(spent(F.col("Amount")).alias("total"))
    )
    months = coarse.agg(F.greatest(F.lit(1), F.count_distinct("month"))).scalar()
    return _measured(budgets, _spend(coarse), months, warn_threshold).orderBy("category")
