"""The tables behind each view of a report, and their sink."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.text import axis_label, short_name
from tallybook.operators import anomaly, budgets as budgeting, recurring, totals


def category_donut(df: DataFrame) -> DataFrame:
    return totals.with_share(totals.category_totals(df)).orderBy(F.desc("total"), "category")


def monthly_trend(df: DataFrame) -> DataFrame:
    """Also the data of income against expenses by month."""
    return totals.monthly_totals(df)


def merchants(df: DataFrame) -> DataFrame:
    return totals.top_merchants(df).withColumn("short_name", short_name(F.col("merchant")))


def uncategorized(df: DataFrame) -> DataFrame:
    return totals.uncategorized_rows(df)


def recurring_charges(df: DataFrame) -> DataFrame:
    found = recurring.find_recurring(df)
    return found.select(
        short_name(F.col("Description")).alias("short_name"),
        "Category",
        F.abs("Avg_Amount").alias("amount_per_cycle"),
        "Frequency",
        "Occurrences",
        "Last_Date",
    )


def expense_scatter(df: DataFrame) -> DataFrame:
    return anomaly.flag_anomalies(df)


def month_changes(df: DataFrame) -> DataFrame:
    return totals.month_over_month(df)


def cover(df: DataFrame) -> DataFrame:
    return totals.cover_statistics(df)


def currencies(df: DataFrame) -> DataFrame:
    """One row: the codes, whether there are several, and the axis label."""
    if "Currency" not in df.columns:
        df = df.withColumn("Currency", F.lit(None).cast("string"))
    one = df.agg(F.sort_array(F.collect_set("Currency")).alias("codes"))
    return one.select(
        "codes",
        (F.size("codes") > 1).alias("multi_currency"),
        axis_label(F.col("codes")).alias("label"),
    )


VIEWS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "category_donut": category_donut,
    "monthly_trend": monthly_trend,
    "merchants": merchants,
    "uncategorized": uncategorized,
    "recurring": recurring_charges,
    "expense_scatter": expense_scatter,
    "month_changes": month_changes,
    "cover": cover,
    "currencies": currencies,
}


def datasets(df: DataFrame, budgets: DataFrame | None = None) -> dict[str, DataFrame]:
    """Every report table by name; the budget view only where budgets are given."""
    tables = {name: build(df) for name, build in VIEWS.items()}
    if budgets is not None:
        tables["budget_vs_actual"] = budgeting.budget_vs_actual(df, budgets)
    return tables


def write_report(df: DataFrame, folder: str, budgets: DataFrame | None = None, fmt: str = "parquet") -> str:
    """Write one table per view under ``report_{start}_to_{end}``; return that path.

    Each view is its own job over ``df``, so pass a stored table.
    """
    span = totals.period(df).first()
    target = f"{folder}/report_{span['period_start']}_to_{span['period_end']}"
    for name, data in datasets(df, budgets).items():
        data.write.mode("overwrite").format(fmt).save(f"{target}/{name}")
    return target


def summary_json(df: DataFrame) -> DataFrame:
    """The summary as one JSON text; currency totals only where there are several."""
    one = totals.summary(df)
    return one.select(F.to_json(F.struct("*")).alias("json"))


def write_payload(
    df: DataFrame,
    folder: str,
    budgets: DataFrame | None = None,
    with_anomalies: bool = False,
) -> None:
    """The JSON payload of a run, one folder per section.

    Sections whose length grows with the data are JSON lines written by all
    tasks; only the summary is a single document.
    """
    sections = {
        "recurring_transactions": recurring.find_recurring(df),
        "mom_comparison": totals.month_over_month(df),
    }
    if budgets is not None:
        sections["budget_alerts"] = budgeting.budget_alerts(df, budgets)
    if with_anomalies:
        sections["anomalies"] = anomaly.find_anomalies(df)
    summary_json(df).select(F.col("json").alias("value")).coalesce(1).write.mode("overwrite").text(
        f"{folder}/summary"
    )
    for name, data in sections.items():
        data.write.mode("overwrite").option("ignoreNullFields", False).json(f"{folder}/{name}")


def write_coverage(spark: SparkSession, counted: Mapping[str, int], folder: str) -> None:
    """What ``write_sources`` counted, as one JSON document beside the payload."""
    names = ("total", "classified", "uncategorized")
    row = spark.createDataFrame([tuple(counted[n] for n in names)], ", ".join(f"{n} bigint" for n in names))
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/coverage")
