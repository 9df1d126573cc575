"""Recurring charges: descriptions that repeat with a steady amount."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.functions.measures import cents, frequency_band
from tallybook.operators.joins import few_keys, lookup
from tallybook.operators.medians import frequencies, twice_median
from tallybook.schema import ANALYSIS, require_columns
from tallybook.session import stored

# Defaults of the detector.
MIN_OCCURRENCES = 2
AMOUNT_TOLERANCE = 0.10


def daily_activity(df: DataFrame) -> DataFrame:
    """One row per (Description, Date, Category), then placed by Description.

    The first aggregation spreads a busy description over its dates. After it
    a description holds at most one row per day and category, so what follows
    may safely put it in one task.
    """
    daily = (
        df.filter(F.col("Description").isNotNull())
        .groupBy("Description", "Date", "Category")
        .agg(
            F.count("*").alias("rows"),
            F.count("Amount").alias("priced"),
            F.sum("Amount").alias("total"),
            F.min("Amount").alias("low"),
            F.max("Amount").alias("high"),
        )
    )
    return daily.repartition("Description")


def describe(df: DataFrame, min_occurrences: int = 1, min_days: int = 1) -> DataFrame:
    """One row per description: figures, commonest category, dates, median gap.

    Everything after ``daily_activity`` keeps to its partitioning, so windows
    and grouping run in one stage without a further shuffle, and all
    aggregates are of fixed size.

    N transactions in R daily rows have N - R gaps of zero inside the rows,
    and R - 1 gaps from row to row.
    """
    description = Window.partitionBy("Description")
    same_category = Window.partitionBy("Description", "Category")
    # The smallest (-rows, name) is the commonest category, ties by name.
    rank = F.when(
        F.col("Category").isNotNull(),
        F.struct((-F.sum("rows").over(same_category)).alias("n"), F.col("Category").alias("c")),
    )
    gaps = (
        daily_activity(df)
        .withColumn("_best", rank)
        .withColumns(
            {
                "gap": F.datediff("Date", F.lag("Date").over(description.orderBy("Date"))),
                "_n": F.sum("rows").over(description),
                "_r": F.count("*").over(description),
                "_span": F.datediff(F.max("Date").over(description), F.min("Date").over(description)),
            }
        )
        .filter((F.col("_n") >= min_occurrences) & (F.col("_span") >= min_days - 1))
    )
    # Position of a gap among all, those of zero first; the first row has none.
    at = F.row_number().over(description.orderBy("gap")) - 2 + F.col("_n") - F.col("_r")
    middle = F.when(F.col("_at") == F.expr("(_n - 2) div 2"), F.col("gap")).otherwise(
        F.lit(0)
    ) + F.when(F.col("_at") == F.expr("(_n - 1) div 2"), F.col("gap")).otherwise(F.lit(0))
    return (
        gaps.withColumn("_at", at)
        .groupBy("Description")
        .agg(
            F.min("_best").alias("_best"),
            F.sum("rows").alias("rows"),
            F.sum("priced").alias("priced"),
            F.sum("total").alias("total"),
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.min("Date").alias("First_Date"),
            F.max("Date").alias("Last_Date"),
            (F.coalesce(F.sum(middle), F.lit(0)) / 2.0).alias("median_gap"),
        )
        .withColumn("Category", F.col("_best.c"))
        .drop("_best")
    )


def _steadiness(tolerance: float) -> Column:
    """Verdict from the extremes alone: TRUE, FALSE, or NULL for "ask the median".

    With all amounts of one sign, the largest deviation from the median lies
    between bounds that the smallest and largest magnitude give. The margins
    leave cases near a bound to the exact test.
    """
    low, high = F.col("low").cast("double"), F.col("high").cast("double")
    small, large = F.least(F.abs(low), F.abs(high)), F.greatest(F.abs(low), F.abs(high))
    one_sign = low * high > 0
    verdict = F.when(low.isNull() | (low == high), F.lit(True)).when(
        one_sign & (large - small <= 0.999 * tolerance * small), F.lit(True)
    )
    if tolerance < 1:
        least_median, most_median = large / (1 + tolerance), small / (1 - tolerance)
        verdict = verdict.when(one_sign & (least_median > 1.001 * most_median), F.lit(False))
    return verdict


def _exact_medians(df: DataFrame, unsettled: DataFrame) -> DataFrame:
    """(Description, median) of the amounts of the descriptions in ``unsettled``.

    Few descriptions are broadcast, so that only their rows are shuffled.
    Many are applied after counting, when a busy one is down to its distinct
    amounts.
    """
    rows = df.filter(F.col("Description").isNotNull() & F.col("Amount").isNotNull()).select(
        "Description", cents(F.col("Amount")).alias("cents")
    )
    keys = ["Description"]
    if few_keys(unsettled, keys):
        counted = frequencies(rows.join(F.broadcast(unsettled), keys, "left_semi"), keys, "cents")
    else:
        counted = lookup(frequencies(rows, keys, "cents"), unsettled, keys, how="left_semi")
    return twice_median(stored(counted), keys, "cents").select(
        "Description", (F.col("twice") / F.lit(200.0)).alias("median")
    )


def find_recurring(
    df: DataFrame,
    min_occurrences: int = MIN_OCCURRENCES,
    amount_tolerance: float = AMOUNT_TOLERANCE,
) -> DataFrame:
    """Profile of each description that recurs.

    Kept are descriptions with enough rows, at least two dates, and every
    amount within the tolerance of their median amount (not tested where that
    median is zero). The extremes settle most of them; the candidates are
    stored, and exact medians are computed for the rest only, if there are any.
    """
    require_columns(df, ANALYSIS, "find_recurring")
    if amount_tolerance < 0:
        raise ValueError(f"amount_tolerance must not be negative, got {amount_tolerance}")
    candidates = stored(
        describe(df, min_occurrences, min_days=2)
        .withColumn("steady", _steadiness(amount_tolerance))
        .filter(F.coalesce("steady", F.lit(True)))
    )
    unsettled = candidates.filter(F.col("steady").isNull()).select("Description")
    kept = candidates.filter("steady")
    if not unsettled.isEmpty():
        median = F.col("median")
        low, high = F.col("low").cast("double"), F.col("high").cast("double")
        within = F.greatest(high - median, median - low) / F.abs(median) <= amount_tolerance
        judged = candidates.join(_exact_medians(df, unsettled), "Description", "left")
        kept = judged.filter(F.col("steady") | F.when(median == 0, F.lit(True)).otherwise(within))
    average = F.round(F.col("total").cast("decimal(38,2)") / F.col("priced"), 2)
    return kept.select(
        "Description",
        "Category",
        F.when(F.col("priced") > 0, average).cast("decimal(18,2)").alias("Avg_Amount"),
        F.round("median_gap", 1).alias("Median_Days"),
        frequency_band(F.col("median_gap")).alias("Frequency"),
        F.col("rows").alias("Occurrences"),
        "First_Date",
        "Last_Date",
    ).orderBy(F.desc(F.abs("Avg_Amount")), "Description")
