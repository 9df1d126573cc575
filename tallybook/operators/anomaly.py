"""Unusual expenses by modified z-score (median and median absolute deviation)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallybook.functions.measures import cents
from tallybook.operators.filters import expenses
from tallybook.operators.joins import BROADCAST_KEYS, lookup
from tallybook.operators.medians import (
    direct_twice_median,
    frequencies,
    is_short,
    twice_median,
)
from tallybook.schema import ANALYSIS, require_columns
from tallybook.session import stored

# The consistency constant of the modified z-score, the default
# threshold, and the smallest category judged by its own statistics.
SCALE = 0.6745
THRESHOLD = 3.5
OWN_STATISTICS_FROM = 3


def spread_profile(freq: DataFrame, keys: Sequence[str], direct: bool) -> DataFrame:
    """``keys, n, twice_mid, twice_mad, deviation`` of the amounts of each group.

    ``freq`` counts each (keys, cents). ``twice_mid`` is in cents and
    ``twice_mad`` in half-cents, so that both are exact whole numbers; the
    sample standard deviation is in money, NULL for a single amount.
    ``direct`` is for short tables, see ``medians``.
    """
    keys = list(keys)
    mid = twice_median(freq, keys, "cents", direct).select(*keys, F.col("twice").alias("twice_mid"))
    off = F.lit(2) * F.col("cents") - F.col("twice_mid")
    # One row for each group on the right; on the left a group may hold most of the table.
    matched = freq.join(mid, keys) if direct else lookup(freq, stored(mid), keys, how="inner")
    offsets = matched.select(*keys, "weight", "twice_mid", off.alias("off"))
    size, weight = F.col("off").cast("double"), F.col("weight")
    figures = [
        F.first("twice_mid").alias("twice_mid"),
        F.sum("weight").alias("n"),
        F.sum(weight * size).alias("s1"),
        F.sum(weight * size * size).alias("s2"),
    ]
    if direct:
        mad = direct_twice_median(F.abs("off")).alias("twice_mad")
        measured = offsets.groupBy(*keys).agg(*figures, mad)
    else:
        deviations = (
            offsets.withColumn("dev", F.abs("off"))
            .groupBy(*keys, "dev")
            .agg(F.sum("weight").alias("weight"))
        )
        mad = twice_median(deviations, keys, "dev", direct)
        measured = (
            offsets.groupBy(*keys).agg(*figures).join(mad.select(*keys, F.col("twice").alias("twice_mad")), keys)
        )
    n = F.col("n").cast("double")
    spread = F.greatest(F.lit(0.0), F.col("s2") - F.col("s1") * F.col("s1") / n)
    deviation = F.sqrt(F.when(F.col("n") > 1, spread / (n - 1))) / 200
    return measured.select(
        *keys, "n", "twice_mid", "twice_mad", deviation.alias("deviation")
    )


def z_score(amount: Column, stats: str) -> Column:
    """0.6745 (x - median) / MAD; with a MAD of zero (x - median) / deviation, or 0."""
    half_cents = F.lit(2) * cents(F.abs(amount)) - F.col(f"{stats}.twice_mid")
    mad, deviation = F.col(f"{stats}.twice_mad"), F.col(f"{stats}.deviation")
    return (
        F.when(mad != 0, F.lit(SCALE) * (F.lit(2) * half_cents) / mad)
        .when(deviation > 0, half_cents / F.lit(200.0) / deviation)
        .otherwise(F.lit(0.0))
    )


def expense_profile(df: DataFrame) -> DataFrame:
    """``Category, overall`` and the figures of each category, and of all expenses.

    The transactions are read once, to count (category, cents). That table,
    whose size follows the variety of amounts rather than the number of rows,
    is stored; both medians and the deviations come from it.
    """
    require_columns(df, ANALYSIS, "expense_profile")
    pool = expenses(df).select(F.col("Category"), cents(-F.col("Amount")).alias("cents"))
    return profile_of_counts(stored(frequencies(pool, ["Category"], "cents")))


def profile_of_counts(counted: DataFrame) -> DataFrame:
    """As ``expense_profile``, from a stored table of (Category, cents, weight)."""
    own = counted.filter(F.col("Category").isNotNull()).withColumn("overall", F.lit(False))
    everything = (
        counted.groupBy("cents")
        .agg(F.sum("weight").alias("weight"))
        .withColumns({"Category": F.lit(""), "overall": F.lit(True)})
    )
    both = own.unionByName(everything)
    return spread_profile(both, ["overall", "Category"], is_short(counted))


def score_expenses(
    df: DataFrame, profile: DataFrame | None = None, max_broadcast: int = BROADCAST_KEYS
) -> DataFrame:
    """Expense rows with ``z`` (unrounded).

    The profile is stored first, so its size is known: it is broadcast if it
    has few categories, and joined with salted keys otherwise. Categories with
    fewer than three expenses take the profile of all expenses.
    """
    require_columns(df, ANALYSIS, "score_expenses")
    profile = stored(expense_profile(df)) if profile is None else profile
    stats = F.struct("twice_mid", "twice_mad", "deviation")
    everything = profile.filter("overall").select(stats).scalar()
    own = profile.filter(~F.col("overall") & (F.col("n") >= OWN_STATISTICS_FROM)).select(
        "Category", stats.alias("_own")
    )
    spent = expenses(df).filter(F.col("Category").isNotNull())
    joined = lookup(spent, own, ["Category"], max_rows=max_broadcast)
    used = F.coalesce(F.col("_own"), everything)
    return joined.withColumn("_stats", used).select(
        *spent.columns, z_score(F.col("Amount"), "_stats").alias("z")
    )


def find_anomalies(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Expenses scoring above ``threshold``, highest first."""
    return (
        score_expenses(df)
        .filter(F.col("z") > threshold)
        .select(
            "Date", "Description", "Amount", "Category", F.round("z", 2).alias("Z_Score")
        )
        .orderBy(F.desc("Z_Score"), "Date", "Description", "Amount", "Category")
    )


def flag_anomalies(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Every expense with its magnitude, rounded score and ``is_anomaly``."""
    return score_expenses(df).select(
        "Date",
        F.substring("Description", 1, 35).alias("short_name"),
        F.abs("Amount").alias("magnitude"),
        "Category",
        F.round("z", 2).alias("Z_Score"),
        (F.col("z") > threshold).alias("is_anomaly"),
    )
