"""Rule and budget files: JSON on shared storage, tables in Spark."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.classify import sort_rules
from tallybook.schema import BUDGETS, RULES


_JSON_NUMBER = r"^-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?$"


def _whole_text(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.text(path, wholetext=True)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def _entries(text: DataFrame, value_type: str, what: str, path: str) -> DataFrame:
    """(key, place, value) of the one JSON object in ``text``; variants as JSON text.

    Text that is no such object fails. A repeated key keeps its first place and
    its last value, as JSON readers have it.
    """
    parsed = F.from_json("value", f"map<string,{value_type}>", {"mode": "FAILFAST"})
    broken = F.raise_error(F.lit(f"{what} {path} does not hold a JSON object"))
    # An empty file has no row at all; the aggregation makes it one.
    text = text.agg(F.coalesce(F.max("value"), F.lit("")).alias("value"))
    pairs = text.select(F.posexplode(F.map_entries(F.coalesce(parsed, broken))).alias("place", "entry"))
    value = F.to_json("entry.value") if value_type == "variant" else F.col("entry.value")
    return (
        pairs.select(F.col("entry.key").alias("key"), "place", value.alias("value"))
        .groupBy("key")
        .agg(F.min("place").alias("place"), F.max_by(F.struct("value"), "place").alias("last"))
        .select("key", "place", "last.value")
        .orderBy("place")
    )


def load_rules(spark: SparkSession, path: str) -> DataFrame:
    """Category to keywords, in file order, one row per keyword. A missing or broken file fails."""
    text = _whole_text(spark, path)
    if text is None:
        raise FileNotFoundError(f"No rules at {path}")
    return _entries(text, "array<string>", "The rules file", path).select(
        F.col("key").alias("category"),
        F.col("place").alias("cat_order"),
        F.posexplode("value").alias("kw_order", "keyword"),
    ).select(*RULES.names)


def _write_map(entries: DataFrame, path: str) -> None:
    """One JSON object in one file. ``entries`` holds one sorted array ``e``."""
    text = entries.select(F.to_json(F.map_from_entries("e"), {"pretty": "true"}).alias("value"))
    text.coalesce(1).write.mode("overwrite").text(path)


def save_rules(rules: DataFrame, path: str) -> None:
    """Categories by name, each with its distinct keywords by name."""
    per_category = sort_rules(rules).groupBy("category").agg(
        F.sort_array(F.collect_list("keyword")).alias("keywords")
    )
    _write_map(
        per_category.agg(F.sort_array(F.collect_list(F.struct("category", "keywords"))).alias("e")), path
    )


def budget_table(spark: SparkSession, budgets: Mapping[str, float]) -> DataFrame:
    for category, value in budgets.items():
        if isinstance(value, str) or not value > 0:
            raise ValueError(f"The budget of {category!r} is {value!r}; it has to be a number above zero")
    rows = [(c, str(v)) for c, v in budgets.items()]
    return spark.createDataFrame(rows, "category string, budget string").select(
        "category", F.col("budget").cast("decimal(18,2)").alias("budget")
    )


def load_budgets(spark: SparkSession, path: str) -> DataFrame:
    """Category to monthly amount. A missing file is an empty table, a broken one fails.

    A value that is not a JSON number, or not above zero, fails with its category.
    """
    text = _whole_text(spark, path)
    if text is None:
        return spark.createDataFrame([], BUDGETS)
    entries = _entries(text, "variant", "The budget file", path)
    number = F.when(F.col("value").rlike(_JSON_NUMBER), F.col("value").cast("double"))
    message = F.concat(
        F.lit("The budget of '"),
        F.col("key"),
        F.lit("' is "),
        F.coalesce("value", F.lit("null")),
        F.lit("; it has to be a number above zero"),
    )
    # The sign is judged before rounding to cents.
    return entries.select(
        F.col("key").alias("category"),
        F.when(number > 0, F.col("value").cast("decimal(38,10)").cast("decimal(18,2)"))
        .otherwise(F.raise_error(message))
        .alias("budget"),
    )


def save_budgets(budgets: DataFrame, path: str) -> None:
    pairs = F.sort_array(F.collect_list(F.struct("category", F.col("budget").cast("decimal(18,2)"))))
    _write_map(budgets.agg(pairs.alias("e")), path)
