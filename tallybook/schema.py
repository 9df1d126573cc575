"""Canonical column names, types and analysis-time column checks."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MONEY = "decimal(18,2)"
UNCATEGORIZED = "Uncategorized"
DEFAULT_CURRENCY = "USD"

# Folder column, yyyy-MM, of a table stored by month.
MONTH_FOLDER = "tx_month"

REQUIRED = ("Date", "Description", "Amount")
ANALYSIS = ("Date", "Description", "Amount", "Category")

TRANSACTION = T.StructType(
    [
        T.StructField("Date", T.DateType()),
        T.StructField("Description", T.StringType()),
        T.StructField("Amount", T.DecimalType(18, 2)),
        T.StructField("Currency", T.StringType()),
    ]
)
CLASSIFIED = T.StructType(
    TRANSACTION.fields
    + [
        T.StructField("Category", T.StringType()),
        T.StructField("ML_Classified", T.BooleanType()),
    ]
)
RULES = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("cat_order", T.IntegerType()),
        T.StructField("keyword", T.StringType()),
        T.StructField("kw_order", T.IntegerType()),
    ]
)
BUDGETS = T.StructType(
    [
        T.StructField("category", T.StringType()),
        T.StructField("budget", T.DecimalType(18, 2)),
    ]
)


def named(name: str) -> Column:
    """The column of exactly this name; dots and back-quotes in it are plain characters."""
    return F.col("`" + name.replace("`", "``") + "`")


def missing_columns(columns: Iterable[str], required: Sequence[str] = REQUIRED) -> list[str]:
    """Required names that are absent, in the order of ``required``."""
    have = set(columns)
    return [c for c in required if c not in have]


def require_columns(df: DataFrame, required: Sequence[str], who: str) -> DataFrame:
    """Return ``df`` unchanged, or raise ``ValueError`` naming what is missing."""
    lacking = sorted(missing_columns(df.columns, required))
    if lacking:
        raise ValueError(f"{who}: DataFrame is missing columns: {lacking}")
    return df


def conform(df: DataFrame, schema: T.StructType = TRANSACTION) -> DataFrame:
    """Project to exactly the fields of ``schema``, cast, in schema order."""
    require_columns(df, schema.names, "conform")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
