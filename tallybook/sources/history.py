"""Classified transactions on storage: the sink of a run, the input of training."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.filters import labelled
from tallybook.schema import MONTH_FOLDER, require_columns

# Files named like a processed export, or parts of our own tables.
HISTORY_FILES = "{*_categorized.csv,part-*}"


def source_name(path: Column) -> Column:
    """Name of a source: its file name without suffix, and a hash of the whole path.

    Files of one name in two folders are two sources.
    """
    plain = F.regexp_replace(path, "^file:/+", "/")
    return F.concat(F.regexp_extract(plain, r"([^/]+?)(?:\.[^./]*)?$", 1), F.lit("-"), F.substring(F.md5(plain), 1, 8))


def source_names(paths: Iterable[str]) -> list[str]:
    """As ``source_name``, for paths known on the driver."""
    plain = [re.sub("^file:/+", "/", p) for p in paths]
    stems = [re.search(r"([^/]+?)(?:\.[^./]*)?$", p) for p in plain]
    return sorted(
        {f"{m[1] if m else ''}-{hashlib.md5(p.encode()).hexdigest()[:8]}" for p, m in zip(plain, stems, strict=True)}
    )


def write_categorized(df: DataFrame, path: str, fmt: str = "parquet", by: str = "source") -> None:
    """Write classified rows, one folder per source file, or per month and source file.

    Only the folders that occur in ``df`` are replaced, so a source written
    again replaces its own rows and never those of another. (By month, a month
    that a source no longer has stays until it is deleted.) The rebalance hint
    has Spark size the files at run time and split a folder that holds a large
    share of the rows, so no source or month is written by one task.
    """
    if by not in ("source", "month"):
        raise ValueError(f"rows are stored by source or by month, not by {by!r}")
    require_columns(df, ["source_file"], "write_categorized")
    out = df.withColumn("source", source_name(F.col("source_file"))).drop("source_file")
    folders = ["source"]
    if by == "month":
        out, folders = out.withColumn(MONTH_FOLDER, F.date_format("Date", "yyyy-MM")), [MONTH_FOLDER, "source"]
    writer = (
        out.hint("rebalance", *folders)
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*folders)
    )
    if fmt == "csv":
        writer.option("header", True).option("escape", '"').csv(path)
    else:
        writer.format(fmt).save(path)


def read_categorized(
    spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", files: str = HISTORY_FILES
) -> DataFrame | None:
    """All labelled history under ``paths``; None if there is no such folder or file.

    The files of one folder share a header; a file that breaks this fails
    rather than shifts columns. Folders may differ and are joined by name.
    """
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        reader = (
            spark.read.option("pathGlobFilter", files)
            .option("recursiveFileLookup", True)
            .option("header", True)
            .option("escape", '"')
            .option("enforceSchema", False)
        )
        try:
            part = reader.format(fmt).load(path)
        except AnalysisException as err:
            if err.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                continue
            raise
        if part.columns:
            parts.append(part)
    if not parts:
        return None
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def training_set(history: DataFrame, include_ml: bool = True) -> DataFrame:
    """Distinct labelled (Description, Category) pairs.

    ``include_ml=False`` leaves out rows that a model labelled earlier.
    """
    require_columns(history, ["Description", "Category"], "training_set")
    rows = labelled(history).filter(F.col("Description").isNotNull())
    if not include_ml and "ML_Classified" in history.columns:
        rows = rows.filter(~F.coalesce(F.col("ML_Classified").cast("boolean"), F.lit(False)))
    return rows.select("Description", "Category").distinct()


def load_training_set(
    spark: SparkSession, paths: str | Sequence[str], fmt: str = "csv", include_ml: bool = True
) -> DataFrame:
    history = read_categorized(spark, paths, fmt)
    if history is None:
        return spark.createDataFrame([], "Description string, Category string")
    return training_set(history, include_ml)


def newest_file(spark: SparkSession, path: str, files: str = HISTORY_FILES):
    """Latest change under ``path`` as a timestamp; None without files.

    Raises ``FileNotFoundError`` for a missing folder. Only file listings are
    read, no contents.
    """
    try:
        listing = (
            spark.read.format("binaryFile")
            .option("pathGlobFilter", files)
            .option("recursiveFileLookup", True)
            .load(path)
        )
        return listing.agg(F.max("modificationTime").alias("t")).first()["t"]
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(path) from err
        raise
