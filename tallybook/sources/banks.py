"""Exports of several banks in one call: files grouped by their header, a plan for each group."""

from __future__ import annotations

import itertools
import re
import urllib.parse
import uuid
from collections.abc import Mapping, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.session import checkpoint_folder
from tallybook.sources.exports import ingest, read_export
from tallybook.sources.layouts import detect_layout

# A file larger than this is no export; up to it, a file is one task of the header scan.
_WHOLE_FILE = 1 << 50


def scan_headers(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """(header, paths): the distinct first lines of all files, as bytes, and the files that have each.

    One job. Each file is a task, which ends after its first lines; nothing
    else of it is read. The result is stored. Files without any line are in no group.
    """

    target = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    # For this job each file is one partition.
    settings = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = [spark.conf.get(k) for k in settings]
    try:
        for k in settings:
            spark.conf.set(k, str(_WHOLE_FILE))
        lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
        rows = lines.select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("header"))
        # No operator of a DataFrame ends a partition early without a limit on all; an RDD's iterator does.
        firsts = spark.createDataFrame(rows.rdd.mapPartitions(lambda lines: itertools.islice(lines, 1)), rows.schema)
        grouped = firsts.groupBy("header").agg(F.sort_array(F.collect_list("path")).alias("paths"))
        grouped.write.parquet(target)
    finally:
        for k, v in zip(settings, before, strict=True):
            spark.conf.set(k, v)
    return spark.read.schema(grouped.schema).parquet(target)


def read_banks(
    spark: SparkSession, paths: str | Sequence[str], encoding: str = "auto", multiline: bool = False
) -> list[DataFrame]:
    """One raw frame, as ``read_export`` makes it, for each header among the files.

    The driver gets the names of the files, which Spark's own listing holds
    there as well.
    """
    read_export(spark, paths, encoding, multiline)  # for its errors: no such path, or no export
    groups = scan_headers(spark, paths).orderBy("paths").collect()
    return [read_export(spark, [_literal(p) for p in g["paths"]], encoding, multiline) for g in groups]


def _literal(uri: str) -> str:
    """A listed file as a path that Spark takes for this file alone, whatever characters its name has."""
    return re.sub(r"([*?{}\[\]\\])", r"\\\1", urllib.parse.unquote(uri))


def ingest_banks(
    raws: Sequence[DataFrame],
    bank: str | None = None,
    mapping: Mapping[str, str] | None = None,
    clean=ingest,
    **options: Any,
) -> DataFrame:
    """Each frame cleaned by its own layout, joined by column name.

    A stated ``bank`` holds for all. Of ``mapping`` a frame takes what names its
    columns; a name that no frame has is an error. ``clean`` is ``ingest`` or
    ``ingest_tolerant``, ``options`` are its others.
    """
    unknown = sorted(set(mapping or {}) - {c for raw in raws for c in raw.columns})
    if unknown:
        raise ValueError(f"Unknown column names {unknown}; no file has them.")
    parts = []
    for raw in raws:
        own = {k: v for k, v in (mapping or {}).items() if k in raw.columns}
        parts.append(clean(raw, bank, mapping=own or None, **options))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ingest_files(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "auto",
    multiline: bool = False,
    **options: Any,
) -> DataFrame:
    """Files of any known layouts, side by side, to canonical transactions."""
    return ingest_banks(read_banks(spark, paths, encoding, multiline), **options)


def layouts_of(raws: Sequence[DataFrame], bank: str | None = None) -> list[str]:
    """Name of the layout that reads each frame."""
    return [detect_layout(raw.columns, bank).name for raw in raws]
