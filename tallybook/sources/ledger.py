"""A table of classified rows in which a source is replaced as a whole, and counted as it is written.

Layout: ``version=v-<id>/tx_month=<yyyy-MM>/source=<name>/`` holds the rows of one
write, ``_manifest/`` one row for each source and write. The manifest is written
last, as a single file, so a write counts from one moment on or not at all: what
a crash, a failed check or a newer version leaves behind is read by nobody. Of
each source the newest version is live, whatever months it has.

One writer at a time numbers the versions; of two at once the later name wins.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.measures import cents
from tallybook.operators.filters import expenses
from tallybook.operators.joins import lookup
from tallybook.operators.medians import frequencies
from tallybook.schema import MONTH_FOLDER, UNCATEGORIZED, require_columns
from tallybook.session import stored
from tallybook.sources.history import source_name, source_names
from tallybook.sources.layouts import RAW_AMOUNT, RAW_DATE

MANIFEST = "source string, version string, number bigint, rows bigint"
# Rows without a source file are one source.
NO_SOURCE = "unknown"
# Examples of bad rows: at most one for each hash bucket, of which the first few are shown.
_BUCKETS = 16
EXAMPLES = 5


def _manifest(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/_manifest")
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


def live_versions(spark: SparkSession, path: str) -> DataFrame | None:
    """(source, version, rows): the newest version of each source; None where nothing was ever written."""
    written = _manifest(spark, path)
    if written is None:
        return None
    newest = written.groupBy("source").agg(F.max(F.struct("number", "version", "rows")).alias("_v"))
    return newest.select("source", "_v.version", "_v.rows")


def coverage_metrics() -> list[Column]:
    """Rows and uncategorized rows, as aggregates."""
    return [F.count("*").alias("total"), F.count_if(F.col("Category") == UNCATEGORIZED).alias("uncategorized")]


def reject_metrics() -> list[Column]:
    """Bad rows by reason, and a few of their texts, in a state of fixed size."""
    reason = F.col("reject_reason")
    shown = F.concat_ws(" | ", F.coalesce(RAW_DATE, F.lit("NULL")), F.coalesce(RAW_AMOUNT, F.lit("NULL")))
    bucket = F.pmod(F.xxhash64(shown), F.lit(_BUCKETS))
    counts = [F.count_if(reason == r).alias(r) for r in ("date", "amount", "date,amount")]
    return counts + [F.min(F.when(reason.isNotNull() & (bucket == i), shown)).alias(f"example_{i}") for i in range(_BUCKETS)]


def rejects_of(metrics: dict) -> tuple[dict[str, int], list[str]]:
    """Counts by reason, those of zero left out, and up to ``EXAMPLES`` examples."""
    counts = {r: metrics[r] for r in ("date", "amount", "date,amount") if metrics.get(r)}
    examples = sorted(v for k, v in metrics.items() if k.startswith("example_") and v is not None)
    return counts, examples[:EXAMPLES]


def write_sources(
    df: DataFrame, path: str, fmt: str = "parquet", sources: Iterable[str] = (), allow_rejects: bool = False
) -> dict[str, int]:
    """Write classified rows by month and source; each source replaces all it had. Returns what was counted.

    ``sources`` names files that were read, so that one which has no row any
    more loses its old ones. ``df`` is worked out once, into a stored table; rows are counted there:
    ``total``, ``classified`` and ``uncategorized``. If ``df`` is tagged as by
    ``ingest_tolerant``, only clean rows are kept; bad ones are counted there
    as well, and fail the write before it takes effect unless
    ``allow_rejects``, in which case ``rejected`` says how many there were.
    """
    require_columns(df, ["source_file"], "write_sources")
    version = f"v-{uuid.uuid4().hex}"
    # Parsing and matching run once; what is counted are columns of the stored rows.
    # (Not an Observation: a session that has had one can no longer run Spark ML models.)
    held = stored(df)
    rejected = None
    if "reject_reason" in held.columns:
        counts, examples = rejects_of(held.agg(*reject_metrics()).first().asDict())
        rejected = sum(counts.values())
        if counts and not allow_rejects:
            raise ValueError(f"Cannot parse {rejected} row(s): {counts}. Examples: {examples}")
        held = held.filter(F.col("reject_reason").isNull()).drop(RAW_DATE, RAW_AMOUNT, "reject_reason")
    result = held.agg(*coverage_metrics()).first().asDict()
    result["classified"] = result["total"] - result["uncategorized"]
    if rejected is not None:
        result["rejected"] = rejected
    out = (
        held.withColumn("source", F.coalesce(source_name(F.col("source_file")), F.lit(NO_SOURCE)))
        .drop("source_file")
        .withColumn(MONTH_FOLDER, F.date_format("Date", "yyyy-MM"))
    )
    written = _write_version(out.hint("rebalance", MONTH_FOLDER, "source"), path, version, fmt, [MONTH_FOLDER, "source"])
    _publish(written, path, version, sources)
    return result


def _write_version(out: DataFrame, path: str, version: str, fmt: str, folders: list[str]) -> DataFrame:
    """Write one version's rows, which nobody reads until it is published; the rows as written."""
    target = f"{path}/version={version}"
    out.write.partitionBy(*folders).format(fmt).save(target)
    return out.sparkSession.read.schema(out.schema).format(fmt).load(target)


def _publish(written: DataFrame, path: str, version: str, sources: Iterable[str]) -> None:
    """Make ``version`` the live one of the sources it has rows of, and of those named."""
    spark = written.sparkSession
    named = spark.createDataFrame([(s,) for s in source_names(sources)], "source string")
    rows = written.select("source", F.lit(1).alias("n")).unionByName(named.withColumn("n", F.lit(0)))
    entries = rows.groupBy("source").agg(F.sum("n").cast("bigint").alias("rows"))
    before = _manifest(spark, path)
    number = 1 + ((before.agg(F.max("number")).first()[0] or 0) if before is not None else 0)
    entries.select(
        "source", F.lit(version).alias("version"), F.lit(number).cast("bigint").alias("number"), "rows"
    ).coalesce(1).write.mode("append").parquet(f"{path}/_manifest")


def write_expense_counts(df: DataFrame, path: str, sources: Iterable[str] = ()) -> None:
    """Count the expenses of each source by category and amount; a source counted before is counted anew.

    Only the rows of ``df`` are read. What the table holds of other sources stays, so statistics
    over all history are kept up to date upload by upload.
    """
    require_columns(df, ["source_file", "Category", "Amount"], "write_expense_counts")
    source = F.coalesce(source_name(F.col("source_file")), F.lit(NO_SOURCE))
    pool = expenses(df).select(source.alias("source"), "Category", cents(-F.col("Amount")).alias("cents"))
    version = f"v-{uuid.uuid4().hex}"
    counted = frequencies(pool, ["source", "Category"], "cents").select("Category", "cents", "weight", "source")
    _publish(_write_version(counted, path, version, "parquet", ["source"]), path, version, sources)


def read_expense_counts(spark: SparkSession, path: str) -> DataFrame:
    """(Category, cents, weight) over the live counts of all sources; stored, for ``anomaly.profile_of_counts``."""
    live = read_sources(spark, path)
    return stored(live.groupBy("Category", "cents").agg(F.sum("weight").alias("weight")))


def read_sources(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """The live rows, with ``source`` and the month folder; filters on both prune folders."""
    live = live_versions(spark, path)
    if live is None:
        raise FileNotFoundError(f"No table of sources at {path}")
    kept = live.filter("rows > 0").select("source", "version")
    data = spark.read.format(fmt).load(path)
    return lookup(data, kept, ["source", "version"], how="left_semi").drop("version")
