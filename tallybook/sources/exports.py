"""Scan of raw exports and the cleaning plan from raw to canonical rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from pathlib import PurePosixPath

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.parse import MONTH_FIRST, bare_number, day_text, or_fail, read_amount, read_any_day, read_day
from tallybook.functions.text import mask_cards
from tallybook.operators.dedupe import drop_repeats, keep_first, repeat_key
from tallybook.operators.joins import lookup
from tallybook.schema import MONEY, named
from tallybook.session import stored
from tallybook.sources.columns import map_columns
from tallybook.sources.layouts import (
    LINEAGE,
    RAW_AMOUNT,
    RAW_DATE,
    Options,
    detect_layout,
    fill_currency,
)


def _redecode(cell: Column) -> Column:
    """Bytes read as Latin-1: UTF-8 where they are valid UTF-8, else as they are. ASCII is both."""
    raw = F.encode(cell, "ISO-8859-1").cast("string")
    return F.when(F.octet_length(cell) == F.length(cell), cell).otherwise(F.coalesce(F.try_validate_utf8(raw), cell))


def _redecode_name(name: str) -> str:
    try:
        name = name.encode("latin-1").decode("utf-8")
    except UnicodeError:
        pass
    return name.lstrip("﻿")


def csv_reader(reader, encoding: str = "auto", multiline: bool = False):
    """A batch or stream reader of exports with their header, for all ways in alike.

    Cells are text; a row is held against the header as a whole, also where
    few columns are read. What happens to one that does not fit is left to the
    mode.
    """
    return (
        reader.option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .option("multiLine", multiline)
        .option("columnPruning", False)
        .option("encoding", "ISO-8859-1" if encoding == "auto" else encoding)
    )


def decoded(columns: Sequence[str], encoding: str = "auto") -> list[Column]:
    """Cells and names of a frame that ``csv_reader`` read, each as UTF-8 or Latin-1 if ``encoding`` is auto."""
    if encoding == "auto":
        return [_redecode(named(c)).alias(_redecode_name(c)) for c in columns]
    return [named(c).alias(c.lstrip("﻿")) for c in columns]


def read_export(
    spark: SparkSession,
    paths: str | Sequence[str],
    encoding: str = "auto",
    multiline: bool = False,
) -> DataFrame:
    """CSV exports that share one header, as text columns plus ``source_file``.

    ``encoding="auto"`` decides per cell: valid UTF-8 is taken as such, all
    else as Latin-1. A stated charset is used as it is. Typing is left to
    ``ingest``; no pass over the data infers a schema. A file whose header
    differs from the others' fails the job, as does a row with more or fewer
    cells than the header. Quoted line breaks need ``multiline``, which keeps a
    file from being split.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    for path in paths:
        suffix = PurePosixPath(path.rstrip("/")).suffix.lower()
        if suffix and suffix not in (".csv", ".gz", ".bz2") and "*" not in suffix:
            raise ValueError(f"{path} is no CSV export (.csv, also .gz or .bz2)")
    reader = csv_reader(spark.read, encoding, multiline).option("mode", "FAILFAST")
    try:
        raw = reader.csv(paths)
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"No export at {paths}") from err
        raise
    return raw.select(*decoded(raw.columns, encoding), F.col("_metadata.file_path").alias(LINEAGE))


def _is_text(df: DataFrame, name: str) -> bool:
    return dict(df.dtypes)[name] == "string"


def choose_formats(df: DataFrame, formats: Sequence[str] = MONTH_FIRST, pivot_year: int | None = None) -> DataFrame:
    """(source_file, _format): for each source the place in ``formats`` of the one its dates are written in.

    That is the format which most cells fit, the first in the list of equals;
    so 01/02/2024 is read as 13/02/2024 in the same file must be. Cells are
    counted by their text without the time of day, so a format is tried once a
    source and day, whatever the number of rows. A frame without ``source_file``
    is one source, and has one row here, without that column.
    """
    keys = [LINEAGE] if LINEAGE in df.columns else []
    texts = (
        df.filter(F.col("Date").isNotNull())
        .groupBy(*keys, day_text(F.col("Date")).alias("_day"))
        .agg(F.count("*").alias("_rows"))
    )
    fits = [
        F.sum(F.when(read_day(F.col("_day"), f, pivot_year).isNotNull(), F.col("_rows")).otherwise(0)) for f in formats
    ]
    votes = texts.groupBy(*keys).agg(F.array(*fits).alias("_votes"))
    place = F.array_position("_votes", F.array_max("_votes")) - 1
    return votes.select(*keys, place.cast("int").alias("_format")).filter("_format IS NOT NULL")


def clean_dates(
    df: DataFrame,
    formats: Sequence[str] = MONTH_FIRST,
    pivot_year: int | None = None,
    strict: bool = True,
    chosen: DataFrame | None = None,
) -> DataFrame:
    """``Date`` text to a date. A missing or unreadable date fails the job if strict.

    With ``chosen``, the stored table of ``choose_formats``, each source is
    read in its own format, without it each cell in the first that fits.
    """
    if not _is_text(df, "Date"):
        return df.withColumn("Date", F.col("Date").cast("date"))
    columns, df = df.columns, df.withColumn("_day", day_text(F.col("Date")))
    if chosen is None:
        day = read_any_day(F.col("_day"), formats, pivot_year)
    else:
        if LINEAGE in chosen.columns:
            df = lookup(df, chosen, [LINEAGE])
        else:
            df = df.withColumn("_format", chosen.select("_format").scalar())
        # Formats that no source is written in would only swell the generated code. A source without choice has the first.
        taken = {0} | {r["_format"] for r in chosen.select("_format").distinct().collect()}
        place, day = F.coalesce("_format", F.lit(0)), F
        for i in sorted(taken):
            day = day.when(place == i, read_day(F.col("_day"), formats[i], pivot_year))
    day = or_fail(day, F.col("Date"), "date", nullable=False) if strict else day
    return df.withColumn("Date", day).select(*map(named, columns))


def clean_amounts(df: DataFrame, strict: bool = True, dtype: str = MONEY) -> DataFrame:
    """``Amount`` to signed money. A missing amount stays NULL; bad text fails if strict, so do digits past ``dtype``'s."""
    if not _is_text(df, "Amount"):
        return df.withColumn("Amount", F.col("Amount").cast(dtype))
    columns, df = df.columns, df.withColumn("_number", bare_number(F.col("Amount")))
    amount = read_amount(F.col("_number"), dtype)
    amount = or_fail(amount, F.col("Amount"), "amount", nullable=True) if strict else amount
    return df.withColumn("Amount", amount).select(*map(named, columns))


def mask_descriptions(df: DataFrame) -> DataFrame:
    return df.withColumn("Description", mask_cards(F.col("Description")))


def _canonical(df: DataFrame, extra: Sequence[str] = ()) -> DataFrame:
    names = ["Date", "Description", "Amount", "Currency", LINEAGE, *extra]
    return df.select(*[n for n in names if n in df.columns])


_RAW = (RAW_DATE, RAW_AMOUNT)


def _rest(df: DataFrame, but: Sequence[str] = ()) -> Column:
    """The columns beside the key of repeats and ``but``."""
    return F.struct(*[named(c) for c in df.columns if c not in repeat_key(df) and c not in but])


def _without_repeats(df: DataFrame) -> DataFrame:
    """Among repeats that differ in other columns, the least of those stays."""
    keys = repeat_key(df)
    return keep_first(df, keys, _rest(df)) if set(df.columns) - set(keys) else drop_repeats(df)


def _chosen(df: DataFrame, formats: Sequence[str], pivot_year: int | None, mixed: bool) -> DataFrame | None:
    """The stored choice of a format for each source, where there is something to choose."""
    if mixed or len(formats) < 2 or not _is_text(df, "Date"):
        return None
    return stored(choose_formats(df, formats, pivot_year))


def ingest(
    raw: DataFrame,
    bank: str | None = None,
    currency: str | None = None,
    mapping: Mapping[str, str] | None = None,
    date_formats: Sequence[str] | None = None,
    pivot_year: int | None = None,
    dedupe_after: bool = False,
    keep_extra: bool = False,
    mixed: bool = False,
    dtype: str = MONEY,
) -> DataFrame:
    """Raw export rows to canonical transactions.

    Layout, column names, removal of repeats, dates, amounts, card masking,
    currency. Repeats are judged on the text as it stands in the export, so
    ``$5.00`` and ``5.00`` differ; ``dedupe_after=True`` judges clean values.
    ``keep_extra`` carries the export's other columns along, as text.
    A source writes its dates in one format, which a first pass over the date
    column finds (``choose_formats``; a job when called); with ``mixed`` each
    cell takes the first format that fits, in one lazy plan. Statements of a
    known bank are read in that bank's formats, cell by cell.
    Bad values fail the job; ``ingest_tolerant`` keeps them apart instead.
    """
    formats = tuple(date_formats) if date_formats else MONTH_FIRST
    options = Options(currency, tuple(date_formats) if date_formats else None, pivot_year, dtype=dtype)
    df = detect_layout(raw.columns, bank).normalise(raw, options)
    df = fill_currency(map_columns(df, mapping))
    if not keep_extra:
        df = _canonical(df)
    chosen = _chosen(df, formats, pivot_year, mixed)
    if not dedupe_after:
        df = _without_repeats(df)
    df = clean_dates(df, formats, pivot_year, chosen=chosen)
    df = mask_descriptions(clean_amounts(df, dtype=dtype))
    return _without_repeats(df) if dedupe_after else df


def _without_clean_repeats(tagged: DataFrame) -> DataFrame:
    """Repeats judged on clean values; of bad rows, whose values are NULL, on their texts."""
    bad = F.col("reject_reason").isNotNull()
    told = tagged.withColumns({"_k1": F.when(bad, F.col(RAW_DATE)), "_k2": F.when(bad, F.col(RAW_AMOUNT))})
    return keep_first(told, [*repeat_key(told), "_k1", "_k2"], _rest(told, ("_k1", "_k2"))).drop("_k1", "_k2")


def ingest_tolerant(
    raw: DataFrame,
    bank: str | None = None,
    currency: str | None = None,
    mapping: Mapping[str, str] | None = None,
    date_formats: Sequence[str] | None = None,
    pivot_year: int | None = None,
    mixed: bool = False,
    dtype: str = MONEY,
    dedupe_after: bool = False,
    keep_extra: bool = False,
) -> DataFrame:
    """As ``ingest``, but bad rows stay in, tagged.

    ``reject_reason`` is NULL for a clean row, else ``date``, ``amount`` or
    ``date,amount``; the texts are kept in ``_raw_date`` and ``_raw_amount``.
    """
    formats = tuple(date_formats) if date_formats else MONTH_FIRST
    options = Options(
        currency, tuple(date_formats) if date_formats else None, pivot_year, strict=False, dtype=dtype
    )
    layout = detect_layout(raw.columns, bank)
    df = fill_currency(map_columns(layout.normalise(raw, options), mapping))
    typed_by_layout = RAW_DATE in df.columns
    chosen = _chosen(df, formats, pivot_year, mixed)
    if not keep_extra:
        df = _canonical(df, [RAW_DATE, RAW_AMOUNT])
    if not dedupe_after:
        df = _without_repeats(df) if keep_extra else drop_repeats(df)
    # Copies of key columns: made after the repeats are gone, which are then removed without sorting.
    if not typed_by_layout:
        df = df.withColumns({RAW_DATE: F.col("Date"), RAW_AMOUNT: F.col("Amount")})
    df = clean_dates(df, formats, pivot_year, strict=False, chosen=chosen)
    df = clean_amounts(df, strict=False, dtype=dtype)
    bad_amount = F.col("Amount").isNull()
    if not typed_by_layout:
        bad_amount = bad_amount & F.col(RAW_AMOUNT).isNotNull()
    reason = F.concat_ws(
        ",",
        F.when(F.col("Date").isNull(), F.lit("date")),
        F.when(bad_amount, F.lit("amount")),
    )
    # A list of one: the planner moves filters on the reason past a plain column, with all the parsing spelled out in them.
    one = F.explode(F.array(F.nullif(reason, F.lit(""))))
    df = mask_descriptions(df.withColumn("reject_reason", one))
    # Bad rows whose cells became NULL alike are told apart by their texts.
    return _without_clean_repeats(df) if dedupe_after else df


def accepted(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reject_reason").isNull()).drop(
        RAW_DATE, RAW_AMOUNT, "reject_reason"
    )


def rejected(tagged: DataFrame) -> DataFrame:
    return tagged.filter(F.col("reject_reason").isNotNull()).drop("Date", "Amount")


def check_rejects(tagged: DataFrame, samples: int = 5) -> None:
    """Raise ``ValueError`` with the count and a few texts if any row is bad."""
    bad = rejected(tagged)
    counts = {r["reject_reason"]: r["n"] for r in count_rejects(tagged).collect()}
    if counts:
        shown = [
            (r[RAW_DATE], r[RAW_AMOUNT])
            for r in bad.select(RAW_DATE, RAW_AMOUNT).orderBy(RAW_DATE, RAW_AMOUNT).take(samples)
        ]
        raise ValueError(f"Cannot parse {sum(counts.values())} row(s): {counts}. Examples: {shown}")


def count_rejects(tagged: DataFrame) -> DataFrame:
    """Number of bad rows per reason; at most three rows."""
    return rejected(tagged).groupBy("reject_reason").agg(F.count("*").alias("n"))
