"""A whole run: raw exports to a stored classified table, analyses and sinks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.operators.classify import Rules
from tallybook.operators.model import CONFIDENCE, classify_two_stage, load_model
from tallybook.plans import report
from tallybook.sources.banks import ingest_banks, read_banks
from tallybook.sources.exports import ingest_tolerant
from tallybook.sources.history import source_names
from tallybook.sources.ledger import read_sources, write_sources


def classify_exports(
    spark: SparkSession,
    paths: str | Sequence[str],
    rules: Rules | DataFrame,
    model_folder: str | None = None,
    threshold: float = CONFIDENCE,
    bank: str | None = None,
    currency: str | None = None,
    mapping: Mapping[str, str] | None = None,
    encoding: str = "auto",
    multiline: bool = False,
    **cleaning: Any,
) -> DataFrame:
    """Exports, of one bank or of several, read, cleaned and classified.

    ``cleaning`` are further options of ``ingest``: date formats, pivot year,
    when repeats are judged, extra columns.
    """
    raws = read_banks(spark, paths, encoding, multiline)
    clean = ingest_banks(raws, bank, mapping, currency=currency, **cleaning)
    return classify_two_stage(clean, rules, _model(model_folder), threshold)


def _model(folder: str | None) -> PipelineModel | None:
    return load_model(folder) if folder else None


def _of_sources(table: DataFrame, files: Iterable[str]) -> DataFrame:
    """The rows of these files, as a filter on the table's folders; it may hold those of earlier runs as well."""
    return table.filter(F.col("source").isin(source_names(files)))


def run(
    spark: SparkSession,
    paths: str | Sequence[str],
    rules: Rules | DataFrame,
    output: str,
    budgets: DataFrame | None = None,
    model_folder: str | None = None,
    threshold: float = CONFIDENCE,
    bank: str | None = None,
    currency: str | None = None,
    mapping: Mapping[str, str] | None = None,
    encoding: str = "auto",
    multiline: bool = False,
    with_anomalies: bool = False,
    with_report: bool = False,
    **cleaning: Any,
) -> DataFrame:
    """Classify exports, store them under ``output`` and write payload and report.

    The classified rows are written once and read back, so every analysis
    scans a columnar table and no step repeats parsing or matching. Bad rows fail the run with their number
    and examples, and then the table stays as it was. A source that was stored
    before is replaced, those of other runs are kept; the analyses are of this
    run's.
    """
    table = f"{output}/transactions"
    raws = read_banks(spark, paths, encoding, multiline)
    files = [f for raw in raws for f in raw.inputFiles()]
    tagged = ingest_banks(raws, bank, mapping, clean=ingest_tolerant, currency=currency, **cleaning)
    classified = classify_two_stage(tagged, rules, _model(model_folder), threshold)
    counted = write_sources(classified, table, sources=files)
    stored = _of_sources(read_sources(spark, table), files)
    report.write_payload(stored, f"{output}/payload", budgets, with_anomalies)
    report.write_coverage(spark, counted, f"{output}/payload")
    if with_report:
        report.write_report(stored, f"{output}/exports", budgets)
    return stored
