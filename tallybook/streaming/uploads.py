"""Exports that keep arriving in a folder, classified as they come.

Cleaning and matching are stateless expressions, so the batch plan applies to
each batch of new files as it is. Repeats are judged per source file, and a
file lies wholly in one batch, so that needs no state either.

A bad row does not stop the stream: rows of another width than the header and
rows whose date or amount cannot be read go to a quarantine table, all others
are classified. Both tables are written by what the batch holds, so a batch
that is repeated after a failure leaves each row once.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallybook.operators.classify import Rules
from tallybook.operators.model import CONFIDENCE, classify_two_stage
from tallybook.schema import named
from tallybook.session import checkpoint_folder, stored
from tallybook.sources.exports import accepted, csv_reader, decoded, ingest_tolerant, rejected
from tallybook.sources.history import write_categorized
from tallybook.sources.layouts import LINEAGE

# A row whose cells do not fit the header, as it stands in the file; NULL for all others.
MALFORMED = "_malformed"


def watch_exports(
    spark: SparkSession, folder: str, columns: Sequence[str], encoding: str = "auto", multiline: bool = False
) -> DataFrame:
    """A stream of raw rows from CSV files that share the header ``columns``, read as ``read_export`` does.

    A row with more or fewer cells than the header keeps its text in
    ``_malformed``; a file with another header fails.
    """
    # In automatic mode names are read as Latin-1 first, like the cells.
    spelt = [c.encode().decode("latin-1") if encoding == "auto" else c for c in columns]
    schema = ", ".join(f"{_quoted(c)} string" for c in [*spelt, MALFORMED])
    raw = (
        csv_reader(spark.readStream.schema(schema), encoding, multiline)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", MALFORMED)
        .csv(folder)
    )
    cells = decoded(spelt, encoding)
    (line,) = decoded([MALFORMED], encoding)
    return raw.select(*cells, line, F.col("_metadata.file_path").alias(LINEAGE))


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def sort_out(raw: DataFrame, bank: str | None = None, currency: str | None = None, **cleaning: Any) -> tuple[DataFrame, DataFrame]:
    """(clean, bad) rows of one batch; the batch is read, parsed and stored once.

    Bad rows are (source_file, reason, line, date, amount, description): of a
    malformed one the line is known, of others the cells.
    """
    raw = stored(raw)
    whole, torn = raw, None
    if MALFORMED in raw.columns:
        whole = raw.filter(named(MALFORMED).isNull()).drop(MALFORMED)
        torn = raw.filter(named(MALFORMED).isNotNull())
    tagged = stored(ingest_tolerant(whole, bank, currency, **cleaning))
    text = F.lit(None).cast("string")
    bad = rejected(tagged).select(
        LINEAGE,
        F.col("reject_reason").alias("reason"),
        text.alias("line"),
        F.col("_raw_date").alias("date"),
        F.col("_raw_amount").alias("amount"),
        F.col("Description").alias("description"),
    )
    if torn is not None:
        empty = [text.alias(c) for c in ("date", "amount", "description")]
        bad = bad.unionByName(torn.select(LINEAGE, F.lit("width").alias("reason"), named(MALFORMED).alias("line"), *empty))
    return accepted(tagged), bad


def classify_uploads(
    raw: DataFrame,
    rules: Rules,
    output: str,
    name: str,
    model: PipelineModel | None = None,
    threshold: float = CONFIDENCE,
    bank: str | None = None,
    currency: str | None = None,
    quarantine: str | None = None,
    **cleaning: Any,
) -> StreamingQuery:
    """Process all files there are, then stop; run again to take up new ones.

    A batch replaces the folders of its own sources only, and in the
    quarantine (``<output>_quarantine`` unless stated) the folder of its own
    number, so one repeated after a failure leaves the same result.
    ``cleaning`` are further options of ``ingest_tolerant``.
    """
    aside = quarantine or f"{output.rstrip('/')}_quarantine"

    def store(batch: DataFrame, number: int) -> None:
        clean, bad = sort_out(batch, bank, currency, **cleaning)
        bad.write.mode("overwrite").parquet(f"{aside}/upload={name}/batch={number}")
        write_categorized(classify_two_stage(clean, rules, model, threshold), output)

    return (
        raw.writeStream.foreachBatch(store)
        .option("checkpointLocation", f"{checkpoint_folder(raw.sparkSession)}/uploads/{name}")
        .trigger(availableNow=True)
        .start()
    )
