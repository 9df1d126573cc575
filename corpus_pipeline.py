"""From raw documents to token counts: the stages of a training-data pipeline.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as
Parquet and read back as the next stage's ``docs``. All but the last return the
columns of the documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.llm import bpe, mixing, personal, quality, simhash
from tallybook.session import stored


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weighed rules reject go."""
    return quality.keep_good(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints (4-word shingles, 4 bits at most) the document of the smallest id stays."""
    return simhash.keep_one(docs, width=4, max_bits=4)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind in brackets."""
    return personal.without_personal_data(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mixed(docs)


def bpe_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and whether they decode to its text."""
    coded = bpe.encode(docs, carry=["doc_id", "text"], decoded=True)
    return coded.select(
        "_row.doc_id",
        bpe.token_count("_ids").alias("n_tokens"),
        F.sha2("_ids", 256).alias("ids_sha256"),
        F.sha2("_text", 256).alias("decoded_sha256"),
        (F.col("_text") == F.coalesce("_row.text", F.lit(""))).alias("round_trip"),
    )


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("simhash_dedup", simhash_dedup),
    ("personal_data", personal_data),
    ("mix_sources", mix_sources),
    ("bpe_tokens", bpe_tokens),
]

# Fitted models and hashes that SQL lacks decide here; tests compare with brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, over the whole table of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
