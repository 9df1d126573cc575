"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each source gets a target number of words. A source whose target is several
times its size gives that many whole epochs; the rest is a sample without
replacement, in which a document of quality q comes ahead of others with a
chance in proportion to q: documents are ordered by -ln(u) / q, with u in (0, 1)
drawn from a hash of the document's id, and taken from the front until the
target is met. The document on the boundary is taken if that comes nearer.

Scale: no source is sorted as a whole. Order keys fall into buckets by their
logarithm; the sizes are summed by (source, bucket) on the map side, running
sums over that short table find the one bucket that holds the boundary, and only
its documents are sorted. The logarithm of an exponential variable has a density
of at most 1/e, and quality only shifts it. So a bucket is expected to hold at
most one in ``BUCKETS`` of a source's documents, whatever their qualities. A
source that holds a third of all rows is thus spread like any other. Draws
depend on ids alone (without an id, on the text): reruns agree.

Targets are held at ``most`` times a source's size; what that cuts off goes to
the other sources by weight. The number of distinct sources is taken to be
small (one task orders them by name).

Null text: size 0, taken 0 times. Null source: a source of its own, after all
others. Equal ids draw alike; repeated rows each count. A quality that is null,
not a number or not above 0 comes behind all others. Empty table: empty result.
Extra columns are carried in ``_row``.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import WORD, boxed, quoted, text_or_empty
from tallybook.operators.joins import lookup
from tallybook.session import stored

BUCKETS = 1 << 12
# Beyond the bucket of any key.
_LAST = 1 << 30
# Stands for quality 0; the keys it leads to are still finite.
_WORST = 1e-300
SEED = 7


def letter_quality(text: str) -> Column:
    """Nearer to 1 the less a text holds besides letters and white space; in (0, 1]."""
    rest = F.length(F.regexp_replace(text, r"[\p{L}\x20\x09-\x0D]+", ""))
    return 1 / (1 + 10 * rest / F.greatest(F.length(text), F.lit(1)))


def order_key(draw: Column, quality: Column) -> Column:
    """-ln(draw) / quality, above 0; ``draw`` is from 0 to 1."""
    worth = F.greatest(F.nanvl(F.coalesce(quality.cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(_WORST))
    return F.greatest(-F.log(draw) / worth, F.lit(_WORST))


def bucket_of(key: Column) -> Column:
    """Number of a key's bucket: buckets are e / ``BUCKETS`` wide in its logarithm."""
    return F.floor(F.log(key) * (BUCKETS / math.e)).cast("int")


def targets(totals: DataFrame, weights: Sequence[float], most: float) -> DataFrame:
    """(_source, _source_size, _target) from (_source, _source_size).

    Sources are ordered by name, weights repeat over them. Sorted by how soon
    they fill up, a source is full if the level that the remaining words would
    reach without it lies above its own.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    everything = Window.partitionBy()
    filled = Window.partitionBy().orderBy("_ratio", "_source")
    before, here_on = filled.rowsBetween(Window.unboundedPreceding, -1), filled.rowsBetween(0, Window.unboundedFollowing)
    ranked = (
        totals.withColumn("_i", F.row_number().over(Window.partitionBy().orderBy("_source")) - 1)
        .withColumn("_weight", F.get(cycle, F.col("_i") % len(weights)))
        .withColumn("_cap", F.col("_source_size") * most)
        .withColumn("_ratio", F.col("_cap") / F.col("_weight"))
        .withColumn("_all", F.sum("_source_size").over(everything))
        .withColumn("_left", F.col("_all") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_full", F.col("_left") / F.sum("_weight").over(here_on) >= F.col("_ratio"))
    )
    full, weight = F.when(F.col("_full"), F.col("_cap")).otherwise(0.0), F.when(~F.col("_full"), F.col("_weight"))
    level = (F.col("_all") - F.sum(full).over(everything)) / F.sum(weight).over(everything)
    return ranked.select(
        "_source",
        "_source_size",
        F.when(F.col("_full"), F.col("_cap")).otherwise(F.col("_weight") * level).cast("double").alias("_target"),
    )


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: Sequence[float] = (5, 2, 1),
    most: float = 3,
    quality: Column | None = None,
    seed: int = SEED,
    carry: Sequence[str] | None = None,
) -> DataFrame:
    """``_row``, ``_size``, ``_source_size``, ``_target`` and ``_copies``, how often the mix takes the document."""
    name = F.when(quoted(source).isNull(), F.lit("b")).otherwise(F.concat(F.lit("a"), quoted(source).cast("string")))
    drawn = F.xxhash64(F.lit(seed), F.col("_id"), F.when(F.col("_id").isNull(), F.col("_t")))
    draw = (F.shiftrightunsigned(drawn, 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    worth = letter_quality("_t") if quality is None else quality
    rows = stored(
        docs.select(
            boxed(docs, carry),
            name.alias("_source"),
            quoted(doc_id).alias("_id"),
            text_or_empty(text).alias("_t"),
            *([] if quality is None else [quality.alias("_worth")]),
        )
        .withColumn("_size", F.size(F.regexp_extract_all("_t", F.lit(WORD), F.lit(0))).cast("long"))
        .withColumn("_key", order_key(draw, worth if quality is None else F.col("_worth")))
        .withColumn("_bucket", bucket_of(F.col("_key")))
        .select("_row", "_source", "_id", "_size", "_key", "_bucket")
    )
    by_bucket = stored(rows.groupBy("_source", "_bucket").agg(F.sum("_size").alias("_held")))
    wanted = targets(by_bucket.groupBy("_source").agg(F.sum("_held").alias("_source_size")), weights, most)
    wanted = wanted.withColumn(
        "_epochs", F.when(F.col("_source_size") > 0, F.floor(F.col("_target") / F.col("_source_size"))).otherwise(0)
    ).withColumn("_rest", F.col("_target") - F.col("_epochs") * F.col("_source_size"))
    running = Window.partitionBy("_source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)
    # The bucket in which the sample ends: the first whose running sum reaches what is wanted.
    reached = by_bucket.withColumn("_sum", F.sum("_held").over(running)).join(wanted, "_source")
    ends = reached.groupBy("_source", "_source_size", "_target", "_epochs", "_rest").agg(
        F.min(F.when(F.col("_sum") >= F.col("_rest"), F.struct("_bucket", "_sum", "_held"))).alias("_end")
    )
    plan = stored(
        ends.select(
            "_source",
            "_source_size",
            "_target",
            "_epochs",
            F.coalesce("_end._bucket", F.lit(_LAST)).alias("_edge"),
            (F.col("_rest") - F.col("_end._sum") + F.col("_end._held")).alias("_within"),
        )
    )
    planned = lookup(rows, plan, ["_source"])
    inside = planned.filter("_bucket != _edge").withColumn("_more", (F.col("_bucket") < F.col("_edge")).cast("int"))
    order = Window.partitionBy("_source").orderBy("_key", "_id", "_size")
    before = F.coalesce(F.sum("_size").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    edge = planned.filter("_bucket = _edge").withColumn(
        "_more", (before + F.col("_size") / 2 <= F.col("_within")).cast("int")
    )
    return inside.unionByName(edge).select(
        "_row", "_size", "_source_size", "_target", (F.col("_epochs") + F.col("_more")).cast("int").alias("_copies")
    )


def mixed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, columns as in ``docs``."""
    taken = mix(docs, doc_id, text, source, **options).filter("_copies > 0")
    return taken.select("_row", F.explode(F.array_repeat(F.lit(1), F.col("_copies")))).select("_row.*")
