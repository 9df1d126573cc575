"""Keyword rules: the first category, in rule order, with a contained keyword."""

from __future__ import annotations

import operator
from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import groupby

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallybook.operators.joins import BROADCAST_KEYS, lookup
from tallybook.operators.numbering import number_rows
from tallybook.schema import RULES, UNCATEGORIZED, named, require_columns
from tallybook.session import stored

Rules = Mapping[str, Sequence[str]]
Blocks = list[tuple[str, list[str]]]

# Up to this many keywords become one CASE expression in the scan stage;
# longer tables are matched by a join on substrings.
INLINE_KEYWORDS = 1_000
PIECE = 8


def rules_table(spark: SparkSession, rules: Rules) -> DataFrame:
    rows = [
        (category, i, keyword, j)
        for i, (category, keywords) in enumerate(rules.items())
        for j, keyword in enumerate(keywords)
    ]
    return spark.createDataFrame(rows, RULES)


def _usable(rules: DataFrame) -> DataFrame:
    """Rules that can decide something: with a category and a keyword."""
    return rules.filter(F.col("keyword").isNotNull() & F.col("category").isNotNull())


def _inline_rules(rules: DataFrame, limit: int) -> Blocks | None:
    """The rules as blocks of one category, in rule order, if there are at most ``limit`` of them.

    A category that comes back further down is a block of its own there.
    """
    rows = _usable(rules).limit(limit + 1).collect()
    if len(rows) > limit:
        return None
    rows = sorted(rows, key=lambda r: (r["cat_order"], r["kw_order"], r["category"]))
    return [(category, [r["keyword"] for r in block]) for category, block in groupby(rows, key=lambda r: r["category"])]


def _has_any(text: Column, keywords: Sequence[str]) -> Column:
    """One of the keywords is contained.

    A list of some length is a loop over a constant array: spelled out as
    ORs, it would make generated methods too long for the JIT compiler.
    """
    words = [F.lower(F.lit(k)) for k in keywords]
    if len(words) > 3:
        return F.exists(F.array(*words), lambda k: F.contains(text, k))
    return reduce(operator.or_, [F.contains(text, k) for k in words])


def _classify_inline(df: DataFrame, blocks: Blocks) -> DataFrame:
    # The lowered text is a column of its own, so it is computed once per row.
    hit = F
    for category, keywords in blocks:
        if keywords:
            hit = hit.when(_has_any(F.col("_text"), keywords), F.lit(category))
    category = F.lit(UNCATEGORIZED) if hit is F else hit.otherwise(F.lit(UNCATEGORIZED))
    return (
        df.withColumn("_text", F.lower("Description"))
        .withColumn("Category", category)
        .drop("_text")
    )


def _cuts(text: Column, size: int) -> Column:
    """All substrings of ``size`` characters."""
    starts = F.sequence(F.lit(1), F.length(text) - size + 1)
    cut = F.transform(starts, lambda i: F.substring(text, i, F.lit(size)))
    return F.when(F.length(text) >= size, cut).otherwise(F.array().cast("array<string>"))


def keyword_pieces(rules: DataFrame) -> DataFrame:
    """(keyword, best, piece): each distinct keyword, the first rule that has it, and its pieces.

    Pieces are the substrings of ``PIECE`` characters, or the whole of a shorter keyword.
    """
    keyword = F.col("keyword")
    return (
        _usable(rules)
        .groupBy(F.lower("keyword").alias("keyword"))
        .agg(F.min(F.struct(F.struct("cat_order", "kw_order").alias("rank"), "category")).alias("best"))
        .filter(keyword != "")
        .withColumn("piece", F.explode(F.when(F.length(keyword) < PIECE, F.array(keyword)).otherwise(F.array_distinct(_cuts(keyword, PIECE)))))
    )


def rarest_pieces(keyed: DataFrame, hits: DataFrame) -> DataFrame:
    """(keyword, best, piece): of each keyword the piece that occurs least in the descriptions.

    ``hits`` has a ``piece`` for each place in a description where one is found. A
    keyword with a piece that is found nowhere matches none and is left out.
    """
    held = hits.groupBy("piece").agg(F.count("*").alias("n"))
    rarest = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "piece")).alias("_rarest")
    return (
        keyed.join(held, "piece", "left")
        .groupBy("keyword")
        .agg(F.min("best").alias("best"), rarest)
        .filter("_rarest.n > 0")
        .select("keyword", "best", F.col("_rarest.piece").alias("piece"))
    )


def match_by_substring(
    descriptions: DataFrame, rules: DataFrame, max_broadcast: int = BROADCAST_KEYS
) -> DataFrame:
    """(Description, best) for every description that some keyword matches.

    ``best`` is the struct (rank, category) of the first rule. Distinct
    descriptions are stored, cut once to count the pieces of keywords in them,
    and once more to look for each keyword where its rarest piece is, so that
    keywords that begin alike do not meet in one key; what meets is verified
    whole. The work grows with text length and true matches, not with
    descriptions times keywords. Of both cuts only pieces that may be wanted are
    shuffled (``joins.thinned``): of the second about as many as there are matches.
    """
    keyed = stored(keyword_pieces(rules))
    # At most PIECE rows.
    sizes = [r["n"] for r in keyed.select(F.length("piece").alias("n")).distinct().collect()]
    none = F.array().cast("array<string>")
    text = F.col("_text")
    pieces = F.flatten(F.array(none, *[_cuts(text, n) for n in sorted(sizes)]))
    distinct = stored(descriptions.select("Description").filter(F.col("Description").isNotNull()).distinct())
    exploded = distinct.withColumn("_text", F.lower("Description")).withColumn("piece", F.explode(pieces))
    wanted = stored(keyed.select("piece").distinct())
    hits = lookup(exploded.select("piece"), wanted, ["piece"], max_rows=max_broadcast, how="inner", thin=True)
    anchors = stored(rarest_pieces(keyed, hits))
    return (
        lookup(exploded, anchors, ["piece"], max_rows=max_broadcast, how="inner", thin=True)
        .filter(F.contains(text, F.col("keyword")))
        .groupBy("Description")
        .agg(F.min("best").alias("best"))
    )


def _classify_by_join(df: DataFrame, rules: DataFrame) -> DataFrame:
    matched = lookup(df, stored(match_by_substring(df, rules)), ["Description"])
    # An empty keyword is contained in every text.
    empty = (
        _usable(rules).filter(F.col("keyword") == "")
        .agg(F.min(F.struct(F.struct("cat_order", "kw_order").alias("rank"), "category")))
        .scalar()
    )
    found = F.when(F.col("Description").isNotNull(), F.least(F.col("best"), empty))
    return matched.withColumn("_found", found).select(
        *map(named, df.columns), F.coalesce("_found.category", F.lit(UNCATEGORIZED)).alias("Category")
    )


def classify(
    df: DataFrame, rules: Rules | DataFrame, inline_keywords: int = INLINE_KEYWORDS
) -> DataFrame:
    """Append ``Category``; no match, or no description, is ``Uncategorized``.

    A rule without keyword or category decides nothing, whatever the number of rules.
    """
    require_columns(df, ["Description"], "classify")
    base = df.drop("Category")
    if isinstance(rules, DataFrame):
        inline = _inline_rules(rules, inline_keywords)
        table = rules
    else:
        blocks = [(c, [k for k in keywords if k is not None]) for c, keywords in rules.items() if c is not None]
        inline = blocks if sum(len(k) for _, k in blocks) <= inline_keywords else None
        table = None if inline is not None else rules_table(df.sparkSession, rules)
    return _classify_by_join(base, table) if inline is None else _classify_inline(base, inline)


def coverage(df: DataFrame) -> DataFrame:
    """One row: total, classified and uncategorized counts."""
    left = F.count_if(F.col("Category") == UNCATEGORIZED)
    return df.agg(
        F.count("*").alias("total"),
        (F.count("*") - left).alias("classified"),
        left.alias("uncategorized"),
    )


def merge_corrections(rules: DataFrame, corrections: DataFrame) -> DataFrame:
    """Rules plus the keywords of a ``(description, category, keyword)`` table.

    A keyword its category already has adds nothing. New keywords come after
    the category's own; new categories after all others, numbered in ranges
    (a job when called).
    """
    keyword = F.lower(F.btrim("keyword"))
    new = (
        corrections.select(F.btrim("category").alias("category"), keyword.alias("keyword"))
        .filter((F.col("keyword") != "") & (F.col("category") != ""))
        .distinct()
        .join(rules.select("category", "keyword"), ["category", "keyword"], "left_anti")
    )
    ends = rules.groupBy("category").agg(
        F.min("cat_order").alias("cat_order"), F.max("kw_order").alias("kw_end")
    )
    last = F.coalesce(rules.agg(F.max("cat_order")).scalar(), F.lit(-1))
    unknown = new.select("category").distinct().join(ends, "category", "left_anti")
    fresh = number_rows(unknown, ["category"], "fresh_order")
    placed = new.join(ends, "category", "left").join(fresh, "category", "left")
    added = placed.select(
        "category",
        F.coalesce("cat_order", last + 1 + F.col("fresh_order")).cast("int").alias("cat_order"),
        "keyword",
        (
            F.coalesce("kw_end", F.lit(-1))
            + F.row_number().over(Window.partitionBy("category").orderBy("keyword"))
        )
        .cast("int")
        .alias("kw_order"),
    )
    return rules.select(*RULES.names).unionByName(added)


def sort_rules(rules: DataFrame) -> DataFrame:
    """The order a saved rule file has: categories, then distinct keywords, by name."""
    sets = rules.groupBy("category").agg(F.sort_array(F.collect_set("keyword")).alias("keywords"))
    numbered = number_rows(sets, ["category"], "cat_order")
    return numbered.select("category", F.col("cat_order").cast("int").alias("cat_order"), F.posexplode("keywords").alias("kw_order", "keyword")).select(
        *RULES.names
    )


def apply_corrections(df: DataFrame, rules: DataFrame, corrections: DataFrame) -> DataFrame:
    """Classify again with the merged rules, then honour per-description choices.

    A correction names a description that no rule matched; where its keyword
    does not settle the matter (or there is none), its category applies to
    every uncategorized row with that description.
    """
    again = classify(df, merge_corrections(rules, corrections))
    chosen = stored(
        corrections.filter(F.btrim("category") != "")
        .groupBy(F.col("description").alias("Description"))
        .agg(F.min(F.btrim("category")).alias("_chosen"))
    )
    joined = lookup(again, chosen, ["Description"])
    settled = F.when(
        F.col("Category") == UNCATEGORIZED, F.coalesce("_chosen", "Category")
    ).otherwise(F.col("Category"))
    return joined.withColumn("Category", settled).select(*map(named, again.columns))
