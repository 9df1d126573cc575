"""Reply trees as chat text: the best root-to-leaf paths, each formatted as one conversation.

A message names its parent. Self-joins by pointer doubling give every message
its depth and the score of its path in a number of joins that grows with the
logarithm of the depth; leaves are ranked by path score, and the chosen paths
are expanded by the same doubled pointers. Text joins only the chosen paths.

The template writes ``<|im_start|>role\\ntext<|im_end|>\\n`` for each turn. In
texts and roles a backslash goes between ``<`` and ``|`` (one more, where some
are there already), so no text can end or begin a turn, and taking one away
restores it. Line breaks in a role are written as ``\\n``. The loss mask is a list
of spans of the formatted text, one for each assistant text.

DataFrame functions only. All joins are on (conversation, message), so a long
conversation is spread; only ranking and the formatted row itself, which is one
value, bring a conversation's chosen turns together.

Null role or text: as empty. Parents that are null or not in the conversation:
the message is a root. Rows that share conversation and message: the one of
the smallest (parent, role, text) stands. Messages on or under a circle of
parents have no root and belong to no path. Equal scores: the longer path, then
the smaller leaf. Null scores count 0. Null conversation ids: one conversation.
Empty table: empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallybook.llm.common import quoted
from tallybook.session import stored

START, END = "<|im_start|>", "<|im_end|>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def _nodes(messages: DataFrame, conv: str, node: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    worth = F.coalesce(quoted(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    return (
        messages.select(
            quoted(conv).alias("conv"),
            quoted(node).alias("node"),
            F.struct(
                quoted(parent).alias("parent"),
                F.coalesce(quoted(role), F.lit("")).alias("role"),
                F.coalesce(quoted(text), F.lit("")).alias("text"),
                worth.alias("score"),
            ).alias("m"),
        )
        .groupBy("conv", "node")
        .agg(F.min("m").alias("m"))
        .select("conv", "node", "m.*")
    )


def _same(a: str, b: str, left: str = "node", right: str = "node") -> Column:
    return F.col(f"{a}.conv").eqNullSafe(F.col(f"{b}.conv")) & (F.col(f"{a}.{left}") == F.col(f"{b}.{right}"))


def doubled(nodes: DataFrame) -> list[DataFrame]:
    """Tables of (conv, node, jump, depth, total); the k-th jumps over 2 ** k messages.

    ``depth`` and ``total`` cover the messages jumped over. A message whose
    jump is null has arrived, with the figures of its whole path, and takes no
    part in later tables; so only long paths cost further rounds. Stops when
    all have arrived, or when jumps can only run in circles.
    """
    now = (
        nodes.alias("n")
        .join(nodes.select("conv", "node").alias("p"), _same("n", "p", "parent"), "left")
        .select("n.conv", "n.node", F.col("p.node").alias("jump"), F.lit(1).alias("depth"), F.col("n.score").alias("total"))
    )
    tables = [stored(now)]
    longest = tables[0].groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    while 1 << (len(tables) - 1) <= longest and not tables[-1].filter("jump is not null").isEmpty():
        going = tables[-1].filter("jump is not null")
        tables.append(
            stored(
                going.alias("n")
                .join(arrived(tables).unionByName(going).alias("p"), _same("n", "p", "jump"), "left")
                .select(
                    "n.conv",
                    "n.node",
                    "p.jump",
                    (F.col("n.depth") + F.coalesce("p.depth", F.lit(0))).alias("depth"),
                    (F.col("n.total") + F.coalesce("p.total", F.lit(0.0))).alias("total"),
                )
            )
        )
    return tables


def arrived(tables: list[DataFrame]) -> DataFrame:
    """Messages with depth and score of their whole path."""
    return reduce(DataFrame.unionByName, [t.filter("jump is null") for t in tables])


def best_paths(nodes: DataFrame, branches: int) -> DataFrame:
    """(conv, leaf, rank, node, back) for the best ``branches`` leaves; ``back`` counts up from the leaf."""
    tables = doubled(nodes)
    parents = tables[0].filter("jump is not null").select("conv", "jump").distinct()
    leaves = arrived(tables).alias("n").join(parents.alias("c"), _same("n", "c", right="jump"), "left_anti")
    order = Window.partitionBy("conv").orderBy(F.desc("total"), F.desc("depth"), "node")
    chosen = leaves.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= branches)
    on_path = chosen.select("conv", F.col("node").alias("leaf"), "rank", "node", F.lit(0).alias("back"))
    # The longest jumps first: the table of paths then doubles with the last steps only.
    for k, table in reversed(list(enumerate(tables))):
        step = (
            on_path.alias("n")
            .join(table.filter("jump is not null").alias("p"), _same("n", "p"))
            .select("n.conv", "n.leaf", "n.rank", F.col("p.jump").alias("node"), (F.col("n.back") + (1 << k)).alias("back"))
        )
        on_path = stored(on_path.unionByName(step))
    return on_path


def format_paths(
    messages: DataFrame,
    conv: str = "conv_id",
    node: str = "message_id",
    parent: str = "parent_id",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int = 1,
) -> DataFrame:
    """(conv, leaf, rank, formatted, loss): one row for each chosen path.

    ``loss`` lists spans (start, end) of ``formatted`` in code points, from 0, end exclusive.
    """
    nodes = stored(_nodes(messages, conv, node, parent, role, text, score))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    turns = (
        best_paths(nodes, branches)
        .alias("n")
        .join(nodes.alias("p"), _same("n", "p"))
        .select("n.conv", "n.leaf", "n.rank", (-F.col("n.back")).alias("at"), "p.role", head.alias("head"), escape(F.col("p.text")).alias("body"))
        .withColumn("piece", F.concat("head", "body", F.lit(END + "\n")))
    )
    path = ["conv", "leaf", "rank"]
    before = Window.partitionBy(*path).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    placed = turns.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == LOSS_ROLE, F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    return (
        placed.groupBy(*path)
        .agg(
            F.sort_array(F.collect_list(F.struct("at", "piece"))).alias("pieces"),
            F.sort_array(F.collect_list(span)).alias("loss"),
        )
        .select(*path, F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"), "loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as structs of role and text."""
    parts = F.slice(F.split(formatted, r"<\|im_start\|>"), 2, 1 << 30)
    return F.transform(
        parts,
        lambda p: F.struct(
            unescape_role(F.substring_index(p, "\n", 1)).alias("role"),
            unescape(
                F.substring(
                    p,
                    F.length(F.substring_index(p, "\n", 1)) + 2,
                    F.length(p) - F.length(F.substring_index(p, "\n", 1)) - len("\n" + END + "\n"),
                )
            ).alias("text"),
        ),
    )


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(
        F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))),
        "",
    )


def chain(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Plain conversations as trees of one branch: each turn replies to the one before.

    Turns of equal number follow one another by role and text; a row that
    occurs twice is two turns.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return (
        rows.select(
            quoted(conv).alias("conv_id"),
            quoted(turn).alias("turn"),
            F.coalesce(quoted(role), F.lit("")).alias("role"),
            F.coalesce(quoted(text), F.lit("")).alias("text"),
        )
        .withColumn("message_id", F.row_number().over(order))
        .select("conv_id", "message_id", (F.col("message_id") - 1).alias("parent_id"), "role", "text")
    )
