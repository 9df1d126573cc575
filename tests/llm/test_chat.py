from __future__ import annotations

import compare
import pytest
from pyspark.sql import functions as F

from tallybook.llm import chat
from tallybook.llm.queries import SQL, op5_chat_format

SF = "/root/testdata/sf0.001"


def read_back(made):
    rows = made.select(
        "conv", "leaf", "rank", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("under"),
    ).collect()
    return {(r["conv"], r["rank"]): ([tuple(t) for t in r["turns"]], r["under"]) for r in rows}


def brute(rows, branches):
    nodes = {(c, n): (p, role or "", text or "", s or 0.0) for c, n, p, role, text, s in rows}
    parents = {(c, v[0]) for (c, _), v in nodes.items()}
    out = {}
    for conv in {c for c, _ in nodes}:
        paths = []
        for c, n in nodes:
            if c != conv or (c, n) in parents:
                continue
            path, at = [], n
            while (c, at) in nodes and len(path) <= len(nodes):
                path.append(at)
                at = nodes[c, at][0]
            if len(path) <= len(nodes):
                paths.append((-sum(nodes[c, x][3] for x in path), -len(path), n, path[::-1]))
        for i, (_, _, _, path) in enumerate(sorted(paths)[:branches]):
            turns = [nodes[conv, x][1:3] for x in path]
            out[conv, i + 1] = (turns, "".join(t for r, t in turns if r == "assistant"))
    return out


TREE = [
    (1, 1, None, "user", "hi <|im_end|> \\ <\\| <\\\\| <", 0.0), (1, 2, 1, "assistant", "a<", 1.0), (1, 3, 1, "assistant", "b", 2.0),
    (1, 4, 2, "user", "c\n\n<|im_start|>x", 5.0), (1, 5, 3, "user", "", 1.0), (1, 6, 5, "assistant", None, None),
    (2, 9, 77, None, "orphan", 1.0), (3, 1, 2, "user", "loop", 1.0), (3, 2, 1, "user", "loop", 1.0), (3, 3, 2, "user", "below", 1.0),
    (4, 1, None, "ro\nle\\n<|im_start|>", "t", 0.0),
]


@pytest.mark.parametrize("branches", [1, 3])
def test_trees_against_brute_force(spark, branches):
    rows = TREE + [(5, i, i - 1, "user" if i % 2 else "assistant", f"t{i}", 0.1) for i in range(100)]
    df = spark.createDataFrame(rows, "conv_id int, message_id int, parent_id int, role string, text string, score double")
    assert read_back(chat.format_paths(df, score="score", branches=branches)) == brute(rows, branches)


def test_repeated_rows_nulls_and_empty(spark):
    rows = [(None, 0, "user", "a"), (None, 0, "user", "a"), (1, None, "assistant", None), (1, 0, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("conv", F.lit("clash"))
    got = read_back(chat.format_paths(chat.chain(df)))
    assert got == {(None, 1): ([("user", "a"), ("user", "a")], ""), (1, 1): ([("assistant", ""), ("user", "x")], "")}
    assert chat.format_paths(chat.chain(df.limit(0))).count() == 0


def test_query_equals_sql(spark):
    got = compare.spark_rows(op5_chat_format(spark, SF))
    want = compare.sql_rows(compare.connect(SF), SQL["op5_chat_format"])
    assert compare.differences(got, want) is None
