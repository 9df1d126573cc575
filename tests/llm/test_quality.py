from __future__ import annotations

import re

import pytest

from tallybook.llm import quality
from tallybook.llm.queries import op10_quality_rules

SF = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORDS.findall(text)
    seen, hit = {}, set()
    for i in range(len(w) - 2):
        seen.setdefault(tuple(w[i : i + 3]), []).append(i)
    for at in seen.values():
        if len(at) > 1:
            hit |= {i + k for i in at for k in range(3)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit)


def check(rows):
    for text, r in rows:
        want = brute(text)
        assert tuple(r[c] for c in quality.FIGURES) == want
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


CASES = [
    (1, None), (2, ""), (3, " \t\n\x0b\x0c\r "), (4, "a"), (5, "a b c"), (6, "a a a a a"), (7, "x y z x y z"),
    (8, "line one\nline one\n\n\nline one \nother"), (9, "#*$ %&|<>   é ü"), (10, "big " * 5000),
    (11, " ".join(f"w{i}" for i in range(20000))), (12, "x y z x y z"), (12, "x y z x y z"), (None, "p q r p q r"),
]


def test_edge_texts_and_clashing_columns(spark):
    docs = spark.createDataFrame([(i, t, "a", 1) for i, t in CASES], "doc_id long, text string, kept string, `n.words` int")
    got = quality.judge(docs).select("_row.text", *[f"_fig.{c}" for c in quality.FIGURES], "base_failed", "kept").collect()
    assert len(got) == len(CASES)
    check([(r["text"], r) for r in got])
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert quality.judge(docs).count() == 0


def test_whole_table_against_brute_force_and_labels(spark):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r["doc_id"]: r for r in op10_quality_rules(spark, SF).collect()}
    assert got.keys() == docs.keys()
    check([(docs[i], got[i]) for i in docs])


def test_verdicts_agree_with_labels(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    rows = [r for r in op10_quality_rules(spark, folder).collect() if r["doc_id"] in labels and r["n_words"] >= 50]
    good = [r["kept"] for r in rows if labels[r["doc_id"]] == 1]
    bad = [r["kept"] for r in rows if labels[r["doc_id"]] == 0]
    assert sum(good) / len(good) > 0.95
    assert sum(bad) / len(bad) < 0.2


def test_em_recovers_known_rates(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    good = rng.random(20000) < 0.7
    rates = {"a": (0.1, 0.9), "b": (0.15, 0.85), "c": (0.2, 0.8)}
    cols = {k: np.where(rng.random(20000) < np.where(good, g, b), -1, 1) for k, (g, b) in rates.items()}
    rows = list(zip(*[c.tolist() for c in cols.values()], strict=True))
    votes = spark.createDataFrame(rows, "a int, b int, c int").selectExpr("struct(a, b, c) _votes")
    got = quality.estimate(votes, ["a", "b", "c"], rounds=40, balance=0.7)
    for k in rates:
        right = (cols[k] == np.where(good, 1, -1)).mean()
        assert got[k] == pytest.approx(right, abs=0.06)
