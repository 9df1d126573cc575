"""Numbering by ranges, sketches, running counts and hashed features against plain recomputation."""

from __future__ import annotations

import glob
import os
import random
import tempfile

import pytest
from conftest import plain
from pyspark.sql import functions as F

from tallybook.operators import anomaly, classify, medians, model, sketches
from tallybook.operators.numbering import number_rows
from tallybook.schema import RULES
from tallybook.session import stored
from tallybook.sources import ledger


def test_numbers_follow_the_order(spark):
    values = random.Random(3).sample(range(100_000), 3000)
    df = spark.createDataFrame([(f"k{v:06}", v) for v in values], "k string, v int").repartition(7)
    got = {r["k"]: r["n"] for r in number_rows(df, ["k"], "n").collect()}
    assert got == {k: i for i, k in enumerate(sorted(got))} and len(got) == 3000
    assert number_rows(df.limit(0), ["k"], "n").collect() == []
    dotted = number_rows(df.select(F.col("k").alias("a.b")), ["a.b"], "n")
    assert dotted.count() == 3000


def test_rules_are_numbered_without_a_window_over_all(spark):
    rules = spark.createDataFrame([("B", 0, "x", 0), ("A", 1, "y", 0)], RULES)
    new = spark.createDataFrame([("d", f"C{i:03}", f"k{i}") for i in range(50)] + [("d", "A", "z")], "description string, category string, keyword string")
    for df in (classify.merge_corrections(rules, new), classify.sort_rules(classify.merge_corrections(rules, new))):
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "Window [" not in text.replace("windowspecdefinition(category", "") or "windowspecdefinition(0" not in text
        assert "windowspecdefinition(0" not in text
    merged = {(r["category"], r["cat_order"], r["keyword"]) for r in classify.merge_corrections(rules, new).collect()}
    assert {("B", 0, "x"), ("A", 1, "y"), ("A", 1, "z"), ("C000", 2, "k0"), ("C049", 51, "k49")} <= merged and len(merged) == 53
    ordered = {(r["category"], r["cat_order"]) for r in classify.sort_rules(classify.merge_corrections(rules, new)).collect()}
    assert {("A", 0), ("B", 1), ("C000", 2), ("C049", 51)} <= ordered


@pytest.mark.parametrize("span", [1, 300, 10**6, 10**17])
def test_medians_of_any_span(spark, span):
    rng = random.Random(span)
    rows = [(rng.choice("ab"), rng.randint(-span, span), rng.randint(1, 4)) for _ in range(2001)]
    freq = spark.createDataFrame(rows, "k string, v bigint, weight bigint").groupBy("k", "v").agg(F.sum("weight").alias("weight"))
    got = {r["k"]: (r["twice"], r["n"]) for r in medians.twice_median(freq, ["k"], "v", direct=False).collect()}
    for k in "ab":
        all_ = sorted(v for key, v, w in rows if key == k for _ in range(w))
        assert got[k] == (all_[(len(all_) - 1) // 2] + all_[len(all_) // 2], len(all_))
    assert 16 <= medians.range_bits(freq, "v") <= 30 and medians.range_bits(freq.limit(0), "v") == 16


def test_counts_are_withdrawn_and_added_by_source(spark, tx, tmp_path):
    rng = random.Random(9)
    rows = [("2024-01-01", f"s{i}", -rng.randint(1, 900) / 100, rng.choice("ABC")) for i in range(300)] + [("2024-01-01", "pay", 50, "A")]
    whole = tx(*rows).withColumn("source_file", F.concat(F.lit("/in/"), F.substring("Description", 2, 1), F.lit(".csv")))
    path = str(tmp_path / "counts")
    ledger.write_expense_counts(whole.withColumn("Amount", (F.col("Amount") * 7).cast("decimal(18,2)")), path)
    ledger.write_expense_counts(whole.filter("Description <> 's1'"), path)
    ledger.write_expense_counts(whole.filter("source_file = '/in/1.csv'"), path)
    kept = anomaly.profile_of_counts(ledger.read_expense_counts(spark, path))
    assert sorted(plain(kept), key=repr) == sorted(plain(anomaly.expense_profile(whole)), key=repr)
    gone = whole.filter("source_file <> '/in/1.csv'")
    ledger.write_expense_counts(gone.limit(0), path, sources=["/in/1.csv"])
    kept = anomaly.profile_of_counts(ledger.read_expense_counts(spark, path))
    assert sorted(plain(kept), key=repr) == sorted(plain(anomaly.expense_profile(gone)), key=repr)


def test_sketches_of_months_add_up(tx):
    rng = random.Random(4)
    rows = [(f"2024-0{rng.randint(1, 6)}-15", f"shop {rng.randint(0, 4000)}", -rng.randint(1, 10**6) / 100, rng.choice("AAB")) for _ in range(12_000)]
    held = sketches.monthly_sketches(tx(*rows))
    assert held.count() == 12
    for start, end in ((None, None), ("2024-02", "2024-04"), ("2024-06", None)):
        for r in sketches.merge_months(held, start, end).collect():
            own = [x for x in rows if x[3] == r["Category"] and (start or "") <= x[0][:7] <= (end or "9")]
            below = sum(-x[2] < r["median"] for x in own) / len(own)
            assert r["rows"] == len(own) and abs(below - 0.5) <= sketches.QUANTILE_ERROR + 1 / len(own)
            exact = len({x[1] for x in own})
            assert abs(r["merchants"] - exact) <= sketches.DISTINCT_ERROR * exact
    assert sketches.merge_months(held, "2030-01").collect() == []


def test_a_hashed_space_takes_more_grams_than_a_vocabulary(spark):
    rows = [(f"{w} {i}{i + 7}", c) for i in range(15) for w, c in (("coffee house", "Food"), ("train ticket", "Travel"))]
    training = spark.createDataFrame(rows, "Description string, Category string")
    with pytest.raises(RuntimeError, match="state a width"):
        model.fit_model(training, max_vocabulary=50)
    fitted = model.fit_model(training, max_vocabulary=50, width=1 << 16)
    got = model.predict(spark.createDataFrame([("coffee bar",), ("train to town",)], "Description string"), fitted, 0.5)
    assert [r[1] for r in sorted(plain(got))] == ["Food", "Travel"]


def test_a_stored_step_leaves_no_shuffle_files(spark):
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    root = os.environ.get("SPARK_LOCAL_DIRS") or spark.conf.get("spark.local.dir", None) or tempfile.gettempdir()

    def held():
        return set(glob.glob(f"{root}/blockmgr-*/*/shuffle_*"))

    counted = spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count()
    start = held()
    rows = counted.collect()
    assert held() - start, "a plain run leaves its files until garbage is collected"
    start, before = held(), spark.conf.get(name)
    assert sorted(stored(counted).collect()) == sorted(rows)
    assert not held() - start and spark.conf.get(name) == before
    with pytest.raises(Exception, match="no good"):
        stored(counted.select(F.raise_error(F.lit("no good")).cast("int").alias("x")))
    assert spark.conf.get(name) == before
