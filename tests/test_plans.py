"""Properties of the physical plans that matter at scale."""

from __future__ import annotations

import os
import random
import re

import pytest
from conftest import plain
from pyspark.sql import functions as F

from tallybook.operators import anomaly, classify, filters, joins, recurring, totals
from tallybook.plans import queries as nq
from tallybook.plans.catalogue import CATALOGUE
from tallybook.sources.history import write_categorized

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def plan(df) -> str:
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A stored table whose hot description holds half of all rows."""
    rng = random.Random(5)
    rows = [
        (
            f"20{rng.randrange(22, 25)}-{rng.randrange(1, 13):02}-{rng.randrange(1, 28):02}",
            "HOT SHOP" if i % 2 else f"shop {rng.randrange(200)}",
            -rng.randrange(100, 9000) / 100,
            rng.choice(["A", "A", "A", "B"]),
        )
        for i in range(3000)
    ]
    df = spark.createDataFrame(rows, "Date string, Description string, Amount double, Category string")
    df = df.withColumn("Date", F.to_date("Date")).withColumn("Amount", F.col("Amount").cast("decimal(18,2)"))
    path = str(tmp_path_factory.mktemp("t") / "month")
    write_categorized(df.withColumn("source_file", F.lit("/x.csv")), path, by="month")
    return spark.read.parquet(path)


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")
@pytest.mark.parametrize("name", [n for n in CATALOGUE if not n.startswith("ml_")])
def test_no_python_workers_and_no_cross_joins(spark, name):
    text = CATALOGUE[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()
    for banned in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "CartesianProduct", "NestedLoopJoin"):
        assert banned not in text


def test_filters_reach_the_scan(table):
    text = plan(nq.between(table, "2023-02-01", "2023-03-31"))
    assert "GreaterThanOrEqual(Date,2023-02-01)" in text and "LessThanOrEqual(Date,2023-03-31)" in text
    text = plan(nq.compare(table, "2023-02", "2023-12"))
    assert "GreaterThanOrEqual(Date,2023-02-01)" in text
    assert "ReadSchema: struct<Date:date,Amount:decimal(18,2),Category:string>" in text
    assert ">= 2023-02)" in text and "<= 2023-12)" in text


def test_the_month_cutoff_is_a_subquery_of_the_scan(table):
    text = plan(filters.in_last_months(table, 2))
    scans = [line for line in text.splitlines() if "FileScan" in line]
    assert any(re.search(r"DataFilters: \[.*Date#\d+ > .*ubquery", s) for s in scans)
    assert any(re.search(r"PartitionFilters: \[.*tx_month#\d+ >= .*ubquery", s) for s in scans)
    assert "Join" not in text
    flat = table.drop("tx_month")
    assert sorted(plain(filters.in_last_months(flat, 5))) == sorted(
        plain(filters.in_last_months(table, 5).drop("tx_month"))
    )


def test_date_ranges_prune_month_folders(table):
    text = plan(nq.between(table, "2023-02-01", "2023-03-31"))
    assert "tx_month#" in text and ">= 2023-02)" in text and "<= 2023-03)" in text


def test_month_over_month_shuffles_only_coarse_rows(table):
    text = plan(totals.month_over_month(table))
    assert text.split("== Initial Plan ==")[0].count("SinglePartition") <= 1


def test_top_is_a_bounded_heap(table):
    assert "TakeOrderedAndProject" in plan(nq.top(table, 5))
    assert "TakeOrderedAndProject" in plan(totals.top_merchants(table))


def test_description_windows_see_daily_rows_only(table):
    """No window runs over transactions; the hot description is combined first."""
    text = plan(recurring.describe(table)).split("== Initial Plan ==")[0]
    assert text.count("Exchange hashpartitioning") == 2
    first_window = text.rindex("Window [")
    assert "HashAggregate(keys=[Description" in text[first_window:]
    assert "hashpartitioning(Description#" in text[first_window:]


def test_join_paths_agree(spark, table):
    """Broadcast and sort-merge joins, same result."""
    side = spark.createDataFrame([("HOT SHOP", 1), ("shop 7", 2)], "Description string, v int")
    ways = [
        joins.lookup(table, side, ["Description"]),
        joins.lookup(table, side, ["Description"], max_rows=0),
        table.join(side, "Description", "left"),
    ]
    results = [sorted(plain(w.select("Date", "Description", "Amount", "v")), key=repr) for w in ways]
    assert results[0] == results[1] == results[2]
    assert not joins.few_keys(table, ["Description"], max_keys=10)
    assert not joins.few_keys(table, ["Description"], max_bytes=10)
    assert joins.few_keys(table, ["Category"])


def test_sides_past_the_limit_are_never_broadcast(table):
    side = table.select("Description").distinct().withColumn("v", F.lit(1))
    assert joins.fits_broadcast(side) and not joins.fits_broadcast(side, max_rows=10)
    assert not joins.fits_broadcast(side, max_bytes=10)
    many = joins.lookup(table, side, ["Description"], max_rows=10)
    assert "SortMergeJoin" in plan(many) and "BroadcastHashJoin" not in plan(many)
    assert many.filter("Description = 'HOT SHOP' AND v = 1").count() == 1500


@pytest.mark.parametrize("few", [True, False])
def test_medians_of_many_descriptions(table, monkeypatch, few):
    want = plain(recurring.find_recurring(table, 2, 3.0))
    monkeypatch.setattr(recurring, "few_keys", lambda *_: few)
    assert plain(recurring.find_recurring(table, 2, 3.0)) == want and want


def test_long_rule_tables_without_broadcast(spark, table, monkeypatch):
    rules = {"A": ["shop 1", "hot"], "B": ["shop"], "C": ["7", "p 9"]}
    want = sorted(plain(classify.classify(table, rules)), key=repr)
    monkeypatch.setattr(joins, "fits_broadcast", lambda *_: False)
    assert sorted(plain(classify.classify(table, rules, inline_keywords=0)), key=repr) == want


def test_the_transactions_are_counted_once(table):
    """Scoring reads the transactions twice: once to count, once to score."""
    profile = anomaly.expense_profile(table)
    assert "month" not in profile.inputFiles()[0].rsplit("/", 2)[0].rsplit("/", 1)[1]
    text = profile._jdf.queryExecution().executedPlan().toString()
    assert "Description" not in text
