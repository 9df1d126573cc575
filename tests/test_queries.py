from __future__ import annotations

import pytest
from conftest import plain

from tallybook.plans import queries as nq


def names(df):
    return [r["Description"] for r in df.collect()]


def test_categories(purchases):
    assert plain(nq.categories(purchases)) == [
        ("Groceries", 175.0), ("Shopping", 42.5), ("Food & Drink", 25.0), ("Subscriptions", 15.99),
    ]


def test_sum(purchases):
    assert plain(nq.sum_of(purchases, "groceries")) == [("Groceries", 175.0, 2)]
    assert plain(nq.sum_of(purchases, "groceries", last=2)) == [("Groceries", 90.0, 1)]
    assert plain(nq.sum_of(purchases, "nothing")) == []
    assert plain(nq.sum_of(purchases, "income")) == []


def test_show(purchases):
    assert names(nq.show(purchases, "GROCERIES")) == ["Whole Foods", "Whole Foods"]
    assert names(nq.show(purchases, "groceries", last=1)) == []
    assert names(nq.show(purchases, "food")) == []
    assert names(nq.show(purchases, "food & drink")) == ["Uber Eats"]
    assert names(nq.show(purchases, "income")) == ["Salary"]


def test_top_and_biggest(purchases):
    assert [r[2] for r in plain(nq.top(purchases, 2))] == [-90.0, -85.0]
    assert [r[2] for r in plain(nq.top(purchases, 5, "Groceries", last=2))] == [-90.0]
    assert [r[2] for r in plain(nq.biggest(purchases, "Groceries"))] == [-90.0]
    assert plain(nq.top(purchases, 3, "income")) == []


def test_average_and_monthly(purchases):
    assert plain(nq.average(purchases, "Groceries")) == [("Groceries", 87.5, 175.0, 2)]
    assert plain(nq.average(purchases, "nope")) == []
    assert plain(nq.monthly(purchases, "groceries")) == [("2024-01", 85.0), ("2024-02", 90.0)]
    assert plain(nq.monthly(purchases, "groceries", last=2)) == [("2024-02", 90.0)]


def test_compare(purchases):
    assert plain(nq.compare(purchases, "2024-01", "2024-02")) == [
        ("Groceries", 85.0, 90.0, 5.0), ("Shopping", 0.0, 42.5, 42.5), ("Subscriptions", 15.99, 0.0, -15.99),
    ]
    assert plain(nq.compare(purchases, "2020-01", "2020-02")) == []
    with pytest.raises(ValueError):
        nq.compare(purchases, "2024-1", "2024-02")


def test_search(purchases, tx):
    assert names(nq.search(purchases, "WHOLE")) == ["Whole Foods", "Whole Foods"]
    assert names(nq.search(purchases, "uber", last=1)) == ["Uber Eats"]
    odd = tx(("2024-01-01", "a.b*c", -1, "x"), ("2024-01-01", "aXbbc", -1, "x"), ("2024-01-01", None, -1, "x"))
    assert names(nq.search(odd, "A.B*")) == ["a.b*c"]


def test_between_and_last_compose(purchases):
    scope = nq.between(purchases, "2024-02-01", "2024-02-28")
    assert sorted(names(scope)) == ["Amazon Purchase", "Whole Foods"]
    assert plain(nq.sum_of(scope, "groceries")) == [("Groceries", 90.0, 1)]
    inner = nq.between(purchases, "2024-01-01", "2024-02-12")
    assert plain(nq.sum_of(inner, "groceries", last=1)) == [("Groceries", 90.0, 1)]
    assert len(names(nq.last(purchases, 2))) == 4
    assert nq.last(purchases.filter("Amount > 1e9"), 2).count() == 0
    with pytest.raises(ValueError):
        nq.last(purchases, 0)


def test_end_of_month_cutoff(tx):
    df = tx(("2024-02-29", "a", -1, "x"), ("2024-03-01", "b", -1, "x"), ("2024-03-31", "c", -1, "x"))
    assert names(nq.last(df, 1)) == ["b", "c"]


def test_catalogue(purchases):
    (row,) = plain(nq.catalogue(purchases))
    assert row == (["Food & Drink", "Groceries", "Income", "Shopping", "Subscriptions"], "2024-01-10", "2024-03-20")


def test_missing_columns(purchases):
    with pytest.raises(ValueError, match="Category"):
        nq.categories(purchases.drop("Category"))
