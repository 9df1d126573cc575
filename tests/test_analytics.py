from __future__ import annotations

import random
import statistics

import pytest
from conftest import plain
from pyspark.sql import functions as F

from tallybook.functions.measures import calendar_months, frequency_band, pct_change
from tallybook.operators import anomaly, budgets, recurring, totals
from tallybook.operators.medians import RANGE_BITS, frequencies, twice_median
from tallybook.plans import report
from tallybook.sources import settings


def months(first, days, n):
    import datetime

    start = datetime.date.fromisoformat(first)
    return [(start + datetime.timedelta(days=days * i)).isoformat() for i in range(n)]


# Medians


@pytest.mark.parametrize("direct", [True, False])
def test_medians_against_brute_force(spark, direct):
    rng = random.Random(7)
    groups = {
        "one": [5],
        "two": [1, 1 << 40],
        "same": [7] * 9,
        "split": [1] * 5 + [1 << (RANGE_BITS + 3)] * 5,
        "negative": [-3, -2, 10, -(1 << 20)],
        "wide": [rng.randrange(-(1 << 24), 1 << 24) for _ in range(501)],
        "even": [rng.randrange(0, 1 << 18) for _ in range(600)],
        "repeats": [rng.choice([1, 2, 70000]) for _ in range(400)],
    }
    rows = [(k, v) for k, values in groups.items() for v in values]
    df = spark.createDataFrame(rows, "k string, v bigint")
    got = twice_median(frequencies(df, ["k"], "v"), ["k"], "v", direct)
    want = {k: (round(2 * statistics.median(v)), len(v)) for k, v in groups.items()}
    assert {k: (t, n) for k, t, n in plain(got)} == want


# Anomalies


def brute_scores(rows):
    def score(values):
        mid = statistics.median(values)
        mad = statistics.median([abs(v - mid) for v in values])
        if mad:
            return lambda v: 0.6745 * (v - mid) / mad
        dev = statistics.stdev(values) if len(values) > 1 else 0
        return (lambda v: (v - mid) / dev) if dev else (lambda v: 0.0)

    spent = [(c, -a) for c, a in rows if a < 0]
    overall = score([v for _, v in spent])
    own = {}
    for c, _ in spent:
        values = [v for k, v in spent if k == c]
        own[c] = score(values) if len(values) >= 3 else overall
    return sorted((c, v, round(own[c](v), 6)) for c, v in spent)


@pytest.mark.parametrize("direct", [True, False])
@pytest.mark.parametrize("broadcast", [100, 0])
def test_scores_against_brute_force(spark, tx, monkeypatch, direct, broadcast):
    monkeypatch.setattr(anomaly, "is_short", lambda _: direct)
    rng = random.Random(3)
    rows = [("hot", -rng.randrange(100, 90000) / 100) for _ in range(300)]
    rows += [("flat", -10.0)] * 6 + [("flat", -50.0), ("constant", -4.0), ("constant", -4.0), ("constant", -4.0)]
    rows += [("single", -5000.0), ("pair", -1.0), ("pair", -2.0), ("hot", 500.0), ("income", 10.0)]
    df = tx(*[("2024-01-01", f"t{i}", a, c) for i, (c, a) in enumerate(rows)])
    got = anomaly.score_expenses(df, max_broadcast=broadcast).select("Category", -F.col("Amount"), F.round("z", 6))
    want = brute_scores(rows)
    found = sorted(plain(got))
    assert [r[:2] for r in found] == [r[:2] for r in want]
    assert [r[2] for r in found] == pytest.approx([r[2] for r in want], abs=2e-6)


def test_anomaly_fixture(tx):
    df = tx(*[("2024-01-01", f"t{i}", a, "Food") for i, a in enumerate([-3.0, -3.5, -3.2, -500])])
    assert plain(anomaly.find_anomalies(df)) == [("2024-01-01", "t3", -500.0, "Food", 1339.96)]
    assert anomaly.find_anomalies(df).columns == ["Date", "Description", "Amount", "Category", "Z_Score"]


def test_no_anomalies(tx):
    same = tx(*[("2024-01-01", f"t{i}", -5, "Food") for i in range(3)])
    only_income = tx(*[("2024-01-01", f"t{i}", 5 * i + 1, "Pay") for i in range(4)])
    assert anomaly.find_anomalies(same).count() == 0
    assert anomaly.find_anomalies(only_income).count() == 0


def test_scatter_keeps_every_expense(tx):
    df = tx(*[("2024-01-01", "d" * 50, a, "Food") for a in [-3.0, -3.5, -3.2, -500, 7]])
    rows = plain(report.expense_scatter(df))
    assert len(rows) == 4 and [r[5] for r in sorted(rows, key=lambda r: r[2])] == [False] * 3 + [True]
    assert {len(r[1]) for r in rows} == {35}


def test_missing_columns_are_named(tx):
    df = tx(("2024-01-01", "a", -1, "x")).drop("Category", "Date")
    for operator in (anomaly.find_anomalies, recurring.find_recurring, totals.summary):
        with pytest.raises(ValueError, match=r"\['Category', 'Date'\]"):
            operator(df)


# Recurring


@pytest.mark.parametrize(
    "days, band",
    [
        (3.9, "Irregular"), (4, "Weekly"), (7, "Weekly"), (10, "Weekly"), (10.5, "Irregular"),
        (11, "Biweekly"), (14, "Biweekly"), (18, "Biweekly"), (18.5, "Irregular"), (24.5, "Irregular"),
        (25, "Monthly"), (35, "Monthly"), (35.5, "Irregular"), (85, "Quarterly"), (95, "Quarterly"),
        (96, "Irregular"), (350, "Annual"), (380, "Annual"), (381, "Irregular"),
    ],
)
def test_frequency_bands(spark, days, band):
    assert spark.range(1).select(frequency_band(F.lit(float(days)))).first()[0] == band


def test_recurring_series(tx):
    rows = [(d, "NETFLIX", -15.49, "Fun") for d in ("2026-01-01", "2026-02-01", "2026-03-01")]
    rows += [(d, "GYM", -10, "Fit") for d in months("2026-01-01", 7, 4)]
    rows += [(d, "PAY", 900, "Income") for d in months("2026-01-01", 14, 3)]
    rows += [("2026-01-01", "ONCE", -1, "x"), ("2026-01-01", "TWICE", -1, "x"), ("2026-01-01", "TWICE", -1, "x")]
    got = plain(recurring.find_recurring(tx(*rows)))
    assert got == [
        ("PAY", "Income", 900.0, 14.0, "Biweekly", 3, "2026-01-01", "2026-01-29"),
        ("NETFLIX", "Fun", -15.49, 29.5, "Monthly", 3, "2026-01-01", "2026-03-01"),
        ("GYM", "Fit", -10.0, 7.0, "Weekly", 4, "2026-01-01", "2026-01-22"),
    ]
    shown = plain(report.recurring_charges(tx(*rows)))
    assert shown[1][:3] == ("NETFLIX", "Fun", 15.49)


def test_recurring_tolerance(tx):
    days = months("2026-01-01", 30, 3)
    rows = [(d, "Electric", a, "Bills") for d, a in zip(days, (-98, -105, -102), strict=True)]
    rows += [(d, "Amazon", a, "Shop") for d, a in zip(days, (-12.99, -254, -89.50), strict=True)]
    rows += [(d, "Exact", -5, "Bills") for d in days]
    df = tx(*rows)
    assert {r[0] for r in plain(recurring.find_recurring(df))} == {"Electric", "Exact"}
    assert {r[0] for r in plain(recurring.find_recurring(df, amount_tolerance=0))} == {"Exact"}
    assert {r[0] for r in plain(recurring.find_recurring(df, amount_tolerance=5))} == {"Electric", "Exact", "Amazon"}
    assert recurring.find_recurring(df, min_occurrences=4).count() == 0
    with pytest.raises(ValueError):
        recurring.find_recurring(df, amount_tolerance=-1)


def brute_recurring(rows, least, tolerance):
    import datetime

    kept = {}
    for name in {r[1] for r in rows}:
        mine = sorted((datetime.date.fromisoformat(r[0]), r[2], r[3]) for r in rows if r[1] == name)
        amounts, dates = [a for _, a, _ in mine], [d for d, _, _ in mine]
        mid = statistics.median(amounts)
        if len(mine) < least or len(set(dates)) < 2:
            continue
        if mid and max(abs(a - mid) for a in amounts) / abs(mid) > tolerance:
            continue
        gaps = [(b - a).days for a, b in zip(dates, dates[1:], strict=False)]
        cats = [c for _, _, c in mine]
        best = min(set(cats), key=lambda c: (-cats.count(c), c))
        kept[name] = (best, len(mine), round(statistics.median(gaps), 1))
    return kept


@pytest.mark.parametrize("tolerance", [0.1, 0.3, 2.0])
def test_recurring_against_brute_force(tx, tolerance):
    rng = random.Random(11)
    rows = []
    for i in range(60):
        base = rng.choice([-100, -20, 40, 0, 1])
        for _ in range(rng.randrange(1, 9)):
            day = months("2025-01-01", rng.randrange(0, 40), 2)[1]
            amount = round(base * (1 + rng.choice([0, 0, 0.05, 0.11, 0.2, -0.1, -3]) * rng.random()), 2)
            rows.append((day, f"m{i}", amount, rng.choice("abc")))
    got = {r[0]: (r[1], r[5], r[3]) for r in plain(recurring.find_recurring(tx(*rows), 2, tolerance))}
    assert got == brute_recurring(rows, 2, tolerance) and got


# Budgets


@pytest.mark.parametrize(
    "spend, budget, warn, expected",
    [
        ([("2026-01-05", 500)], 400, 0.8, (500.0, 125.0, "EXCEEDED", 1)),
        ([("2026-01-05", 400)], 400, 0.8, (400.0, 100.0, "EXCEEDED", 1)),
        ([("2026-01-05", 340)], 400, 0.8, (340.0, 85.0, "APPROACHING", 1)),
        ([("2026-01-05", 200)], 400, 0.8, (200.0, 50.0, "OK", 1)),
        ([("2026-01-31", 300), ("2026-02-01", 500)], 400, 0.8, (400.0, 100.0, "EXCEEDED", 2)),
        ([("2026-01-05", 70)], 100, 0.6, (70.0, 70.0, "APPROACHING", 1)),
    ],
)
def test_budget_status(spark, tx, spend, budget, warn, expected):
    df = tx(*[(d, "x", -a, "Groceries") for d, a in spend])
    table = settings.budget_table(spark, {"Groceries": budget})
    assert plain(budgets.budget_alerts(df, table, warn)) == [("Groceries", float(budget), *expected)]


def test_budgets_without_spend_and_month_counts(spark, tx):
    df = tx(("2026-01-05", "x", -90, "A"), ("2026-04-05", "x", -30, "Z"), ("2026-04-06", "pay", 99, "A"))
    table = settings.budget_table(spark, {"B": 10, "A": 100})
    assert plain(budgets.budget_alerts(df, table)) == [
        ("A", 100.0, 22.5, 22.5, "OK", 4), ("B", 10.0, 0.0, 0.0, "OK", 4),
    ]
    assert plain(budgets.budget_vs_actual(df, table)) == [
        ("A", 100.0, 45.0, 45.0, "OK", 2), ("B", 10.0, 0.0, 0.0, "OK", 2),
    ]
    empty = df.filter("Amount > 1000")
    assert [r[5] for r in plain(budgets.budget_alerts(empty, table))] == [1, 1]
    assert budgets.budget_alerts(df, table.filter("budget < 0")).count() == 0


# Summary


@pytest.fixture(scope="module")
def january(tx):
    return tx(
        ("2024-01-05", "Starbucks", -5.50, "Food & Drink"),
        ("2024-01-08", "Lyft", -12.00, "Transport"),
        ("2024-01-15", "Salary", 2000.00, "Income"),
        ("2024-01-20", "Netflix", -15.99, "Entertainment"),
        ("2024-01-25", "Whole Foods", -80.00, "Uncategorized"),
    )


def test_summary(january):
    one = totals.summary(january).first()
    assert (str(one["period_start"]), str(one["period_end"])) == ("2024-01-05", "2024-01-25")
    assert [float(one[k]) for k in ("total_income", "total_expenses", "net")] == [2000.0, 113.49, 1886.51]
    assert {k: float(v) for k, v in one["category_totals"].items()} == {
        "Uncategorized": 80.0, "Entertainment": 15.99, "Transport": 12.0, "Food & Drink": 5.5,
    }
    assert [m["merchant"] for m in one["top_merchants"]] == ["Whole Foods", "Netflix", "Lyft", "Starbucks"]
    assert one["uncategorized_count"] == 1
    assert [r["Description"] for r in one["uncategorized_sample"]] == ["Whole Foods"]
    assert one["currencies"] == ["USD"] and one["currency_totals"] is None


def test_summary_by_currency(january):
    mixed = january.withColumn("Currency", F.when(F.col("Description") == "Lyft", "INR").otherwise("USD"))
    one = totals.summary(mixed).first()
    assert one["currencies"] == ["INR", "USD"]
    nets = {k: float(v["net"]) for k, v in one["currency_totals"].items()}
    assert nets == {"INR": -12.0, "USD": 1898.51}
    assert float(one["net"]) == 1886.51
    none = january.withColumn("Currency", F.lit(None).cast("string"))
    assert totals.summary(none).first()["currencies"] == ["USD"]


def test_summary_lists_are_capped_as_specified(tx):
    df = tx(*[("2024-01-01", f"m{i:02}", -i - 1, "Uncategorized") for i in range(30)])
    one = totals.summary(df).first()
    assert len(one["top_merchants"]) == 10 and len(one["uncategorized_sample"]) == 5
    assert one["uncategorized_count"] == 30


def test_summary_of_nothing(january):
    one = totals.summary(january.filter("Amount > 1e6")).first()
    assert one["period_start"] is None and one["category_totals"] == {} and one["currencies"] == ["USD"]


def test_totals_invariants(january):
    assert plain(totals.totals(january)) == [(2000.0, 113.49, 1886.51)]
    shares = plain(totals.with_share(totals.category_totals(january)))
    assert sum(r[1] for r in shares) == pytest.approx(113.49)
    assert sum(r[2] for r in shares) == pytest.approx(100, abs=0.3)
    assert plain(report.cover(january)) == [(2000.0, 113.49, 5, 1, 1886.51)]


def test_monthly_totals_skip_zero_amounts(tx):
    df = tx(("2024-01-01", "a", -5, "x"), ("2024-02-01", "a", 0, "x"), ("2024-03-01", "a", 7, "x"))
    assert plain(totals.monthly_totals(df)) == [("2024-01", 5.0, 0.0), ("2024-03", 0.0, 7.0)]


def test_month_over_month(purchases, tx):
    assert plain(totals.month_over_month(purchases)) == [
        ("2024-03", "2024-02", "Groceries", 0.0, 90.0, -90.0, -100.0),
        ("2024-03", "2024-02", "Shopping", 0.0, 42.5, -42.5, -100.0),
        ("2024-03", "2024-02", "Food & Drink", 25.0, 0.0, 25.0, None),
    ]
    gap = tx(("2024-01-01", "a", -10, "x"), ("2024-02-01", "a", 99, "x"), ("2024-05-01", "a", -15, "x"))
    assert plain(totals.month_over_month(gap)) == [("2024-05", "2024-01", "x", 15.0, 10.0, 5.0, 50.0)]
    assert totals.month_over_month(gap.filter("Date < '2024-03-01'")).count() == 0


def test_small_expressions(spark):
    row = spark.range(1).select(
        pct_change(F.lit(3), F.lit(2)),
        pct_change(F.lit(3), F.lit(0)),
        calendar_months(F.lit("2024-01-31").cast("date"), F.lit("2025-02-01").cast("date")),
    ).first()
    assert tuple(row) == (50.0, None, 14)


def test_report_currencies(january):
    assert plain(report.currencies(january)) == [([], False, "$")]
    two = january.withColumn("Currency", F.when(F.col("Amount") > 0, "EUR").otherwise("GBP"))
    assert plain(report.currencies(two)) == [(["EUR", "GBP"], True, "Mixed currencies")]
