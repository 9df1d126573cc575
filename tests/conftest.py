from __future__ import annotations

import datetime
import os
import sys
from decimal import Decimal

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
sys.path.insert(0, os.path.join(ROOT, "tests"))

from tallybook.schema import MONEY  # noqa: E402
from tallybook.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(cores=os.environ.get("TEST_CPUS", "8"), shuffle_partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def tx(spark):
    """Builds transactions from (date, description, amount, category[, currency])."""

    def build(*rows):
        names = ["Date", "Description", "Amount", "Category", "Currency"]
        width = len(rows[0]) if rows else 4
        types = dict(
            zip(names, ["date", "string", MONEY, "string", "string"], strict=True)
        )
        data = [
            (
                datetime.date.fromisoformat(r[0]),
                r[1],
                None if r[2] is None else Decimal(str(r[2])),
                *r[3:],
            )
            for r in rows
        ]
        schema = ", ".join(f"{n} {types[n]}" for n in names[:width])
        return spark.createDataFrame(data, schema)

    return build


@pytest.fixture(scope="session")
def raw(spark):
    """Builds text rows under arbitrary headers."""

    def build(headers, *rows):
        return spark.createDataFrame(list(rows), ", ".join(f"`{h}` string" for h in headers))

    return build


@pytest.fixture(scope="session")
def purchases(tx):
    return tx(
        ("2024-01-10", "Whole Foods", -85.00, "Groceries"),
        ("2024-01-15", "Netflix", -15.99, "Subscriptions"),
        ("2024-02-05", "Amazon Purchase", -42.50, "Shopping"),
        ("2024-02-12", "Whole Foods", -90.00, "Groceries"),
        ("2024-03-01", "Uber Eats", -25.00, "Food & Drink"),
        ("2024-03-20", "Salary", 3000.00, "Income"),
    )


def plain(df):
    """Rows as tuples of str, float, int, bool or None."""

    def value(v):
        if isinstance(v, Decimal):
            return float(v)
        if isinstance(v, datetime.date):
            return v.isoformat()
        return v

    return [tuple(value(v) for v in row) for row in df.collect()]
