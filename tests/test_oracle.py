"""Every catalogue query against its SQL twin, at the smallest scale."""

from __future__ import annotations

import os

import compare
import pytest

import oracles
from tallybook.plans.catalogue import CATALOGUE

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no benchmark tables")


@pytest.fixture(scope="module")
def sql():
    return compare.connect(FOLDER)


def test_every_query_has_a_twin():
    assert set(CATALOGUE) == set(oracles.SQL)


@pytest.mark.parametrize("name", list(CATALOGUE))
def test_against_sql(spark, sql, name):
    got = compare.spark_rows(CATALOGUE[name](spark, FOLDER))
    assert got[1], "a query without rows proves nothing"
    assert compare.differences(got, compare.sql_rows(sql, oracles.SQL[name])) is None
