"""Files of several banks, formats by source, exact amounts."""

from __future__ import annotations

import datetime

import pytest
from conftest import plain
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallybook.functions.parse import MONTH_FIRST
from tallybook.plans import catalogue
from tallybook.sources import banks, exports

CARD = "Post Date,Memo,GBP Amount\n03/13/2024,Shop,-1.50\n03/14/2024,Shop,-2.50\n"
STATEMENT = 'Date,Narration,Chq./Ref.No.,Withdrawal Amt.,Deposit Amt.\n13/02/24,ATM,R1,"1,000.00",\n'
PLAIN = "Buchungstag,Betrag,Empfänger\n"


@pytest.fixture()
def inbox(tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"card{i}.csv").write_text(CARD)
    (folder / "hdfc.csv").write_text(STATEMENT)
    (folder / "empty.csv").write_text("")
    (folder / "header only.csv").write_text(CARD.split("\n")[0] + "\n")
    return folder


def test_files_are_grouped_by_header(spark, inbox):
    groups = {bytes(r["header"]).decode(): [p.rsplit("/", 1)[1] for p in r["paths"]] for r in banks.scan_headers(spark, str(inbox)).collect()}
    assert groups == {
        CARD.split("\n")[0]: ["card0.csv", "card1.csv", "card2.csv", "header%20only.csv"],
        STATEMENT.split("\n")[0]: ["hdfc.csv"],
    }


def test_the_header_scan_leaves_the_session_as_it_was(spark, inbox):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    banks.scan_headers(spark, str(inbox))
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before


def test_each_file_is_read_by_its_own_layout(spark, inbox):
    rows = banks.ingest_files(spark, str(inbox), pivot_year=2050)
    got = {(*r[:4], r[4].rsplit("/", 1)[1]) for r in plain(rows.select("Date", "Description", "Amount", "Currency", "source_file"))}
    cards = {(f"2024-03-{d}", "Shop", a, "GBP", f"card{i}.csv") for i in range(3) for d, a in ((13, -1.5), (14, -2.5))}
    assert got == cards | {("2024-02-13", "ATM | Ref: R1", -1000.0, "INR", "hdfc.csv")}
    assert banks.layouts_of(banks.read_banks(spark, str(inbox))) == ["Generic", "HDFC"]


def test_a_header_in_latin_1_and_one_in_utf_8(spark, tmp_path):
    for name, charset in (("a", "utf-8"), ("b", "latin-1")):
        (tmp_path / f"{name}.csv").write_bytes((PLAIN + "2024-01-02,3.00,Bäcker\n").encode(charset))
    mapping = {"Buchungstag": "Date", "Betrag": "Amount", "Empfänger": "Description"}
    rows = banks.ingest_files(spark, str(tmp_path), mapping=mapping)
    assert plain(rows.select("Date", "Description", "Amount")) == [("2024-01-02", "Bäcker", 3.0)] * 2
    with pytest.raises(ValueError, match="no file has them"):
        banks.ingest_files(spark, str(tmp_path), mapping={"Nowhere": "Date"})


def test_missing_folder_and_rows_of_another_width(spark, inbox):
    with pytest.raises(FileNotFoundError):
        banks.ingest_files(spark, str(inbox / "none"))
    (inbox / "wide.csv").write_text("Date,Description,Amount\n2024-01-01,Shop,-5,000.00\n")
    with pytest.raises(Exception, match="(?i)malformed"):
        banks.ingest_files(spark, str(inbox)).collect()


def dated(spark, *rows):
    return spark.createDataFrame([(d, f"row {i}", "1", s) for i, (d, s) in enumerate(rows)], "Date string, Description string, Amount string, source_file string")


BOTH = ["M/d/yyyy", "d/M/yyyy"]


def test_one_format_for_each_source(spark):
    raw = dated(spark, ("01/02/2024", "a"), ("13/02/2024", "a"), ("01/02/2024", "b"), ("02/13/2024 10:30", "b"), ("01/02/2024", "c"))
    got = plain(exports.ingest(raw, date_formats=BOTH).orderBy("Description").select("Date"))
    assert got == [("2024-02-01",), ("2024-02-13",), ("2024-01-02",), ("2024-02-13",), ("2024-01-02",)]
    mixed = plain(exports.ingest(raw, date_formats=BOTH, mixed=True).orderBy("Description").select("Date"))
    assert mixed[0] == ("2024-01-02",) and mixed[1] == ("2024-02-13",)
    assert dict(plain(exports.choose_formats(raw, BOTH))) == {"a": 1, "b": 0, "c": 0}


def test_what_does_not_fit_the_format_of_its_source_is_bad(spark):
    raw = dated(spark, ("01/13/2024", "a"), ("01/14/2024", "a"), ("13/01/2024", "a"), ("junk", "a"), (None, "a"))
    with pytest.raises(PySparkException, match="Cannot parse date"):
        exports.ingest(raw, date_formats=BOTH).collect()
    tagged = exports.ingest_tolerant(raw, date_formats=BOTH)
    assert exports.accepted(tagged).count() == 2 and dict(plain(exports.count_rejects(tagged))) == {"date": 3}


def test_a_frame_without_files_is_one_source(spark):
    raw = dated(spark, ("01/02/2024", "a"), ("13/02/2024", "b")).drop("source_file")
    assert {r[0] for r in plain(exports.ingest(raw, date_formats=BOTH))} == {"2024-02-01", "2024-02-13"}
    nothing = exports.ingest(raw.limit(0), date_formats=BOTH)
    assert nothing.collect() == [] and exports.choose_formats(raw.limit(0), MONTH_FIRST).collect() == []


def test_digits_are_never_lost(spark):
    texts = ["-5.005", "5.00", "5.000", "1.234 CR", ".005", ".50", "1e-3", "1.5e1", "5.", "12345678901234567.00", "-0.001"]
    raw = spark.createDataFrame([("2024-01-01", t, t) for t in texts], "Date string, Description string, Amount string")
    tagged = exports.ingest_tolerant(raw)
    kept = dict(plain(exports.accepted(tagged).select("Description", "Amount")))
    assert kept == {"5.00": 5.0, "5.000": 5.0, ".50": 0.5, "1.5e1": 15.0, "5.": 5.0}
    with pytest.raises(PySparkException, match="Cannot parse amount value: '-5.005'"):
        exports.ingest(raw.filter("Amount = '-5.005'")).collect()
    wide = dict(plain(exports.accepted(exports.ingest_tolerant(raw, dtype="decimal(18,3)")).select("Description", "Amount")))
    assert wide["-5.005"] == -5.005 and wide["1e-3"] == 0.001 and wide["1.234 CR"] == 1.234 and "12345678901234567.00" not in wide
    sides = spark.createDataFrame(
        [("01/01/24", "n", "1.005", ""), ("01/01/24", "n", "", "1.5")], "Date string, Narration string, `Withdrawal Amt.` string, `Deposit Amt.` string"
    )
    assert dict(plain(exports.count_rejects(exports.ingest_tolerant(sides)))) == {"amount": 1}


def test_extra_columns_of_a_statement(raw):
    df = raw(
        ["Date", "Narration", "Withdrawal Amt.", "Deposit Amt.", " Closing Balance", "Value Dt"],
        ("01/01/24", "a", "1", "", "9.00", "02/01/24"), ("01/01/24", "a", "1", "", "8.00", "02/01/24"),
    )
    got = exports.ingest(df, keep_extra=True, pivot_year=2050)
    assert got.columns == ["Date", "Description", "Amount", "Currency", "Closing Balance", "Value Dt"]
    assert plain(got) == [("2024-01-01", "a", -1.0, "INR", "8.00", "02/01/24")]
    tagged = exports.ingest_tolerant(df, keep_extra=True, pivot_year=2050)
    assert plain(exports.accepted(tagged).select("Closing Balance")) == [("8.00",)]


def test_repeats_on_clean_values_among_bad_rows(raw):
    df = raw(["Date", "Description", "Amount"], ("2024-01-01", "a", "1"), ("2024-01-01", "a", "$1.00"), ("2024-01-01", "a", "x"), ("2024-01-01", "a", "y"))
    tagged = exports.ingest_tolerant(df, dedupe_after=True)
    assert exports.accepted(tagged).count() == 1 and exports.rejected(tagged).count() == 2


def test_a_source_is_read_in_its_format_without_trying_others(spark):
    raw = dated(spark, ("01/02/2024", "a"))
    text = exports.ingest(raw.withColumn("Date", F.col("Date")))._jdf.queryExecution().optimizedPlan().toString()
    assert "_format" in text
    assert "_format" not in exports.ingest(raw, mixed=True)._jdf.queryExecution().optimizedPlan().toString()


def test_mixed_banks_count_distinct_rows_without_sorting_them_twice(spark, tmp_path):
    order = "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"
    day = datetime.datetime(2024, 2, 29)
    orders = [(1, 7, "F", 1234.5, day, "3-MEDIUM"), (2, 7, "O", 5.0, day, "1-URGENT"), (3, 7, "O", 5.0, day, "1-URGENT")]
    spark.createDataFrame(orders, order).write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(1, day, 2.5), (1, day, 2.5), (2, day, None)], "event_id bigint, ts timestamp, value double").write.parquet(f"{tmp_path}/events.parquet")
    rows = catalogue.CATALOGUE["ingest_mixed_banks"](spark, str(tmp_path))
    assert "distinct" not in rows._jdf.queryExecution().optimizedPlan().toString().lower()
    assert sorted(plain(rows)) == [
        ("card", "GBP", "2024-02", 2, "3-MEDIUM F 7"),
        ("plain", "EUR", "2024-02", 1, "event 2"),
        ("statement", "INR", "2024-02", 2, "ORDER 7 | Ref: 1"),
    ]
