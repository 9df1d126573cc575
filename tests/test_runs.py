from __future__ import annotations

import json

import pytest
from conftest import plain
from pyspark.sql import functions as F

from tallybook.plans import report
from tallybook.plans.run import classify_exports, run
from tallybook.session import checkpoint_folder, stored
from tallybook.sources import history, settings
from tallybook.streaming.uploads import classify_uploads, watch_exports

RULES = {"Groceries": ["whole foods"], "Fun": ["netflix"]}
EXPORT = """Post Date,Memo,Debit/Credit
2024-01-10,Whole Foods,-85.00
2024-01-10,Whole Foods,-85.00
2024-01-15,Netflix,-15.99
2024-02-15,Netflix,-15.99
2024-02-20,Salary,3000.00
"""


@pytest.fixture()
def inbox(tmp_path):
    folder = tmp_path / "inbox"
    folder.mkdir()
    (folder / "jan.csv").write_text(EXPORT)
    return folder


def test_run_writes_everything(spark, inbox, tmp_path):
    out = str(tmp_path / "out")
    budget = settings.budget_table(spark, {"Fun": 10})
    stored_rows = run(
        spark, str(inbox / "jan.csv"), RULES, out, budgets=budget, with_anomalies=True, with_report=True
    )
    assert stored_rows.count() == 4
    assert {r["source"].rpartition("-")[0] for r in stored_rows.collect()} == {"jan"}
    summary = json.loads(spark.read.text(f"{out}/payload/summary", wholetext=True).first()[0])
    assert summary["total_expenses"] == 116.98 and summary["currencies"] == ["USD"]
    assert "currency_totals" not in summary
    assert [r["Description"] for r in spark.read.json(f"{out}/payload/recurring_transactions").collect()] == ["Netflix"]
    (alert,) = spark.read.json(f"{out}/payload/budget_alerts").collect()
    assert (alert["status"], alert["monthly_avg"]) == ("EXCEEDED", 15.99)
    changes = [json.loads(r[0]) for r in spark.read.text(f"{out}/payload/mom_comparison").collect()]
    assert [(c["category"], c["pct_change"]) for c in changes] == [("Groceries", -100.0), ("Fun", 0.0)]
    views = f"{out}/exports/report_2024-01-10_to_2024-02-20"
    for name in [*report.VIEWS, "budget_vs_actual"]:
        spark.read.parquet(f"{views}/{name}").count()


def test_a_run_analyses_its_own_sources(spark, inbox, tmp_path):
    out = str(tmp_path / "out")
    run(spark, str(inbox / "jan.csv"), RULES, out)
    (inbox / "feb mar.csv").write_text("Post Date,Memo,Debit/Credit\n2024-02-01,Shop,-1.00\n")
    assert plain(run(spark, str(inbox / "feb mar.csv"), RULES, out).select("Description", "Amount")) == [("Shop", -1.0)]
    summary = json.loads(spark.read.text(f"{out}/payload/summary", wholetext=True).first()[0])
    assert summary["total_expenses"] == 1.0
    assert spark.read.parquet(f"{out}/transactions").count() == 5


def by_stem(spark, target):
    return {k.rpartition("-")[0]: n for k, n in plain(spark.read.parquet(target).groupBy("source").count())}


def test_rewriting_a_source_replaces_only_it(spark, inbox, tmp_path):
    (inbox / "feb.csv").write_text("Post Date,Memo,Debit/Credit\n2024-02-01,Shop,-1.00\n")
    target = str(tmp_path / "t")
    both = classify_exports(spark, [str(inbox / "jan.csv"), str(inbox / "feb.csv")], RULES)
    history.write_categorized(both, target)
    assert spark.read.parquet(target).count() == 5
    (inbox / "feb.csv").write_text("Post Date,Memo,Debit/Credit\n2024-02-01,Shop,-1.00\n2024-02-02,Shop,-1.00\n")
    history.write_categorized(classify_exports(spark, str(inbox / "feb.csv"), RULES), target)
    assert by_stem(spark, target) == {"jan": 4, "feb": 2}


def test_csv_sink_feeds_training(spark, inbox, tmp_path):
    target = str(tmp_path / "t")
    history.write_categorized(classify_exports(spark, str(inbox / "jan.csv"), RULES), target, fmt="csv")
    assert sorted(plain(history.load_training_set(spark, target))) == [("Netflix", "Fun"), ("Whole Foods", "Groceries")]


def test_month_table_prunes(spark, purchases, tmp_path):
    target = str(tmp_path / "t")
    named = purchases.withColumn("source_file", F.lit("/a/jan.csv"))
    history.write_categorized(named, target, by="month")
    one = spark.read.parquet(target).filter("tx_month = '2024-02'")
    assert one.count() == 2 and len(one.inputFiles()) >= 1
    with pytest.raises(ValueError):
        history.write_categorized(named, target, by="day")
    with pytest.raises(ValueError, match="source_file"):
        history.write_categorized(purchases, target)


@pytest.mark.parametrize("by", ["source", "month"])
def test_files_of_one_name_and_month_do_not_replace_each_other(spark, purchases, tmp_path, by):
    target, n = str(tmp_path / "t"), purchases.count()
    for folder in ("p", "q", "p"):
        history.write_categorized(purchases.withColumn("source_file", F.lit(f"/{folder}/jan.csv")), target, by=by)
    assert spark.read.parquet(target).count() == 2 * n


def test_source_names_are_the_same_in_both_languages(spark):
    paths = ["file:///p/jan.csv", "file:/p/jan.csv", "/q/jan", "s3://b/x y.tar.gz", "hdfs://h/a%20b.csv"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert history.source_names(paths) == sorted({r[0] for r in df.select(history.source_name(F.col("p"))).collect()})


def test_a_run_reads_only_its_own_folders(spark, inbox, tmp_path):
    out = str(tmp_path / "o")
    stored_rows = run(spark, str(inbox / "jan.csv"), RULES, out)
    text = stored_rows._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(source" in text and "jan-" in text or "PartitionFilters: [source" in text


def test_uploads_are_taken_up_as_they_come(spark, inbox, tmp_path):
    target = str(tmp_path / "t")
    name = f"test-{tmp_path.name}-{id(tmp_path)}"
    header = ["Post Date", "Memo", "Debit/Credit"]
    for expected in ({"jan": 4}, {"jan": 4, "feb": 1}):
        stream = watch_exports(spark, str(inbox), header)
        classify_uploads(stream, RULES, target, name).awaitTermination(120)
        assert by_stem(spark, target) == expected
        (inbox / "feb.csv").write_text("Post Date,Memo,Debit/Credit\n2024-02-01,Shop,-1.00\n")


BAD = """Post Date,Memo,Debit/Credit
2024-01-01,Shop,-5,000.00
2024-01-02,Fine,-1.00
2024-01-03,Short
never,Late,-2.00
2024-01-04,Odd,(3)
"""


def quarantined(spark, target):
    return sorted(plain(spark.read.parquet(f"{target}_quarantine").select("reason", F.coalesce("line", "description"))))


def test_a_bad_row_does_not_stop_the_uploads(spark, inbox, tmp_path):
    target, name = str(tmp_path / "t"), f"bad-{tmp_path.name}-{id(tmp_path)}"
    (inbox / "bad.csv").write_text(BAD)
    want = [("amount", "Odd"), ("date", "Late"), ("width", "2024-01-01,Shop,-5,000.00"), ("width", "2024-01-03,Short")]
    header = ["Post Date", "Memo", "Debit/Credit"]
    for expected in ({"jan": 4, "bad": 1}, {"jan": 4, "bad": 1, "feb": 1}):
        classify_uploads(watch_exports(spark, str(inbox), header), RULES, target, name).awaitTermination(120)
        assert by_stem(spark, target) == expected and quarantined(spark, target) == want
        (inbox / "feb.csv").write_text("Post Date,Memo,Debit/Credit\n2024-02-01,Shop,-1.00\n")


def test_a_killed_upload_leaves_each_row_once(spark, inbox, tmp_path, monkeypatch):
    from tallybook.streaming import uploads

    target, name = str(tmp_path / "t"), f"kill-{tmp_path.name}-{id(tmp_path)}"
    (inbox / "bad.csv").write_text(BAD)
    header = ["Post Date", "Memo", "Debit/Credit"]
    write = uploads.write_categorized

    def dies(*args):
        write(*args)
        raise RuntimeError("killed after the write, before the batch was committed")

    monkeypatch.setattr(uploads, "write_categorized", dies)
    with pytest.raises(Exception, match="killed"):
        classify_uploads(watch_exports(spark, str(inbox), header), RULES, target, name).awaitTermination(120)
    monkeypatch.undo()
    classify_uploads(watch_exports(spark, str(inbox), header), RULES, target, name).awaitTermination(120)
    assert by_stem(spark, target) == {"jan": 4, "bad": 1} and len(quarantined(spark, target)) == 4


def test_uploads_take_the_options_of_the_batch_path(spark, tmp_path):
    inbox, target = tmp_path / "inbox", str(tmp_path / "t")
    inbox.mkdir()
    lines = 'Post Date,Empfänger,Debit/Credit\n13/01/2024,"Café\nZoë",-1.005\n02/01/2024,Bar,-2\n'
    (inbox / "a.csv").write_bytes(lines.encode())
    stream = watch_exports(spark, str(inbox), ["Post Date", "Empfänger", "Debit/Credit"], multiline=True)
    options = dict(mapping={"Empfänger": "Description"}, date_formats=["M/d/yyyy", "d/M/yyyy"], dtype="decimal(18,3)")
    classify_uploads(stream, RULES, target, f"opt-{id(tmp_path)}", **options).awaitTermination(120)
    got = sorted(plain(spark.read.parquet(target).select("Date", "Description", "Amount")))
    assert got == [("2024-01-02", "Bar", -2.0), ("2024-01-13", "Café\nZoë", -1.005)]


def test_uploads_with_another_header_fail(spark, inbox, tmp_path):
    with pytest.raises(Exception, match="header does not conform"):
        classify_uploads(watch_exports(spark, str(inbox), ["Memo", "Post Date", "Debit/Credit"]), RULES, str(tmp_path / "t"), f"h-{id(tmp_path)}").awaitTermination(120)


def test_a_run_over_several_banks_with_a_bad_row_changes_nothing(spark, inbox, tmp_path):
    out = str(tmp_path / "out")
    (inbox / "hdfc.csv").write_text("Date,Narration,Withdrawal Amt.,Deposit Amt.\n13/01/24,Netflix,9.99,\n")
    assert run(spark, str(inbox), RULES, out).count() == 5
    coverage = json.loads(spark.read.text(f"{out}/payload/coverage", wholetext=True).first()[0])
    assert coverage == {"total": 5, "classified": 4, "uncategorized": 1}
    (inbox / "hdfc.csv").write_text("Date,Narration,Withdrawal Amt.,Deposit Amt.\n13/01/24,Netflix,nine,\n")
    with pytest.raises(ValueError, match=r"Cannot parse 1 row\(s\).*nine"):
        run(spark, str(inbox), RULES, out)
    (inbox / "hdfc.csv").write_text("Date,Narration,Withdrawal Amt.,Deposit Amt.\n13/02/24,Netflix,9.99,\n13/03/24,Netflix,9.99,\n")
    assert run(spark, str(inbox), RULES, out).count() == 6


def test_stored_tables_use_the_shared_folder(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2)
    kept = stored(df)
    assert kept.count() == 5 and kept.columns == ["id", "x"]
    assert checkpoint_folder(spark).rstrip("/") in kept.inputFiles()[0]


def test_without_a_named_folder_a_local_one_serves(spark, monkeypatch):
    from tallybook import session

    class Conf:
        def get(self, *_):
            return None

    class Fake:
        conf, sparkContext = Conf(), spark.sparkContext

    folder = session.checkpoint_folder(Fake())
    assert folder == session.checkpoint_folder(Fake()) and "tallybook" in folder

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        session.checkpoint_folder(Cluster())
