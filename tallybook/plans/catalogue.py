"""Every operator as a query over the benchmark tables.

Each entry reads whole tables. Results come in comparable types: dates as
ISO text, money as double.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallybook.functions.measures import cents, month_key
from tallybook.functions.text import currency_label, mask_cards
from tallybook.operators import (
    anomaly,
    budgets,
    classify,
    dedupe,
    filters,
    model,
    recurring,
    sketches,
    totals,
)
from tallybook.plans import queries as nq
from tallybook.plans import report, views
from tallybook.schema import REQUIRED, RULES, UNCATEGORIZED, require_columns
from tallybook.session import checkpoint_folder, stored
from tallybook.sources import banks, exports, history, ledger, settings

Query = Callable[[SparkSession, str], DataFrame]
PIVOT = 2050
# A gradient below this counts as zero; the loss itself is of the order of 1.
FLAT = 1e-4
CATALOGUE: dict[str, Query] = {}


def comparable(df: DataFrame) -> DataFrame:
    columns = []
    for field in df.schema.fields:
        column = F.col(field.name)
        if isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        columns.append(column.alias(field.name))
    return df.select(*columns)


def register(query: Query) -> Query:
    CATALOGUE[query.__name__] = lambda spark, folder: comparable(query(spark, folder))
    return query


def _tx(spark: SparkSession, folder: str, currency: bool = False) -> DataFrame:
    return classify.classify(views.transactions(spark, folder, currency), views.RULES)


# Sources and cleaning


@register
def ingest_hdfc(spark, folder):
    return exports.ingest(views.raw_statement(spark, folder), pivot_year=PIVOT)


@register
def ingest_generic(spark, folder):
    return exports.ingest(views.raw_card_export(spark, folder))


@register
def ingest_timestamps(spark, folder):
    """Orders exported with times of day, fractions and zones."""
    day = F.to_date("o_orderdate")
    written = [
        F.date_format(day, "yyyy-MM-dd'T10:15:00Z'"),
        F.date_format(day, "MM/dd/yyyy' 9:05 PM'"),
        F.date_format(day, "yyyy.MM.dd"),
        F.date_format(day, "yyyy-MM-dd' 23:59:59.123'"),
        F.replace(F.date_format(day, "MMM d, yyyy"), F.lit("Sep "), F.lit("Sept ")),
    ]
    raw = views.table(spark, folder, "orders").select(
        F.get(F.array(*written), F.pmod("o_orderkey", F.lit(5)).cast("int")).alias("Post Date"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("Memo"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("Debit/Credit"),
    )
    return exports.ingest(raw, mixed=True).select("Date", "Description", "Amount")


@register
def csv_round_trip(spark, folder):
    """Purchases written as CSV exports, read back from the files and cleaned."""
    target = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    rows = views.transactions(spark, folder).distinct()
    quoted = F.concat(F.lit('Café "'), F.col("Description"), F.lit('", etc.'))
    rows.select("Date", quoted.alias("Memo"), "Amount").write.option("header", True).option("escape", '"').csv(target)
    back = exports.ingest(exports.read_export(spark, target))
    return back.groupBy(month_key(F.col("Date")).alias("month")).agg(
        F.count("*").alias("rows"), F.sum("Amount").alias("total"), F.max("Description").alias("last")
    )


@register
def rules_round_trip(spark, folder):
    """Brands as categories, their parts' nouns as keywords: saved as a rule file and loaded."""
    target = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    noun = F.element_at(F.split("p_name", " "), -1)
    rules = views.table(spark, folder, "part").select(
        F.col("p_brand").alias("category"), F.lit(0).alias("cat_order"), noun.alias("keyword"), F.lit(0).alias("kw_order")
    )
    settings.save_rules(rules, target)
    return settings.load_rules(spark, target)


@register
def budgets_round_trip(spark, folder):
    """List prices by brand as budgets: saved as a budget file and loaded."""
    target = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    price = F.sum(F.col("p_retailprice").cast("decimal(18,2)")).cast("decimal(18,2)")
    settings.save_budgets(
        views.table(spark, folder, "part").groupBy(F.col("p_brand").alias("category")).agg(price.alias("budget")), target
    )
    return settings.load_budgets(spark, target)


@register
def dedupe_rows(spark, folder):
    return dedupe.drop_repeats(views.raw_card_export(spark, folder), ["Post Date", "Memo", "GBP Amount"]).select(
        F.col("Post Date").alias("post_date"), F.col("Memo").alias("memo"), F.col("GBP Amount").alias("amount")
    )


@register
def dedupe_removed(spark, folder):
    return dedupe.count_repeats(views.transactions(spark, folder, currency=True))


@register
def keep_first(spark, folder):
    lines = views.table(spark, folder, "lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice"
    )
    order = F.struct("l_extendedprice", "l_partkey")
    return dedupe.keep_first(lines, ["l_orderkey", "l_linenumber"], order)


def _scratch(spark: SparkSession) -> str:
    return f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"


@register
def ingest_mixed_banks(spark, folder):
    """Exports of three headers in one folder: a two-sided statement, a card export, a plain one."""
    target = _scratch(spark)
    kinds = {
        "statement": views.raw_statement(spark, folder),
        "card": views.raw_card_export(spark, folder),
        "plain": views.table(spark, folder, "events").select(
            F.date_format("ts", "yyyy.MM.dd").alias("Booking Date"),
            F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("Payee"),
            F.col("value").cast("decimal(18,2)").cast("string").alias("EUR Amount"),
        ),
    }
    for name, rows in kinds.items():
        rows.write.option("header", True).option("escape", '"').csv(f"{target}/{name}")
    rows = banks.ingest_files(spark, [f"{target}/{k}" for k in kinds], pivot_year=PIVOT)
    kind = F.regexp_extract("source_file", "/(statement|card|plain)/", 1)
    # Distinct rows first: with the maximum of a text beside it, a distinct count sorts all rows twice.
    once = rows.select(kind.alias("kind"), "Currency", "Description", "Date", "Amount").distinct()
    whole = F.col("Description").isNotNull() & F.col("Date").isNotNull() & F.col("Amount").isNotNull()
    return once.groupBy("kind", "Currency", month_key(F.col("Date")).alias("month")).agg(
        F.count_if(whole).alias("rows"), F.max("Description").alias("last")
    )


@register
def ingest_ambiguous_dates(spark, folder):
    """A source for each day of the month on which orders were placed, half of them written day first."""
    day = F.to_date("o_orderdate")
    number, day_first = F.dayofmonth(day), F.col("o_custkey") % 2 == 0
    written = F.when(day_first, F.date_format(day, "d/M/yyyy")).otherwise(F.date_format(day, "M/d/yyyy"))
    source = F.concat_ws("-", F.when(day_first, F.lit("day")).otherwise(F.lit("month")), F.floor(number / 4).cast("string"))
    raw = views.table(spark, folder, "orders").select(
        written.alias("Date"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("Description"),
        F.lit("1.00").alias("Amount"),
        source.alias("source_file"),
    )
    return exports.ingest(raw, date_formats=["M/d/yyyy", "d/M/yyyy"]).select("Date", "Description", "source_file")


@register
def amounts_three_decimals(spark, folder):
    """Weights with three decimals: kept by a type that has them, told apart as bad by money of two."""
    tenth = (F.col("l_extendedprice").cast("decimal(18,2)") / 10).cast("decimal(18,3)")
    raw = views.table(spark, folder, "lineitem").select(
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("Date"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", F.monotonically_increasing_id()).alias("Description"),
        tenth.cast("string").alias("Amount"),
    )
    kept = exports.ingest(raw, dtype="decimal(18,3)").agg(F.sum("Amount").alias("total"), F.count("*").alias("rows"))
    bad = exports.count_rejects(exports.ingest_tolerant(raw)).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("lost"))
    return kept.select("total", "rows", bad.scalar().alias("lost"))


@register
def ingest_extra_columns(spark, folder):
    """A statement whose other columns ride along."""
    rows = exports.ingest(views.raw_statement(spark, folder), pivot_year=PIVOT, keep_extra=True)
    return rows.select("Date", "Description", F.col("Value Dt").alias("value_date"), F.col("Closing Balance").alias("balance"))


@register
def explicit_mapping(spark, folder):
    """Columns named by the caller, since no alias knows them."""
    raw = views.table(spark, folder, "orders").select(
        F.date_format("o_orderdate", "yyyyMMdd").alias("col a"),
        F.col("o_orderkey").cast("string").alias("col.b"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("col c"),
    )
    return exports.ingest(raw, mapping={"col a": "Date", "col.b": "Description", "col c": "Amount"})


@register
def column_guards(spark, folder):
    """Which tables lack the columns of a transaction, by what the guard says."""
    said = []
    for name in ("orders", "events", "lineitem"):
        try:
            require_columns(views.table(spark, folder, name), REQUIRED, name)
        except ValueError as err:
            said.append((name, str(err)))
    counts = [views.table(spark, folder, n).agg(F.count("*").alias("rows")).withColumn("name", F.lit(n)) for n, _ in said]
    rows = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return rows.join(spark.createDataFrame(said, "name string, message string").hint("broadcast"), "name")


def _damaged(spark, folder):
    return exports.ingest_tolerant(views.raw_card_export(spark, folder, damaged=True))


@register
def reject_counts(spark, folder):
    return exports.count_rejects(_damaged(spark, folder))


@register
def date_rejects(spark, folder):
    bad = exports.rejected(_damaged(spark, folder)).filter(F.col("reject_reason") == "date")
    return bad.select("Description", F.col("_raw_date").alias("raw_date"), "Currency")


@register
def amount_rejects(spark, folder):
    bad = exports.rejected(_damaged(spark, folder)).filter(F.col("reject_reason") == "amount")
    return bad.select("Description", F.col("_raw_amount").alias("raw_amount"), "Currency")


@register
def accepted_rows(spark, folder):
    return exports.accepted(_damaged(spark, folder))


@register
def rejects_while_writing(spark, folder):
    """Bad rows counted, with examples, by the job that stores the clean ones."""
    target = _scratch(spark)
    rows = classify.classify(_damaged(spark, folder), views.RULES).withColumn("source_file", F.lit("/exports/card.csv"))
    counted = ledger.write_sources(rows, target, allow_rejects=True)
    try:
        ledger.write_sources(rows, target)
        refused = "no"
    except ValueError as err:
        refused = re.sub("Examples.*", "", str(err)).strip()
    told = spark.createDataFrame(
        [(counted["rejected"], counted["total"], counted["uncategorized"], refused)],
        "rejected bigint, clean bigint, uncategorized bigint, refused string",
    )
    live = ledger.read_sources(spark, target).agg(F.count("*").alias("stored"))
    return told.withColumn("stored", live.scalar())


@register
def mask_card_numbers(spark, folder):
    text = views.table(spark, folder, "documents").select("doc_id", "text")
    masked = text.withColumn("masked", mask_cards(F.col("text")))
    return masked.select("doc_id", "masked", (F.col("text") != F.col("masked")).alias("changed"))


# Rules


@register
def classify_rules(spark, folder):
    return _tx(spark, folder)


@register
def classify_long_rules(spark, folder):
    """The join that serves rule tables too long for one expression."""
    table = classify.rules_table(spark, views.RULES)
    return classify.classify(views.transactions(spark, folder), table, inline_keywords=0)


@register
def classify_alike_rules(spark, folder):
    """One rule a customer, all keywords beginning alike: too many for one expression."""
    rules = views.table(spark, folder, "customer").select(
        F.concat(F.lit("nation "), F.col("c_nationkey").cast("string")).alias("category"),
        F.col("c_nationkey").cast("int").alias("cat_order"),
        F.concat(F.lit("Card Payment by "), F.col("c_custkey").cast("string"), F.lit(" on")).alias("keyword"),
        F.col("c_custkey").cast("int").alias("kw_order"),
    )
    by = F.pmod("o_custkey", F.lit(7)) != 0
    text = F.when(by, F.lit("card payment by ")).otherwise(F.lit("transfer by "))
    rows = views.table(spark, folder, "orders").select(
        F.to_date("o_orderdate").alias("Date"),
        F.concat(text, F.col("o_custkey").cast("string"), F.lit(" on "), F.date_format("o_orderdate", "MMM yyyy")).alias("Description"),
        F.col("o_totalprice").cast("decimal(18,2)").alias("Amount"),
    )
    return classify.classify(rows, rules, inline_keywords=0).groupBy("Category").agg(
        F.count("*").alias("rows"), F.sum("Amount").alias("total")
    )


@register
def classify_repeated_category(spark, folder):
    """A category in two places, keywords in capitals and missing ones; matched by both ways in turn."""
    blocks = [("Frost", "COLD"), ("Brand", "BRAND#1"), ("Frost", "ring"), ("Brand", None), ("Frost", "gear")]
    table = spark.createDataFrame([(c, i, k, 0) for i, (c, k) in enumerate(blocks)], RULES)
    rows = views.transactions(spark, folder)
    both = [
        classify.classify(rows, table, n).withColumn("way", F.lit(way)) for way, n in (("inline", 1000), ("joined", 0))
    ]
    return both[0].unionByName(both[1]).groupBy("way", "Category").agg(
        F.count("*").alias("rows"), F.sum("Amount").alias("total")
    )


@register
def classify_coverage(spark, folder):
    return classify.coverage(_tx(spark, folder))


@register
def merged_rules(spark, folder):
    table = classify.rules_table(spark, views.RULES)
    return classify.merge_corrections(table, views.corrections(spark, folder))


@register
def apply_corrections(spark, folder):
    table = classify.rules_table(spark, views.RULES)
    return classify.apply_corrections(
        views.transactions(spark, folder), table, views.corrections(spark, folder)
    )


# Totals


@register
def period(spark, folder):
    return totals.period(_tx(spark, folder))


@register
def summary_totals(spark, folder):
    return totals.totals(_tx(spark, folder))


@register
def cover_statistics(spark, folder):
    return report.cover(_tx(spark, folder))


@register
def category_totals(spark, folder):
    return totals.category_totals(_tx(spark, folder))


@register
def category_share(spark, folder):
    return report.category_donut(_tx(spark, folder))


@register
def top_merchants(spark, folder):
    return report.merchants(_tx(spark, folder))


@register
def currency_totals(spark, folder):
    sums = totals.currency_totals(_tx(spark, folder, currency=True))
    return sums.withColumn("label", currency_label(F.col("currency")))


@register
def currency_codes(spark, folder):
    one = report.currencies(views.transactions(spark, folder, currency=True))
    return one.withColumn("codes", F.array_join("codes", ","))


@register
def monthly_totals(spark, folder):
    return report.monthly_trend(_tx(spark, folder))


@register
def uncategorized_rows(spark, folder):
    return report.uncategorized(_tx(spark, folder))


@register
def uncategorized_sample(spark, folder):
    return totals.uncategorized_sample(_tx(spark, folder))


@register
def mom_comparison(spark, folder):
    return report.month_changes(_tx(spark, folder))


@register
def full_summary(spark, folder):
    """The nested summary, laid out as one text per part."""
    one = totals.summary(_tx(spark, folder, currency=True))
    entry = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return one.select(
        "period_start",
        "period_end",
        "total_income",
        "total_expenses",
        "net",
        "uncategorized_count",
        F.array_join(F.transform(F.map_entries("category_totals"), entry), "; ").alias("categories"),
        F.array_join(
            F.transform("top_merchants", lambda m: F.concat(m["merchant"], F.lit("="), m["total"].cast("string"))),
            "; ",
        ).alias("merchants"),
        F.array_join("currencies", ",").alias("currencies"),
        F.array_join(
            F.transform(
                F.map_entries("currency_totals"),
                lambda e: F.concat(e["key"], F.lit("="), e["value"]["net"].cast("string")),
            ),
            "; ",
        ).alias("currency_nets"),
        F.size("uncategorized_sample").cast("bigint").alias("sampled"),
    )


@register
def summary_json(spark, folder):
    """Figures read back out of the JSON document."""
    doc = report.summary_json(_tx(spark, folder, currency=True))

    def at(path: str) -> Column:
        return F.get_json_object("json", f"$.{path}")

    return doc.select(
        at("period_start").alias("period_start"),
        at("period_end").alias("period_end"),
        at("total_income").cast("double").alias("income"),
        at("category_totals.Hardware").cast("double").alias("hardware"),
        at("currency_totals.EUR.expenses").cast("double").alias("eur_expenses"),
        at("top_merchants[0].merchant").alias("first_merchant"),
        at("uncategorized_count").cast("bigint").alias("uncategorized"),
    )


# Recurring, anomalies, budgets


@register
def recurring_charges(spark, folder):
    return recurring.find_recurring(views.fixed_price_transactions(spark, folder))


@register
def recurring_wide_tolerance(spark, folder):
    """Purchases at varying prices: most groups need their exact median."""
    return recurring.find_recurring(_tx(spark, folder), min_occurrences=3, amount_tolerance=6.0)


@register
def mad_scores(spark, folder):
    scored = anomaly.score_expenses(views.event_transactions(spark, folder))
    return scored.withColumn("z", F.round("z", 4))


@register
def mad_scores_incremental(spark, folder):
    """Scores by counts kept up to date: two uploads, the first of them written again with right amounts."""
    target, rows = _scratch(spark), views.event_transactions(spark, folder)
    early = F.when(F.col("Description").endswith("1"), F.lit("/in/one.csv")).otherwise(F.lit("/in/two.csv"))
    named_rows = rows.withColumn("source_file", early)
    one, two = (named_rows.filter(F.col("source_file") == f"/in/{n}.csv") for n in ("one", "two"))
    wrong = one.withColumn("Amount", (F.col("Amount") * 3).cast("decimal(18,2)"))
    for upload in (wrong, two, one):
        ledger.write_expense_counts(upload, target)
    profile = stored(anomaly.profile_of_counts(ledger.read_expense_counts(spark, target)))
    return anomaly.score_expenses(rows, profile).withColumn("z", F.round("z", 4))


@register
def sketched_months(spark, folder):
    """Medians and distinct merchants from monthly sketches, and whether they lie within the stated error."""
    rows = stored(_tx(spark, folder))
    held = stored(sketches.monthly_sketches(rows))
    spent = filters.expenses(rows).withColumn("cents", cents(-F.col("Amount")))
    told = sketches.merge_months(held)
    ranked = spent.join(told.select("Category", "median").hint("broadcast"), "Category").groupBy("Category").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("cents") < F.col("median") * 100).alias("below"),
        F.count_if(F.col("cents") <= F.col("median") * 100).alias("upto"),
        F.count_distinct("Description").alias("exact"),
    )
    n = F.col("rows")
    slack = sketches.QUANTILE_ERROR * n + 1
    median_ok = (F.col("below") <= n / 2 + slack) & (F.col("upto") >= n / 2 - slack)
    distinct_ok = F.abs(F.col("merchants") - F.col("exact")) <= F.greatest(sketches.DISTINCT_ERROR * F.col("exact"), F.lit(1))
    return ranked.join(told.select("Category", "merchants"), "Category").select(
        "Category", "rows", median_ok.alias("median_ok"), distinct_ok.alias("distinct_ok")
    )


@register
def anomalies(spark, folder):
    return anomaly.find_anomalies(views.event_transactions(spark, folder))


@register
def anomaly_scatter(spark, folder):
    return report.expense_scatter(views.event_transactions(spark, folder))


@register
def budget_alerts(spark, folder):
    return budgets.budget_alerts(_tx(spark, folder), settings.budget_table(spark, views.BUDGETS))


@register
def budget_vs_actual(spark, folder):
    return budgets.budget_vs_actual(_tx(spark, folder), settings.budget_table(spark, views.BUDGETS))


@register
def budget_override(spark, folder):
    merged = budgets.override_budgets(
        settings.budget_table(spark, views.BUDGETS), settings.budget_table(spark, views.BUDGET_OVERRIDES)
    )
    return budgets.budget_alerts(_tx(spark, folder), merged, warn_threshold=0.5)


# Named queries


@register
def nq_categories(spark, folder):
    return nq.categories(_tx(spark, folder))


@register
def nq_show(spark, folder):
    return nq.show(_tx(spark, folder), "JEWELLERY", last=6)


@register
def nq_top(spark, folder):
    return nq.top(_tx(spark, folder), 25)


@register
def nq_top_category(spark, folder):
    return nq.top(_tx(spark, folder), 10, "kitchen", last=12)


@register
def nq_sum(spark, folder):
    return nq.sum_of(_tx(spark, folder), "hardware", last=24)


@register
def nq_average(spark, folder):
    return nq.average(_tx(spark, folder), "Machinery")


@register
def nq_monthly(spark, folder):
    return nq.monthly(_tx(spark, folder), "seasonal", last=18)


@register
def nq_biggest(spark, folder):
    return nq.biggest(_tx(spark, folder), "Hardware")


@register
def nq_compare(spark, folder):
    return nq.compare(_tx(spark, folder), "1998-02", "1998-12")


@register
def nq_search(spark, folder):
    return nq.search(_tx(spark, folder), "Gizmo Brand#1", last=9)


@register
def nq_between(spark, folder):
    return nq.sum_of(nq.between(_tx(spark, folder), "1997-03-15", "1999-06-30"), "Jewellery", last=3)


@register
def nq_last_n(spark, folder):
    return nq.last(_tx(spark, folder), 3)


@register
def nq_catalogue(spark, folder):
    one = nq.catalogue(_tx(spark, folder))
    return one.withColumn("categories", F.array_join("categories", ","))


# Labelled history and the text model


@register
def training_set(spark, folder):
    return history.training_set(_tx(spark, folder))


@register
def stored_by_month(spark, folder):
    """Written as a table by month, read back, one month pruned from the folders."""
    target = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    rows = _tx(spark, folder).withColumn("source_file", F.lit("/exports/all.csv"))
    history.write_categorized(rows, target, by="month")
    stored = spark.read.parquet(target)
    return stored.filter(F.col("Amount") < 0).groupBy(month_key(F.col("Date")).alias("month"), "Category").agg(
        F.sum("Amount").alias("total"), F.count("*").alias("rows")
    )


@register
def stored_twice(spark, folder):
    """Two files of one name and the same months, stored one after the other by month."""
    target = f"{checkpoint_folder(spark)}/tables/{uuid.uuid4().hex}"
    rows = _tx(spark, folder)
    for place, part in (("spent", rows.filter("Amount < 0")), ("earned", rows.filter("Amount >= 0"))):
        history.write_categorized(part.withColumn("source_file", F.lit(f"/{place}/jan.csv")), target, by="month")
    return spark.read.parquet(target).groupBy(month_key(F.col("Date")).alias("month")).agg(
        F.sum("Amount").alias("total"), F.count("*").alias("rows")
    )


@register
def stored_corrected(spark, folder):
    """A table of two sources, one of which is written again without one of its months."""
    target, rows = _scratch(spark), _tx(spark, folder)
    spent, earned = rows.filter("Amount < 0"), rows.filter("Amount >= 0")
    for part in (spent, earned):
        name = "/exports/spent.csv" if part is spent else "/exports/earned.csv"
        ledger.write_sources(part.withColumn("source_file", F.lit(name)), target)
    corrected = spent.filter(F.month("Date") != 3).withColumn("source_file", F.lit("/exports/spent.csv"))
    ledger.write_sources(corrected, target)
    return ledger.read_sources(spark, target).groupBy("tx_month").agg(
        F.sum("Amount").alias("total"), F.count("*").alias("rows"), F.count_distinct("source").alias("sources")
    )


@register
def coverage_while_writing(spark, folder):
    """Coverage counted by the job that stores the rows."""
    rows = _tx(spark, folder).withColumn("source_file", F.lit("/exports/all.csv"))
    counted = ledger.write_sources(rows, _scratch(spark))
    names = ("total", "classified", "uncategorized")
    return spark.createDataFrame([tuple(counted[n] for n in names)], ", ".join(f"{n} bigint" for n in names))


@register
def recurring_view(spark, folder):
    return report.recurring_charges(views.fixed_price_transactions(spark, folder))


@register
def report_files(spark, folder):
    """The report's tables written and read back: their folder and a figure of each."""
    rows = stored(_tx(spark, folder, currency=True))
    path = report.write_report(rows, _scratch(spark), settings.budget_table(spark, views.BUDGETS))
    read = {n: spark.read.parquet(f"{path}/{n}") for n in ("category_donut", "monthly_trend", "cover", "budget_vs_actual")}
    figures = [
        F.lit(path.rpartition("/")[2]).alias("folder"),
        read["category_donut"].agg(F.count("*")).scalar().alias("categories"),
        read["monthly_trend"].agg(F.sum("Expenses")).scalar().alias("expenses"),
        read["cover"].select("transactions").scalar().alias("transactions"),
        read["budget_vs_actual"].agg(F.count("*")).scalar().alias("budgets"),
    ]
    return spark.range(1).select(*figures)


@register
def ml_guards(spark, folder):
    """Training sets that are refused, and how many rows they have."""
    whole = history.training_set(_tx(spark, folder))
    said = []
    for name, rows in (("few", whole.orderBy("Description", "Category").limit(19)), ("one class", whole.filter("Category = 'Kitchen'"))):
        try:
            model.fit_model(rows, min_samples=20 if name == "few" else 1)
            said.append((name, "trained"))
        except RuntimeError as err:
            said.append((name, re.sub(r"^(\d+).*", r"\1", str(err))))
    return spark.createDataFrame(said, "name string, refused string")


def _fitted(spark, folder):
    return model.fit_model(history.training_set(_tx(spark, folder)))


@register
def ml_features(spark, folder):
    """TF-IDF weights of the labelled descriptions."""
    stages, data = model.fit_features(history.training_set(_tx(spark, folder)))
    return model.feature_weights(data, stages).withColumn("weight", F.round("weight", 6))


@register
def ml_features_hashed(spark, folder):
    """The same weights from n-grams numbered by a hash, where no two clash."""
    stages, data = model.fit_features(history.training_set(_tx(spark, folder)), width=1 << 20)
    weights = model.feature_weights(data, stages)
    return weights.withColumn("weight", F.round("weight", 6))


@register
def ml_optimum(spark, folder):
    """Whether training stopped where the penalised loss is flat."""
    training = history.training_set(_tx(spark, folder))
    slope = model.largest_gradient(training, model.fit_model(training))
    return slope.select((F.col("largest") < FLAT).alias("flat"))


@register
def ml_predict(spark, folder):
    """What no rule matches, predicted by the fitted model and by the same one saved and loaded."""
    target = f"{checkpoint_folder(spark)}/models/{uuid.uuid4().hex}"
    left = filters.uncategorized(_tx(spark, folder)).select("Description").distinct()
    fitted = _fitted(spark, folder)
    model.save_model(spark, fitted, {"trained_at": "", "n_samples": 0, "classes": []}, target)
    first = model.predict(left, fitted, threshold=0.3)
    again = model.predict(left, model.load_model(target), threshold=0.3)
    known = F.col("Predicted").isin(model.model_labels(fitted))
    sure = F.col("Confidence") >= 0.3
    return first.join(again.select("Description", F.col("Predicted").alias("p"), F.col("Confidence").alias("c")), "Description").select(
        "Description",
        ((F.col("p") == F.col("Predicted")) & (F.abs(F.col("c") - F.col("Confidence")) < 1e-9)).alias("same"),
        (known == sure).alias("labelled_if_sure"),
    )


@register
def ml_two_stage(spark, folder):
    """Rows by the rule that settled them, what was left to the model, and labels it may not give."""
    fitted = _fitted(spark, folder)
    rows = model.classify_two_stage(views.transactions(spark, folder), views.RULES, fitted, threshold=0.3)
    left = F.col("ML_Classified") | (F.col("Category") == UNCATEGORIZED)
    odd = F.col("ML_Classified") & ~F.col("Category").isin(model.model_labels(fitted))
    counted = rows.groupBy(F.when(left, F.lit("(left to the model)")).otherwise(F.col("Category")).alias("settled")).agg(
        F.count("*").alias("rows"), F.count_if(odd).alias("odd_labels")
    )
    return counted


@register
def ml_retrain(spark, folder):
    """Store labelled history, train on it, and ask whether the model is stale."""
    target = f"{checkpoint_folder(spark)}/models/{uuid.uuid4().hex}"
    rows = _tx(spark, folder).withColumn("source_file", F.lit("statement.csv"))
    history.write_categorized(rows, f"{target}/history", fmt="csv")
    meta = model.retrain(spark, f"{target}/history", f"{target}/model")
    stale = model.is_model_stale(spark, f"{target}/model", f"{target}/history")
    return spark.createDataFrame(
        [(meta["n_samples"], ",".join(meta["classes"]), stale)],
        "n_samples bigint, classes string, stale boolean",
    )
