"""Transaction views over the benchmark tables.

Those tables hold no bank exports, so queries run on views derived from all
their rows: line items as card purchases, parts as merchants, suppliers'
regions as currencies, events as a second account, orders as raw exports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.schema import MONEY

# Rules and budgets of the views. "cold" comes first to show rule order; two
# nouns match no rule and are left for the text model.
RULES = {
    "Seasonal": ["cold"],
    "Hardware": ["bolt", "rod"],
    "Machinery": ["gear", "anvil"],
    "Jewellery": ["ring"],
    "Kitchen": ["plate"],
}
BUDGETS = {"Hardware": 6_000_000, "Machinery": 5_200_000, "Jewellery": 100, "Garden": 50.5}
BUDGET_OVERRIDES = {"Jewellery": 9_000_000, "Seasonal": 4_500_000.75}
CURRENCY_OF_REGION = {
    "AMERICA": "USD",
    "EUROPE": "EUR",
    "ASIA": "INR",
    "AFRICA": "GBP",
    "MIDDLE EAST": "AUD",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def transactions(spark: SparkSession, folder: str, currency: bool = False) -> DataFrame:
    """Line items as purchases; returned items are income."""
    lines = table(spark, folder, "lineitem").select(
        "l_partkey", "l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice"
    )
    parts = table(spark, folder, "part").select(
        F.col("p_partkey").alias("l_partkey"),
        F.concat_ws(" ", "p_name", "p_brand").alias("Description"),
    )
    signed = F.when(F.col("l_returnflag") == "R", F.col("l_extendedprice")).otherwise(
        -F.col("l_extendedprice")
    )
    rows = lines.join(parts, "l_partkey")
    columns = [
        F.to_date("l_shipdate").alias("Date"),
        F.col("Description"),
        signed.cast(MONEY).alias("Amount"),
    ]
    if currency:
        code = F.coalesce(
            *[F.when(F.col("r_name") == r, F.lit(c)) for r, c in CURRENCY_OF_REGION.items()]
        )
        origin = (
            table(spark, folder, "supplier")
            .join(table(spark, folder, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(table(spark, folder, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
            .select(F.col("s_suppkey").alias("l_suppkey"), code.alias("Currency"))
        )
        rows = rows.join(origin, "l_suppkey")
        columns.append(F.col("Currency"))
    return rows.select(*columns)


def fixed_price_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Line items at the part's list price, one description per part."""
    lines = table(spark, folder, "lineitem").select("l_partkey", "l_shipdate")
    parts = table(spark, folder, "part").select("p_partkey", "p_name", "p_type", "p_retailprice")
    return lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).select(
        F.to_date("l_shipdate").alias("Date"),
        F.concat(F.col("p_name"), F.lit(" #"), F.col("p_partkey").cast("string")).alias("Description"),
        (-F.col("p_retailprice")).cast(MONEY).alias("Amount"),
        F.col("p_type").alias("Category"),
    )


def event_transactions(spark: SparkSession, folder: str) -> DataFrame:
    """Events as purchases by type, sign-ups as income, and two odd categories.

    ``rare`` has one row, so it is judged by all expenses; ``flat`` repeats
    one amount except for its last row, so its MAD is zero.
    """
    events = table(spark, folder, "events")
    value = F.col("value").cast(MONEY)
    main = events.select(
        F.to_date("ts").alias("Date"),
        F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("Description"),
        F.when(F.col("event_type") == "signup", value).otherwise(-value).cast(MONEY).alias("Amount"),
        F.col("event_type").alias("Category"),
    )
    rare = events.agg(F.to_date(F.max("ts")).alias("Date"), F.max("value").alias("v")).select(
        "Date",
        F.lit("rare event").alias("Description"),
        (-F.col("v").cast(MONEY)).cast(MONEY).alias("Amount"),
        F.lit("rare").alias("Category"),
    )
    nations = table(spark, folder, "nation")
    flat = nations.select(
        F.lit("2024-01-15").cast("date").alias("Date"),
        F.concat(F.lit("flat "), F.col("n_name")).alias("Description"),
        F.when(F.col("n_name") == "NATION_24", F.lit(-99)).otherwise(F.lit(-10)).cast(MONEY).alias("Amount"),
        F.lit("flat").alias("Category"),
    )
    return main.unionByName(rare).unionByName(flat)


def raw_statement(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as a two-sided bank statement; every row occurs twice."""
    day, price = F.col("o_orderdate"), F.format_number("o_totalprice", 2)
    paid_out = F.col("o_orderstatus") != "F"
    urgent = F.col("o_orderpriority") == "1-URGENT"
    ref = F.when(urgent, F.lit("")).when(F.col("o_orderpriority") == "5-LOW", F.lit(" nan "))
    rows = table(spark, folder, "orders").select(
        F.when(urgent, F.date_format(day, "dd/MM/yy"))
        .when(F.col("o_orderpriority") == "2-HIGH", F.date_format(day, "yyyy-MM-dd"))
        .otherwise(F.date_format(day, "dd/MM/yyyy"))
        .alias("Date"),
        F.concat(F.lit("  ORDER "), F.col("o_custkey").cast("string"), F.lit(" ")).alias(" Narration "),
        ref.otherwise(F.col("o_orderkey").cast("string")).alias("Chq./Ref.No."),
        F.date_format(day, "dd/MM/yy").alias("Value Dt"),
        F.when(paid_out, price).otherwise(F.lit("")).alias("Withdrawal Amt."),
        F.when(~paid_out, F.concat(F.lit(" "), price)).alias("Deposit Amt. "),
        F.lit("0").alias("Closing Balance"),
    )
    return rows.unionAll(rows)


def raw_card_export(spark: SparkSession, folder: str, damaged: bool = False) -> DataFrame:
    """Orders as a one-column export with signs in several spellings, each row twice.

    ``damaged`` spoils the date of low and the amount of unspecified priorities.
    """
    price, status = F.format_number("o_totalprice", 2), F.col("o_orderstatus")
    plain = F.col("o_totalprice").cast(MONEY).cast("string")
    day = F.date_format("o_orderdate", "M/d/yyyy")
    amount = (
        F.when(status == "F", F.concat(F.lit("£"), price))
        .when(status == "O", F.concat(price, F.lit(" dr")))
        .when(status == "P", F.concat(F.lit(" $ "), plain, F.lit("CR ")))
        .otherwise(F.concat(F.lit("-"), plain))
    )
    priority = F.col("o_orderpriority")
    if damaged:
        day = F.when(priority == "5-LOW", F.concat(F.lit("31/31/"), day)).otherwise(day)
        amount = F.when(priority == "4-NOT SPECIFIED", F.concat(F.lit("("), plain, F.lit(")"))).otherwise(amount)
    rows = table(spark, folder, "orders").select(
        day.alias("Post Date"),
        F.concat_ws(" ", priority, status, F.col("o_custkey").cast("string")).alias("Memo"),
        amount.alias("GBP Amount"),
    )
    return rows.unionAll(rows)


def corrections(spark: SparkSession, folder: str) -> DataFrame:
    """Review decisions on the parts no rule matches.

    Widgets get a keyword; gizmos of the first brand a category without one.
    """
    parts = table(spark, folder, "part")
    name = F.concat_ws(" ", "p_name", "p_brand")
    widget, gizmo = F.col("p_name").contains("widget"), F.col("p_name").contains("gizmo")
    return (
        parts.filter(widget | (gizmo & (F.col("p_brand") == "Brand#1")))
        .select(
            name.alias("description"),
            F.when(widget, F.lit("Widgets")).otherwise(F.lit("Gadgets")).alias("category"),
            F.when(widget, F.lit("Widget ")).otherwise(F.lit("")).alias("keyword"),
        )
        .distinct()
    )
