from __future__ import annotations

import json

import pytest
from conftest import plain
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tallybook.operators import classify, joins
from tallybook.operators.budgets import override_budgets
from tallybook.schema import RULES
from tallybook.sources import settings

SHOPS = {
    "Books": ["inkwell", "page one"],
    "Travel": ["ferry", "tram"],
    "Garden": ["green thumb", "seedbox"],
}


def described(spark, *texts):
    return spark.createDataFrame([(t,) for t in texts], "Description string")


@pytest.mark.parametrize("inline", [1000, 0])
def test_first_match_in_rule_order(spark, inline):
    texts = ["INKWELL #1234", "GREEN THUMB MARKET", "Tram ride", "ferry to inkwell", "unknown", "", None]
    got = classify.classify(described(spark, *texts), SHOPS, inline)
    assert dict(plain(got)) == {
        "INKWELL #1234": "Books", "GREEN THUMB MARKET": "Garden", "Tram ride": "Travel",
        "ferry to inkwell": "Books", "unknown": "Uncategorized", "": "Uncategorized",
        None: "Uncategorized",
    }


@pytest.mark.parametrize("inline", [1000, 0])
def test_rule_order_and_odd_keywords(spark, inline):
    rules = {"A": ["Uber Eats"], "B": ["uber"], "C": [], "D": ["x"], "E": ["a.b*"], "F": [""]}
    got = dict(plain(classify.classify(described(spark, "UBER EATS 1", "uber trip", "xx", "q a.b* q", "zzz"), rules, inline)))
    assert got == {"UBER EATS 1": "A", "uber trip": "B", "xx": "D", "q a.b* q": "E", "zzz": "F"}


def test_both_matchers_agree(spark):
    words = [a + b for a in ("ab", "abc", "bca", "longword", "verylongword") for b in ("", "x", "yy", " z")]
    rules = {f"c{i}": [w, w[::-1]] for i, w in enumerate(words)}
    texts = [f"{p}{w.upper()}{s}" for w in words for p, s in (("", ""), ("q ", "t"), ("zz", " 9"))]
    df = described(spark, *texts, *texts)
    one, two = (sorted(plain(classify.classify(df, rules, n))) for n in (1000, 0))
    assert one == two and len(one) == len(texts) * 2


def test_keywords_that_begin_alike_have_their_own_anchors(spark):
    rules = {f"c{i % 5}": [] for i in range(40)}
    for i in range(40):
        rules[f"c{i % 5}"].append(f"card payment to shop{i:02d}, thanks")
    rules["c1"] += ["card payment nowhere", "short", "xyz"]
    texts = [f"CARD PAYMENT TO SHOP{i:02d}, THANKS a lot" for i in range(30)] + ["card payment", "a short one", "XYZ", "", None]
    df = described(spark, *texts, *texts)
    table = classify.rules_table(spark, rules)
    keyed = classify.keyword_pieces(table)
    low = [t.lower() for t in texts if t is not None]
    pieces = {r["piece"] for r in keyed.collect()}
    hits = spark.createDataFrame([(t, p) for t in low for p in pieces if p in t], "Description string, piece string")
    anchors = classify.rarest_pieces(keyed, hits).collect()
    # No description holds the rest; each anchor is in one description only.
    assert {r["keyword"] for r in anchors} == {f"card payment to shop{i:02d}, thanks" for i in range(30)} | {"short", "xyz"}
    assert all(sum(r["piece"] in t for t in low) == 1 for r in anchors)
    one, two = (sorted(plain(classify.classify(df, table, n)), key=str) for n in (1000, 0))
    assert one == two and len(one) == 2 * len(texts)


def test_matching_beyond_every_broadcast(spark):
    rules = classify.rules_table(spark, {"A": ["longer keyword one", "one"], "B": ["keyword two", "two", "longer keyword one"]})
    texts = ["A longer keyword one", "longer keyword two", "one two", "none of them", "tw", None]
    got = {r["Description"]: r["best"]["category"] for r in classify.match_by_substring(described(spark, *texts), rules, 0).collect()}
    assert got == {"A longer keyword one": "A", "longer keyword two": "B", "one two": "A", "none of them": "A"}


def test_only_rows_that_may_meet_are_shuffled(spark):
    big = spark.range(20_000).select(F.col("id").cast("string").alias("k"), (F.col("id") % 3).alias("v"))
    big = big.unionByName(spark.createDataFrame([(None, 1)], "k string, v bigint"))
    side = spark.range(0, 20_000, 100).select(F.col("id").cast("string").alias("k"))
    kept = joins.thinned(big, side, ["k"])
    assert kept.columns == big.columns and 200 <= kept.count() < 400
    met = joins.lookup(big, side, ["k"], max_rows=10, how="inner", thin=True)
    text = met._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text and "BroadcastHashJoin [_word" in text[text.index("SortMergeJoin"):]
    assert sorted(plain(met)) == sorted(plain(big.join(side, "k"))) and met.count() == 200
    assert joins.lookup(big, side, ["k"], max_rows=10).count() == 20_001


def test_rule_table_input_and_no_rules(spark):
    df = described(spark, "ferry")
    table = classify.rules_table(spark, SHOPS)
    assert plain(classify.classify(df, table)) == [("ferry", "Travel")]
    assert plain(classify.classify(df, {})) == [("ferry", "Uncategorized")]


@pytest.mark.parametrize("inline", [1000, 0])
def test_category_in_two_places_and_missing_keywords(spark, inline):
    rows = [("A", 0, "X", 0), ("B", 1, "q", 0), ("A", 2, "y", 0), ("B", 3, None, 0), ("C", 4, "İst", 0)]
    table = spark.createDataFrame(rows, RULES)
    texts = described(spark, "q y", "y", "x q", "z", None, "İST 1")
    got = dict(plain(classify.classify(texts, table, inline)))
    assert got == {"q y": "B", "y": "A", "x q": "A", "z": "Uncategorized", None: "Uncategorized", "İST 1": "C"}


@pytest.mark.parametrize("inline", [1000, 0])
def test_dotted_and_quoted_headers_pass_through(spark, inline):
    df = described(spark, "ferry", "z").withColumn("Ref.No.", F.lit(1)).withColumn("a`b", F.lit(2))
    got = classify.classify(df, SHOPS, inline)
    assert got.columns == ["Description", "Ref.No.", "a`b", "Category"]
    assert sorted(plain(got)) == [("ferry", 1, 2, "Travel"), ("z", 1, 2, "Uncategorized")]


def test_coverage(spark):
    got = classify.classify(described(spark, "ferry", "x", None), SHOPS)
    assert plain(classify.coverage(got)) == [(3, 1, 2)]


def test_rule_file_keeps_order(spark, tmp_path):
    path = tmp_path / "k.json"
    path.write_text(json.dumps({"Zoo": ["b", "a"], "Art": ["ä", "c d"], "None": []}, indent=2, ensure_ascii=False))
    rows = plain(settings.load_rules(spark, str(path)))
    assert rows == [("Zoo", 0, "b", 0), ("Zoo", 0, "a", 1), ("Art", 1, "ä", 0), ("Art", 1, "c d", 1)]
    with pytest.raises(FileNotFoundError):
        settings.load_rules(spark, str(tmp_path / "none.json"))


def test_saved_rules_are_sorted_sets(spark, tmp_path):
    table = classify.rules_table(spark, {"Zoo": ["b", "a", "b"], "Art": ["c"]})
    settings.save_rules(table, str(tmp_path / "saved"))
    assert plain(settings.load_rules(spark, str(tmp_path / "saved"))) == [
        ("Art", 0, "c", 0), ("Zoo", 1, "a", 0), ("Zoo", 1, "b", 1),
    ]


def test_corrections(spark):
    rules = classify.rules_table(spark, {"B": ["bus"], "A": ["app"]})
    fixes = spark.createDataFrame(
        [
            ("tram 7", "B", " TRAM "), ("bus 1", "B", "bus"), ("ferry", "Boats", "ferry"),
            ("odd one", "Misc", ""), ("odd two", "Misc", None), ("skip", "", "zzz"),
        ],
        "description string, category string, keyword string",
    )
    merged = classify.merge_corrections(rules, fixes)
    assert sorted(plain(merged), key=lambda r: (r[1], r[3])) == [
        ("B", 0, "bus", 0), ("B", 0, "tram", 1), ("A", 1, "app", 0), ("Boats", 2, "ferry", 0),
    ]
    assert merged.schema.names == RULES.names
    df = described(spark, "Tram 9", "FERRY home", "odd one", "odd two", "odd three", "bus")
    assert dict(plain(classify.apply_corrections(df, rules, fixes))) == {
        "Tram 9": "B", "FERRY home": "Boats", "odd one": "Misc", "odd two": "Misc",
        "odd three": "Uncategorized", "bus": "B",
    }


def test_budget_files(spark, tmp_path):
    path = tmp_path / "b.json"
    path.write_text(json.dumps({"Garden": 400.0, "Travel": 99.5, "Fun": 7}))
    table = settings.load_budgets(spark, str(path))
    assert dict(plain(table)) == {"Garden": 400.0, "Travel": 99.5, "Fun": 7.0}
    settings.save_budgets(table, str(tmp_path / "saved"))
    assert plain(settings.load_budgets(spark, str(tmp_path / "saved"))) == [
        ("Fun", 7.0), ("Garden", 400.0), ("Travel", 99.5),
    ]
    assert settings.load_budgets(spark, str(tmp_path / "none.json")).count() == 0


@pytest.mark.parametrize("text", ["{", '["a"]', "", '{"a": 1', '{"a": "b"}'])
def test_broken_rule_files_fail(spark, tmp_path, text):
    path = tmp_path / "r.json"
    path.write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        settings.load_rules(spark, str(path)).collect()


@pytest.mark.parametrize("text", ["{", "[1]", '{"a": 1'])
def test_broken_budget_files_fail(spark, tmp_path, text):
    path = tmp_path / "b.json"
    path.write_text(text)
    with pytest.raises((PySparkException, Py4JJavaError)):
        settings.load_budgets(spark, str(path)).collect()


def test_repeated_keys_and_small_budgets(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"A": ["x"], "B": ["y"], "A": ["z"]}')
    assert plain(settings.load_rules(spark, str(path))) == [("A", 0, "z", 0), ("B", 1, "y", 0)]
    path.write_text('{"A": 5, "B": 0.004, "A": 6.5}')
    assert plain(settings.load_budgets(spark, str(path))) == [("A", 6.5), ("B", 0.0)]


@pytest.mark.parametrize("value", ["0", "-5", '"400"', '"abc"', "null", "[1]"])
def test_bad_budgets_name_the_category(spark, tmp_path, value):
    path = tmp_path / "b.json"
    path.write_text(f'{{"Ok": 1, "Garden": {value}}}')
    with pytest.raises(PySparkException, match="Garden"):
        settings.load_budgets(spark, str(path)).collect()


def test_budget_overrides(spark):
    base = settings.budget_table(spark, {"A": 1, "B": 2})
    over = settings.budget_table(spark, {"B": 5, "C": 6})
    assert dict(plain(override_budgets(base, over))) == {"A": 1.0, "B": 5.0, "C": 6.0}
    with pytest.raises(ValueError, match="'A'"):
        settings.budget_table(spark, {"A": 0})
    bad = spark.sql("SELECT 'C' AS category, CAST(-1 AS DECIMAL(18,2)) AS budget")
    with pytest.raises(PySparkException, match="'C'"):
        override_budgets(base, bad).collect()


def test_a_rule_without_category_decides_nothing_in_either_way(spark):
    rows = [(None, 0, "ferry", 0), ("A", 1, "ferry", 0), (None, 2, "tram", 0), ("B", 3, None, 0), (None, 4, "", 0)]
    table = spark.createDataFrame(rows, "category string, cat_order int, keyword string, kw_order int")
    for limit in (1000, 0):
        got = classify.classify(described(spark, "ferry", "tram", "x"), table, limit)
        assert {r["Description"]: r["Category"] for r in got.collect()} == {"ferry": "A", "tram": "Uncategorized", "x": "Uncategorized"}
