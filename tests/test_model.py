from __future__ import annotations

import datetime
import json
import os

import pytest
from conftest import plain
from pyspark.sql import functions as F

from tallybook.functions.ngrams import word_bounded_ngrams
from tallybook.operators import model
from tallybook.sources import history

RULES = {"Food": ["pizza"]}


def labelled(spark, n=30):
    rows = [
        (f"starbucks purchase {i}", "Food & Drink") if i % 2 == 0 else (f"uber trip {i}", "Transport")
        for i in range(n)
    ]
    return spark.createDataFrame(rows, "Description string, Category string")


@pytest.fixture(scope="module")
def fitted(spark):
    return model.fit_model(labelled(spark))


def ngrams(text, low=2, high=4):
    out = []
    for word in text.lower().split():
        word = f" {word} "
        for n in range(low, high + 1):
            if len(word) <= n:
                out.append(word)
                break
            out += [word[i : i + n] for i in range(len(word) - n + 1)]
    return sorted(out)


def test_ngrams(spark):
    texts = ["a", "ab", "Abc  defgh", "", "  ", "x yy zzz"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    rows = df.select("t", word_bounded_ngrams(F.col("t")).alias("g")).collect()
    assert {r["t"]: sorted(r["g"]) for r in rows} == {t: ngrams(t) for t in texts}


def test_training_guards(spark):
    with pytest.raises(RuntimeError, match="too few"):
        model.fit_model(labelled(spark, 19))
    one = labelled(spark).withColumn("Category", F.lit("x"))
    with pytest.raises(RuntimeError, match="needs two"):
        model.fit_model(one)
    with pytest.raises(RuntimeError, match="n-grams"):
        model.fit_model(labelled(spark), max_vocabulary=10)
    assert model.model_labels(model.fit_model(labelled(spark, 10), min_samples=5)) == ["Food & Drink", "Transport"]


def test_prediction_threshold(spark, fitted):
    df = spark.createDataFrame([("starbucks downtown",), ("uber ride",)], "Description string")
    assert dict(plain(model.predict(df, fitted, 0.5).drop("Confidence"))) == {
        "starbucks downtown": "Food & Drink", "uber ride": "Transport",
    }
    assert {r[1] for r in plain(model.predict(df, fitted, 1.1))} == {"Uncategorized"}
    for row in model.predict(df, fitted).collect():
        assert 0.5 <= row["Confidence"] <= 1


def test_penalty_matches_a_direct_fit(spark, fitted):
    """Probabilities agree with plain gradient descent on the same objective."""
    import math

    import numpy as np

    rows = labelled(spark).collect()
    docs = [ngrams(r["Description"]) for r in rows]
    vocabulary = sorted({g for d in docs for g in d})
    df = np.array([sum(g in set(d) for d in docs) for g in vocabulary])
    idf = np.log((1 + len(docs)) / (1 + df)) + 1

    def vector(grams):
        v = np.array([grams.count(g) for g in vocabulary]) * idf
        return v / np.linalg.norm(v)

    x = np.array([vector(d) for d in docs])
    y = np.array([1.0 if r["Category"] == "Transport" else 0.0 for r in rows])
    w, b = np.zeros(x.shape[1]), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        w -= 0.05 * (x.T @ (p - y) + w)
        b -= 0.05 * (p - y).sum()
    text = "uber downtown trip"
    want = 1 / (1 + math.exp(-(vector([g for g in ngrams(text) if g in vocabulary]) @ w + b)))
    got = model.predict(spark.createDataFrame([(text,)], "Description string"), fitted, 0).first()
    assert got["Predicted"] == "Transport"
    assert got["Confidence"] == pytest.approx(want, abs=1e-3)


def test_two_stages(spark, fitted, tx):
    df = tx(
        ("2024-01-01", "PIZZA uber trip", -1), ("2024-01-01", "uber trip 99", -1), ("2024-01-01", "qqqq", -1),
        ("2024-01-01", None, -1),
    )
    got = {r["Description"]: (r["Category"], r["ML_Classified"]) for r in model.classify_two_stage(df, RULES, fitted, 0.6).collect()}
    assert got["PIZZA uber trip"] == ("Food", False)
    assert got["uber trip 99"] == ("Transport", True)
    assert got["qqqq"] == ("Uncategorized", False) and got[None] == ("Uncategorized", False)
    high = model.classify_two_stage(df, RULES, fitted, 1.1)
    assert not any(r["ML_Classified"] for r in high.collect())
    cold = model.classify_two_stage(df, RULES, None)
    assert {(r["Category"], r["ML_Classified"]) for r in cold.collect()} == {("Food", False), ("Uncategorized", False)}
    assert cold.columns == high.columns == ["Date", "Description", "Amount", "Category", "ML_Classified"]


def test_save_and_load(spark, fitted, tmp_path):
    folder = str(tmp_path / "m")
    assert model.load_model(folder) is None
    meta = {"trained_at": "2024-01-01T00:00:00+00:00", "n_samples": 30, "classes": ["a", "b"]}
    model.save_model(spark, fitted, meta, folder)
    again = model.load_model(folder)
    df = labelled(spark)
    assert plain(model.predict(df, again).orderBy("Description")) == plain(model.predict(df, fitted).orderBy("Description"))


def write_history(folder, name, rows):
    folder.mkdir(exist_ok=True)
    lines = ["Date,Description,Amount,Category"] + [f"2024-01-01,{d},-1.0,{c}" for d, c in rows]
    (folder / f"{name}_categorized.csv").write_text("\n".join(lines) + "\n")


def test_training_set(spark, tmp_path):
    folder = tmp_path / "processed"
    assert history.load_training_set(spark, str(folder)).count() == 0
    folder.mkdir()
    assert history.load_training_set(spark, str(folder)).count() == 0
    write_history(folder, "a", [("x", "A"), ("x", "A"), ("y", "Uncategorized")])
    write_history(folder, "b", [("x", "A"), ("x", "B")])
    (folder / "notes.csv").write_text("Date,Description,Amount,Category\n2024-01-01,z,-1,Z\n")
    assert sorted(plain(history.load_training_set(spark, str(folder)))) == [("x", "A"), ("x", "B")]


def test_training_set_without_model_labels(spark):
    df = spark.createDataFrame([("x", "A", True), ("y", "A", False), ("z", None, False)], "Description string, Category string, ML_Classified boolean")
    assert sorted(plain(history.training_set(df))) == [("x", "A"), ("y", "A")]
    assert plain(history.training_set(df, include_ml=False)) == [("y", "A")]


def test_folders_with_different_headers(spark, tmp_path):
    write_history(tmp_path / "one", "a", [("x", "A")])
    (tmp_path / "two").mkdir()
    (tmp_path / "two" / "b_categorized.csv").write_text("Category,Description\nB,y\n")
    both = [str(tmp_path / "one"), str(tmp_path / "two")]
    assert sorted(plain(history.load_training_set(spark, both))) == [("x", "A"), ("y", "B")]


def test_retrain_and_staleness(spark, tmp_path):
    processed, folder = tmp_path / "processed", str(tmp_path / "m")
    assert not model.is_model_stale(spark, folder, str(processed))
    rows = [(r["Description"], r["Category"]) for r in labelled(spark).collect()]
    write_history(processed, "a", rows[:10])
    with pytest.raises(RuntimeError, match="too few"):
        model.retrain(spark, str(processed), folder)
    os.makedirs(folder)
    assert model.is_model_stale(spark, folder, str(processed))
    write_history(processed, "b", rows)
    meta = model.retrain(spark, str(processed), folder)
    assert (meta["n_samples"], meta["classes"]) == (30, ["Food & Drink", "Transport"])
    assert model.load_model(folder) is not None
    assert not model.is_model_stale(spark, folder, str(processed))
    later = datetime.datetime.now().timestamp() + 3600
    os.utime(processed / "b_categorized.csv", (later, later))
    assert model.is_model_stale(spark, folder, str(processed))
    spark.createDataFrame([("never",)], "trained_at string").write.mode("overwrite").json(f"{folder}/meta")
    assert model.is_model_stale(spark, folder, str(processed))
    empty = tmp_path / "empty"
    empty.mkdir()
    assert not model.is_model_stale(spark, folder, str(empty))
    assert json.loads(json.dumps(meta))["trained_at"]
