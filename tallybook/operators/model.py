"""Text model for descriptions that no rule matches (Spark ML)."""

from __future__ import annotations

import datetime
from collections.abc import Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import (
    IDF,
    CountVectorizer,
    ElementwiseProduct,
    HashingTF,
    IndexToString,
    Normalizer,
    StringIndexer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallybook.functions.ngrams import word_bounded_ngrams
from tallybook.operators.classify import Rules, classify
from tallybook.operators.joins import lookup
from tallybook.schema import UNCATEGORIZED, named, require_columns
from tallybook.session import stored
from tallybook.sources.history import load_training_set, newest_file

# Defaults of training and prediction.
MIN_SAMPLES = 20
CONFIDENCE = 0.70
INVERSE_REGULARISATION = 1.0
MAX_ITERATIONS = 500
NGRAMS = (2, 4)

# The coefficients, classes times n-grams, live on the driver. A vocabulary
# past this size is an error, never a silent cut; a hashed space takes any number.
MAX_VOCABULARY = 1 << 20


def _with_grams(df: DataFrame, text) -> DataFrame:
    return df.withColumn("_grams", word_bounded_ngrams(text, *NGRAMS))


def fit_features(
    training: DataFrame, max_vocabulary: int = MAX_VOCABULARY, width: int | None = None
) -> tuple[list[Transformer], DataFrame]:
    """Stages from n-gram counts to unit-length TF-IDF vectors, and ``training`` with ``_features``.

    With ``width`` n-grams are numbered by a hash below it instead of by a
    vocabulary, so that any number of them fits; two that clash count as one.
    """
    data = _with_grams(training, F.col("Description"))
    if width is not None:
        counts = HashingTF(inputCol="_grams", outputCol="_tf", numFeatures=width)
    else:
        counts = CountVectorizer(
            inputCol="_grams", outputCol="_tf", vocabSize=max_vocabulary + 1, minDF=1.0
        ).fit(data)
        if len(counts.vocabulary) > max_vocabulary:
            raise RuntimeError(f"More than {max_vocabulary} distinct n-grams; raise max_vocabulary or state a width.")
    data = counts.transform(data)
    idf = IDF(inputCol="_tf", outputCol="_idf").fit(data).idf.toArray()
    scale = ElementwiseProduct(
        inputCol="_tf", outputCol="_weighted", scalingVec=Vectors.dense(np.asarray(idf) + 1.0)
    )
    unit = Normalizer(inputCol="_weighted", outputCol="_features", p=2.0)
    return [counts, scale, unit], unit.transform(scale.transform(data))


def feature_weights(df: DataFrame, stages: Sequence[Transformer]) -> DataFrame:
    """(Description, gram, weight): the vectors of ``fit_features`` spelt out."""
    if isinstance(stages[0], HashingTF):
        grams = _with_grams(df.select("Description"), F.col("Description")).select(F.explode("_grams").alias("gram"))
        single = stages[0].transform(grams.distinct().withColumn("_grams", F.array("gram")))
        # The vector of one n-gram has one index.
        words = single.select(F.unwrap_udt("_tf")["indices"][0].alias("pos"), "gram")
        held = F.unwrap_udt("_features")  # sparse: most of the space is empty
        cells = df.select("Description", F.explode(F.arrays_zip(held["indices"].alias("pos"), held["values"].alias("weight"))).alias("c"))
        cells = cells.select("Description", "c.pos", "c.weight")
    else:
        words = df.sparkSession.createDataFrame(list(enumerate(stages[0].vocabulary)), "pos int, gram string")
        cells = df.select("Description", F.posexplode(vector_to_array("_features")).alias("pos", "weight"))
    return cells.filter("weight != 0").join(words, "pos").select("Description", "gram", "weight")


def largest_gradient(training: DataFrame, model: PipelineModel, c: float = INVERSE_REGULARISATION) -> DataFrame:
    """One row: the largest component, in size, of the penalised loss's gradient at the fitted coefficients."""
    regression, labels = model.stages[-2], model_labels(model)
    matrix = regression.coefficientMatrix.toArray()
    spark = training.sparkSession
    classes = list(enumerate(labels)) if len(matrix) > 1 else [(0, labels[1])]
    coefficients = spark.createDataFrame(
        [(k, j, float(v)) for k, row in enumerate(matrix) for j, v in enumerate(row)], "k int, pos int, weight double"
    )
    scored = model.transform(_with_grams(training, F.col("Description")))
    chance, n = vector_to_array("_probability"), training.count()
    errors = F.array(
        *[
            F.struct(
                F.lit(k).alias("k"),
                (F.get(chance, k if len(matrix) > 1 else 1) - (F.col("Category") == name).cast("double")).alias("e"),
            )
            for k, name in classes
        ]
    )
    cells = scored.select(F.posexplode(vector_to_array("_features")).alias("pos", "x"), errors.alias("errors"))
    loss = (
        cells.filter("x != 0")
        .select("pos", "x", F.explode("errors").alias("e"))
        .groupBy("e.k", "pos")
        .agg((F.sum(F.col("x") * F.col("e.e")) / n).alias("loss"))
    )
    slope = F.coalesce("loss", F.lit(0.0)) + F.col("weight") / (c * n)
    return coefficients.join(loss, ["k", "pos"], "left").agg(F.max(F.abs(slope)).alias("largest"))


def fit_model(
    training: DataFrame,
    min_samples: int = MIN_SAMPLES,
    c: float = INVERSE_REGULARISATION,
    max_iterations: int = MAX_ITERATIONS,
    max_vocabulary: int = MAX_VOCABULARY,
    width: int | None = None,
) -> PipelineModel:
    """TF-IDF of character n-grams and a logistic regression.

    The n-grams are a vocabulary of at most ``max_vocabulary``, or with
    ``width`` a hashed space of that size, which holds any number.

    Inverse document frequency is ``ln((1+n)/(1+df)) + 1``, rows have unit
    length, and the penalty is ``1/(C n)``.
    """
    require_columns(training, ["Description", "Category"], "fit_model")
    # Training passes over the set several times; it is distinct pairs only.
    training = stored(training.select("Description", "Category"))
    size = training.agg(F.count("*").alias("n"), F.count_distinct("Category").alias("k")).first()
    if size["n"] < min_samples:
        raise RuntimeError(
            f"{size['n']} labelled descriptions are too few to train on; it takes {min_samples}."
        )
    if size["k"] < 2:
        raise RuntimeError(f"{size['k']} category among the labels; a model needs two to choose from.")

    indexer = StringIndexer(
        inputCol="Category", outputCol="_label", stringOrderType="alphabetAsc"
    ).fit(training)
    stages, data = fit_features(indexer.transform(training), max_vocabulary, width)
    # The regression passes over the features many times.
    data = stored(data.select("_features", "_label"))
    regression = LogisticRegression(
        featuresCol="_features",
        labelCol="_label",
        predictionCol="_prediction",
        probabilityCol="_probability",
        rawPredictionCol="_raw",
        maxIter=max_iterations,
        regParam=1.0 / (c * size["n"]),
        elasticNetParam=0.0,
        standardization=False,
        tol=1e-6,
    ).fit(data)
    names = IndexToString(inputCol="_prediction", outputCol="_predicted", labels=list(indexer.labels))
    return PipelineModel([*stages, regression, names])


def model_labels(model: PipelineModel) -> list[str]:
    return list(model.stages[-1].getLabels())


def _scored(df: DataFrame, model: PipelineModel, text) -> DataFrame:
    out = model.transform(_with_grams(df, text))
    return out.withColumn("_confidence", F.array_max(vector_to_array("_probability")))


def predict(df: DataFrame, model: PipelineModel, threshold: float = CONFIDENCE) -> DataFrame:
    """Append ``Predicted`` (Uncategorized below the threshold) and ``Confidence``."""
    label = F.when(F.col("_confidence") >= threshold, F.col("_predicted")).otherwise(
        F.lit(UNCATEGORIZED)
    )
    return _scored(df, model, F.col("Description")).select(
        *map(named, df.columns), label.alias("Predicted"), F.col("_confidence").alias("Confidence")
    )


def classify_two_stage(
    df: DataFrame,
    rules: Rules | DataFrame,
    model: PipelineModel | None = None,
    threshold: float = CONFIDENCE,
) -> DataFrame:
    """Rules first, the model for what they leave; adds ``Category``, ``ML_Classified``.

    The model sees each description that no rule matched once; what it accepts
    is stored and joined back. That starts jobs when called. Without a model
    the rules stand alone.
    """
    ruled = classify(df, rules)
    if model is None:
        return ruled.withColumn("ML_Classified", F.lit(False))
    open_texts = (
        ruled.filter((F.col("Category") == UNCATEGORIZED) & F.col("Description").isNotNull())
        .select("Description")
        .distinct()
    )
    accepted = stored(
        _scored(open_texts, model, F.col("Description"))
        .filter(F.col("_confidence") >= threshold)
        .select("Description", F.col("_predicted").alias("_label"))
    )
    joined = lookup(ruled, accepted, ["Description"])
    settled = (F.col("Category") == UNCATEGORIZED) & F.col("_label").isNotNull()
    return joined.select(
        *map(named, df.drop("Category", "ML_Classified").columns),
        F.when(settled, F.col("_label")).otherwise(F.col("Category")).alias("Category"),
        settled.alias("ML_Classified"),
    )


def save_model(spark: SparkSession, model: PipelineModel, meta: dict, folder: str) -> None:
    model.write().overwrite().save(f"{folder}/model")
    row = spark.createDataFrame(
        [(meta["trained_at"], int(meta["n_samples"]), list(meta["classes"]))],
        "trained_at string, n_samples bigint, classes array<string>",
    )
    row.coalesce(1).write.mode("overwrite").json(f"{folder}/meta")


def load_model(folder: str) -> PipelineModel | None:
    """The saved model; None if there is none. One that is there and cannot be read is an error."""
    try:
        SparkSession.active().read.text(f"{folder}/model/metadata").schema  # noqa: B018  looks the folder up
    except AnalysisException as err:
        if err.getCondition() == "PATH_NOT_FOUND":
            return None
        raise
    return PipelineModel.load(f"{folder}/model")


def is_model_stale(
    spark: SparkSession, model_folder: str, history: str | Sequence[str]
) -> bool:
    """Whether labelled history changed after the model was trained.

    Stale without readable meta data; fresh if either folder or all history
    files are missing.
    """
    folders = [history] if isinstance(history, str) else list(history)
    try:
        newest_file(spark, model_folder, "*")
        changed = [t for t in (newest_file(spark, f) for f in folders) if t is not None]
    except FileNotFoundError:
        return False
    try:
        meta = spark.read.schema("trained_at string").json(f"{model_folder}/meta").first()
    except AnalysisException:
        return True
    if not changed:
        return False
    try:
        trained = datetime.datetime.fromisoformat(meta["trained_at"])
    except (TypeError, ValueError):
        return True
    return max(changed).timestamp() > trained.timestamp()


def retrain(
    spark: SparkSession,
    history: str | Sequence[str],
    model_folder: str,
    fmt: str = "csv",
    include_ml: bool = True,
    min_samples: int = MIN_SAMPLES,
    width: int | None = None,
) -> dict:
    """Train on all labelled history, save model and meta data, return the latter."""
    # Before the scan: a file that lands while training runs counts as newer.
    began = datetime.datetime.now(datetime.UTC)
    training = stored(load_training_set(spark, history, fmt, include_ml))
    model = fit_model(training, min_samples, width=width)
    meta = {
        "trained_at": began.isoformat(),
        "n_samples": training.count(),
        "classes": model_labels(model),
    }
    save_model(spark, model, meta, model_folder)
    return meta
