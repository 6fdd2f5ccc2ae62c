"""Detectors fitted on the cluster, applied, stored and loaded."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel, Transformer
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import (
    IDF, CountVectorizerModel, ElementwiseProduct, NGram, Normalizer, RegexTokenizer, SQLTransformer,
)
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from hunkmill.functions.draws import order_key, unit_draw
from hunkmill.operators import linear
from hunkmill.operators.curves import areas
from hunkmill.operators.evaluation import probability_metrics
from hunkmill.operators.linear import LinearModel
from hunkmill.operators.terms import WORD, top_terms
from hunkmill.session import existing, landed

VOCABULARY = 5000
#: Bytes of a task's rows as a forest keeps them: a whole number for each feature, zeros included.
FOREST_TASK_BYTES = 128 << 20


def balanced_weights(rows: DataFrame, label: str = "label") -> DataFrame:
    """Adds ``weight`` = N / (classes * rows of the class), so that the weights sum to N."""
    sizes = rows.where(F.col(label).isin(0, 1)).groupBy(label).agg(
        F.count(F.lit(1)).alias("_rows")
    )
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    weights = sizes.select(
        label,
        (F.sum("_rows").over(every) / (F.count(F.lit(1)).over(every) * F.col("_rows"))).alias(
            "weight"
        ),
    )
    return rows.join(F.broadcast(weights), label)  # two rows


def embedding_features(rows: DataFrame, column: str = "embedding") -> DataFrame:
    return rows.withColumn("features", F.col(column).cast("array<double>"))


def fit_embedding_detector(
    rows: DataFrame, label: str = "label", max_iter: int = 50, strength: float = 1.0
) -> LinearModel:
    """Class-balanced logistic regression on dense vectors, at its one minimum.

    ``strength`` is the inverse penalty of the summed loss; the vectors are not rescaled.
    """
    weighted = balanced_weights(embedding_features(rows), label)
    return linear.fit_logistic(weighted, label, "weight", 1.0 / strength, max_steps=max_iter)


def loss_gradient(rows: DataFrame, model: LinearModel, label: str = "label", strength: float = 1.0) -> DataFrame:
    """(coefficient, gradient) of the class-balanced loss at a model, the intercept last; 0 at the
    minimum."""
    scored = model.score(balanced_weights(embedding_features(rows), label), "_p")
    pulled = F.col("weight") * (F.col("_p") - F.col(label))
    numbers = scored.select(pulled.alias("pull"), F.posexplode(F.concat("features", F.array(F.lit(1.0)))).alias("coefficient", "x"))
    sums = numbers.groupBy("coefficient").agg(F.sum(F.col("pull") * F.col("x")).alias("data"))
    own = F.element_at(F.array(*[F.lit(float(w)) for w in [*model.weights, 0.0]]), F.col("coefficient") + 1)
    return sums.select("coefficient", (F.col("data") + own / strength).alias("gradient"))


def score(model: Transformer | LinearModel, rows: DataFrame, name: str = "prob_ai") -> DataFrame:
    """Rows with the probability of class 1."""
    if isinstance(model, LinearModel):
        return model.score(rows, name)
    scored = model.transform(rows).withColumn(name, vector_to_array("probability")[1])
    return scored.select(*rows.columns, name)


def score_with(
    rows: DataFrame,
    predict: Callable[[pd.Series], pd.Series],
    column: str = "snippet",
    name: str = "prob_ai",
) -> DataFrame:
    """Any other detector: ``predict`` maps a batch of texts to probabilities.

    The function is called on Arrow batches; it should load its model once, on first use.
    """

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield predict(batch)

    return rows.withColumn(name, run(F.col(column)))


def fit_tfidf(rows: DataFrame, text: str = "text", vocabulary: int = VOCABULARY) -> PipelineModel:
    """Unit-length TF-IDF vectors of the most used terms, with ``idf = ln((1 + n) / (1 + df)) + 1``.

    Spark's IDF lacks the final 1, so the counts are scaled by ``idf + 1`` instead.
    """
    terms = [r.term for r in top_terms(rows, vocabulary, text).collect()]
    counter = CountVectorizerModel.from_vocabulary(terms or [""], inputCol="_terms", outputCol="_counts")
    base = PipelineModel(stages=[
        RegexTokenizer(inputCol=text, outputCol="_tokens", pattern=WORD, gaps=False, toLowercase=True),
        NGram(n=2, inputCol="_tokens", outputCol="_pairs"),
        SQLTransformer(statement="SELECT *, concat(_tokens, _pairs) AS _terms FROM __THIS__"),
        counter,
    ])
    idf = IDF(inputCol="_counts", outputCol="_idf").fit(base.transform(rows).select("_counts"))
    factors = Vectors.dense([x + 1.0 for x in idf.idf.toArray()])
    return PipelineModel(stages=[
        *base.stages,
        ElementwiseProduct(scalingVec=factors, inputCol="_counts", outputCol="_tfidf"),
        Normalizer(p=2.0, inputCol="_tfidf", outputCol="features"),
    ])


def with_folds(rows: DataFrame, key: str, folds: int = 5, seed: int = 42) -> DataFrame:
    """Adds ``_fold``, drawn from the key."""
    return rows.withColumn("_fold", F.floor(unit_draw(order_key(seed, F.col(key))) * folds).cast("int"))


def fit_linear_svm(
    features: DataFrame, key: str, label: str = "label", folds: int = 5, seed: int = 42
) -> LinearModel:
    """Linear SVM whose margins become probabilities by a logistic fit on held-out folds."""
    return linear.fit_svm(with_folds(features, key, folds, seed), "_fold", folds, label)


def dealt_for_forest(rows: DataFrame, features: int) -> DataFrame:
    """The rows in tasks of no more than ``FOREST_TASK_BYTES`` of a forest's own rows, which are as long
    for sparse vectors as for dense ones; files tell nothing about that. Rows that are dealt so already
    stay where they are."""
    most = max(FOREST_TASK_BYTES // (4 * max(features, 1)), 1)
    tasks = rows.groupBy(F.spark_partition_id().alias("task")).agg(F.count("*").alias("n"))
    found = tasks.agg(F.max("n").alias("most"), F.sum("n").alias("n")).first()
    if (found.most or 0) <= most:
        return rows
    return rows.repartition(-(-found.n // most))


def fit_text_models(
    train: DataFrame, key: str, label: str = "label", trees: int = 100, folds: int = 5, seed: int = 42
) -> dict[str, Transformer | LinearModel]:
    """The compared classifiers, by display name.

    The logistic regression, the machine and its folds go down in the same passes; naive Bayes is one
    pass; only the forest has passes of its own.
    """
    dealt = with_folds(train, key, folds, seed)
    size = linear.width(dealt) + 1
    starts = [linear.Descent(size, "logistic"), *[linear.Descent(size, "hinge", k) for k in [-1, *range(folds)]]]
    logistic, whole, *parts = linear.descend(dealt, starts, label, "_fold")
    slope, shift = linear.fit_sigmoid(linear.held_out_margins(dealt, parts, "_fold", label), label)
    forest = RandomForestClassifier(labelCol=label, numTrees=trees, seed=seed)
    return {
        "Logistic Regression": logistic,
        "Random Forest": forest.fit(dealt_for_forest(train, size - 1)),
        "Naive Bayes": linear.fit_bayes(train, label),
        "SVM (Linear)": LinearModel(whole.weights, whole.intercept, slope, shift),
    }


def compare_text_models(
    rows: DataFrame,
    key: str,
    text: str = "text",
    label: str = "label",
    vocabulary: int = VOCABULARY,
    trees: int = 100,
) -> DataFrame:
    """Metrics per model on the rows with ``is_test`` = 1, fitted on the others."""
    rows = landed(rows.select(key, label, text, "is_test"), "labelled-texts")
    tfidf = fit_tfidf(rows.where("is_test = 0"), text, vocabulary)
    # Read by every step of the fits.
    features = landed(tfidf.transform(rows).select(key, label, "is_test", "features"), "features")
    train, test = features.where("is_test = 0"), features.where("is_test = 1")
    fitted = fit_text_models(train, key, label, trees)
    scored = None
    for name, model in fitted.items():
        part = score(model, test.select(label, "features"), "probability")
        part = part.select(F.lit(name).alias("Model"), F.col(label).alias("label"), "probability")
        scored = part if scored is None else scored.unionByName(part)
    return probability_metrics(scored, ["Model"])


def detector_areas(scored: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """ROC and precision-recall areas of any detector's ``score`` against ``label``."""
    return areas(scored, by)


@dataclass(frozen=True)
class Detector:
    """A fitted model with the configuration it was calibrated to."""

    model: PipelineModel | LinearModel
    threshold: float | None = None
    strata: DataFrame | None = None


def _contents(spark: SparkSession, folder: str) -> tuple[int, str]:
    """How many files a folder has, and a digest of their names and contents."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    name = F.element_at(F.split("path", "/"), -1)
    told = files.select(F.concat_ws(" ", name, F.sha2("content", 256)).alias("told"))
    found = told.agg(F.count("*").alias("n"), F.sha2(F.array_join(F.array_sort(F.collect_list("told")), "\n"), 256).alias("digest")).first()
    return found.n, found.digest


def save(detector: Detector, path: str) -> None:
    """A new version of a stored detector. Its manifest is added last, with a digest of all files, so
    what was cut off is never loaded."""
    spark = SparkSession.active()
    folder = f"{path}/{uuid.uuid4().hex}"
    model = detector.model
    if isinstance(model, LinearModel):
        numbers = [(i, float(x)) for i, x in enumerate([*model.weights, model.intercept, model.slope, model.shift])]
        spark.createDataFrame(numbers, "place int, value double").coalesce(1).write.parquet(f"{folder}/model")
    else:
        model.write().save(f"{folder}/model")
    if detector.strata is not None:
        detector.strata.write.parquet(f"{folder}/strata")
    files, digest = _contents(spark, folder)
    known = _manifests(spark, path)
    version = 1 + max((m.version for m in known), default=0)
    row = (version, folder.rsplit("/", 1)[1], type(model).__name__, detector.threshold, detector.strata is not None, files, digest)
    spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").json(f"{path}/manifest")


MANIFEST = "version long, folder string, kind string, threshold double, has_strata boolean, files long, digest string"


def _manifests(spark: SparkSession, path: str) -> list:
    if not existing(spark, [f"{path}/manifest"]):
        return []
    return spark.read.schema(MANIFEST).json(f"{path}/manifest").collect()


def load(spark: SparkSession, path: str) -> Detector:
    """The latest whole version. A version without a manifest, or whose files are not those that were
    saved, does not count."""
    for row in sorted(_manifests(spark, path), key=lambda m: -m.version):
        folder = f"{path}/{row.folder}"
        if not existing(spark, [folder]) or _contents(spark, folder) != (row.files, row.digest):
            continue
        strata = spark.read.parquet(f"{folder}/strata") if row.has_strata else None
        if row.kind == LinearModel.__name__:
            numbers = [r.value for r in spark.read.parquet(f"{folder}/model").orderBy("place").collect()]
            model = LinearModel(np.array(numbers[:-3]), *numbers[-3:])
        else:
            model = PipelineModel.load(f"{folder}/model")
        return Detector(model, row.threshold, strata)
    raise ValueError(f"no whole detector at {path}")
