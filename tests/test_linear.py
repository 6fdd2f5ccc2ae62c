"""Linear models, term counts and the detector store."""

import tracemalloc

import math
import random
import shutil
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from hunkmill.operators import linear, models, terms


@pytest.fixture(scope="module")
def points(spark):
    dice = np.random.default_rng(1)
    x = dice.normal(size=(400, 3)) + [0.5, 0, 0]
    y = (x @ [1.0, -2.0, 0.3] + dice.normal(size=400) > 0.4).astype(int)
    rows = [(i, [float(v) for v in x[i]], int(y[i]), 1.0 + i % 3) for i in range(400)]
    return x, y, spark.createDataFrame(rows, "id int, features array<double>, label int, w double").repartition(5)


def test_the_logistic_fit_has_no_gradient_left(points):
    x, y, rows = points
    model = linear.fit_logistic(rows, weight="w", penalty=0.5)
    w = 1.0 + np.arange(400) % 3
    pull = w * (linear.logistic(x @ model.weights + model.intercept) - y)
    assert np.abs(x.T @ pull + 0.5 * model.weights).max() < 1e-6 and abs(pull.sum()) < 1e-6
    scored = {r.id: r.p for r in model.score(rows, "p").collect()}
    assert scored[7] == pytest.approx(1 / (1 + math.exp(-(x[7] @ model.weights + model.intercept))))


def test_many_tasks_sum_alike(points, monkeypatch):
    _, _, rows = points
    one = linear.fit_logistic(rows)
    monkeypatch.setattr(linear, "FEW_TASKS", 0)
    two = linear.fit_logistic(rows)
    assert np.allclose(one.weights, two.weights, atol=1e-9)


def test_descents_of_all_folds_equal_fits_of_their_own(points):
    _, _, rows = points
    dealt = rows.withColumn("fold", F.col("id") % 2)
    together = linear.descend(dealt, [linear.Descent(4, loss, k) for loss in ("logistic", "hinge") for k in (-1, 0, 1)], fold="fold", tolerance=1e-7)
    for loss, found in (("logistic", together[:3]), ("hinge", together[3:])):
        for k, model in zip((-1, 0, 1), found):
            alone, = linear.descend(dealt.where(F.col("fold") != k), [linear.Descent(4, loss)], tolerance=1e-7)
            assert np.allclose(alone.weights, model.weights, atol=1e-4)
    newton = linear.fit_logistic(rows)
    assert np.allclose(newton.weights, together[0].weights, atol=1e-4)


def test_sparse_dense_and_missing_vectors(spark):
    rows = spark.createDataFrame([(0, Vectors.sparse(3, {1: 2.0})), (1, Vectors.dense([1.0, 0.0, 4.0])), (2, Vectors.sparse(3, {})), (3, None)], ["id", "features"])
    model = linear.LinearModel(np.array([1.0, 10.0, 100.0]), 0.5)
    assert {r.id: r.m for r in model.margin(rows, "m").collect()} == {0: 20.5, 1: 401.5, 2: 0.5, 3: None}


def test_bayes_is_the_closed_form(spark):
    rows = [(0, [1.0, 0.0, 2.0]), (0, [0.0, 1.0, 1.0]), (1, [3.0, 0.0, 0.0])]
    model = linear.fit_bayes(spark.createDataFrame([(y, Vectors.dense(x)) for y, x in rows], ["label", "features"]))
    zero, one = np.array([2.0, 2.0, 4.0]) / 8, np.array([4.0, 1.0, 1.0]) / 6
    assert np.allclose(model.weights, np.log(one / zero)) and model.intercept == pytest.approx(math.log(1 / 2))


@pytest.mark.parametrize("kept", [1 << 20, 60, 8])
def test_top_terms_are_exact_however_few_are_kept(spark, monkeypatch, kept):
    monkeypatch.setattr(terms, "KEPT", kept)
    dice = random.Random(3)
    texts = [" ".join(f"wo{int(40 * dice.random() ** 4)}" for _ in range(dice.randrange(30))) for _ in range(300)] + [None, "", "a ÉÉ éé"]
    counts = Counter()
    for text in texts:
        words = [w.lower() for w in (text or "").split() if len(w) > 1]
        counts.update(words)
        counts.update(f"{a} {b}" for a, b in zip(words, words[1:]))
    frame = spark.createDataFrame([(x,) for x in texts], "text string").repartition(3)
    for n in (5, 5000):
        want = sorted(counts.items(), key=lambda c: (-c[1], c[0]))[:n]
        assert {(r.term, r.uses) for r in terms.top_terms(frame, n).collect()} == set(want)


def test_only_whole_detectors_are_loaded(spark, tmp_path):
    path = str(tmp_path / "store")
    strata = spark.createDataFrame([("Java", "source", "short")], "language string, file_category string, length_bucket string")
    first = linear.LinearModel(np.array([1.5, -2.25]), 0.125, 2.0, 3.0)
    with pytest.raises(ValueError):
        models.load(spark, path)
    models.save(models.Detector(first, 0.45, strata), path)
    models.save(models.Detector(linear.LinearModel(np.array([9.0]), 1.0), 0.6), path)
    second = models.load(spark, path)
    assert second.threshold == 0.6 and second.strata is None and second.model.weights.tolist() == [9.0]
    # The second version loses a file, as if its write had been cut off.
    newest = max((p for p in (tmp_path / "store").iterdir() if p.name != "manifest"), key=lambda p: p.stat().st_mtime)
    cut = next((newest / "model").glob("part*"))
    shutil.move(str(cut), str(tmp_path / "lost"))
    older = models.load(spark, path)
    assert older.threshold == 0.45 and [tuple(r) for r in older.strata.collect()] == [("Java", "source", "short")]
    assert (older.model.weights.tolist(), older.model.intercept, older.model.slope, older.model.shift) == ([1.5, -2.25], 0.125, 2.0, 3.0)


def test_a_sketch_holds_no_terms_as_python_objects():
    words = pa.array([[f"w{i}x{j}" for j in range(100)] for i in range(2000)])
    batch = pa.RecordBatch.from_arrays([words], ["words"])
    tracemalloc.start()
    found = pa.Table.from_batches(list(terms._sketch(iter([batch]))))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(found) == 2000 * (100 + 99) + 1 and found["uses"].to_pylist()[-1] == 0
    assert peak < 16 << 20


def test_a_forest_task_holds_bounded_rows(spark, monkeypatch):
    """A task keeps whole rows of numbers, however sparse the vectors are."""
    rows = spark.createDataFrame([(float(i % 2), Vectors.sparse(1000, [i % 7], [1.0])) for i in range(400)], ["label", "features"]).coalesce(1)
    assert models.dealt_for_forest(rows, 1000).rdd.getNumPartitions() == 1
    monkeypatch.setattr(models, "FOREST_TASK_BYTES", 100 * 4 * 1000)
    dealt = models.dealt_for_forest(rows, 1000)
    sizes = [r["count"] for r in dealt.groupBy(F.spark_partition_id()).count().collect()]
    assert sum(sizes) == 400 and max(sizes) <= 110
    assert sorted(map(repr, dealt.collect())) == sorted(map(repr, rows.collect()))
    assert models.dealt_for_forest(rows.limit(0), 1000).count() == 0
