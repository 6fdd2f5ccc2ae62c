"""Linear models fitted by sums over the rows.

A step of a fit is one pass: every task sums its rows into an array of the model's size, the arrays are
added up in two levels, and the next point is found on the driver, which never sees a row.
``fit_logistic`` is Newton's method on the Gram matrix of the features, for vectors of up to some
thousand numbers. ``descend`` takes many models down at once, each with the rows it may see, so that all
folds of a validation cost as many passes as one model.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from hunkmill.session import landed

#: From more tasks than this on, their arrays are first added up by ``SUMMED_IN`` tasks.
FEW_TASKS, SUMMED_IN = 32, 16


@dataclass(frozen=True)
class LinearModel:
    """``margin`` = features . weights + intercept, the probability of class 1 its logistic function of
    ``slope * margin + shift``."""

    weights: np.ndarray
    intercept: float
    slope: float = 1.0
    shift: float = 0.0

    def margins(self, column: pa.Array) -> np.ndarray:
        return Entries(column).product(self.weights[:, None])[:, 0] + self.intercept

    def score(self, rows: DataFrame, name: str = "prob_ai", features: str = "features") -> DataFrame:
        """Rows with the probability of class 1."""
        model = self

        @F.arrow_udf("double")
        def probability(column: pa.Array) -> pa.Array:
            shares = logistic(model.slope * model.margins(column) + model.shift)
            return pa.array(shares, mask=pc.is_null(column).to_numpy(zero_copy_only=False))

        return rows.withColumn(name, probability(plain(rows, features)))

    def margin(self, rows: DataFrame, name: str = "margin", features: str = "features") -> DataFrame:
        """Rows with the margin."""
        model = self

        @F.arrow_udf("double")
        def margin(column: pa.Array) -> pa.Array:
            return pa.array(model.margins(column), mask=pc.is_null(column).to_numpy(zero_copy_only=False))

        return rows.withColumn(name, margin(plain(rows, features)))


class Entries:
    """The numbers of a batch of vectors: Spark's own (as structs, sparse or dense) or lists."""

    def __init__(self, column: pa.Array):
        sparse = pa.types.is_struct(column.type)
        values = column.field("values") if sparse else column
        if sparse and column.null_count:
            values = pc.if_else(pc.is_valid(column), values, pa.scalar(None, values.type))
        sizes = pc.fill_null(pc.list_value_length(values), 0).to_numpy().astype(np.int64)
        self.rows = len(column)
        self.row = np.repeat(np.arange(self.rows), sizes)
        self.value = values.flatten().to_numpy(zero_copy_only=False).astype(float)
        self.index = np.arange(len(self.value)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        if sparse:
            places = column.field("indices")
            given = np.repeat(pc.is_valid(places).to_numpy(zero_copy_only=False), sizes)
            self.index[given] = pc.if_else(pc.is_valid(values), places, pa.scalar(None, places.type)).flatten().to_numpy()

    def product(self, weights: np.ndarray) -> np.ndarray:
        """Rows times models."""
        return np.stack([np.bincount(self.row, self.value * w[self.index], self.rows) for w in weights.T], axis=1)

    def transposed(self, factors: np.ndarray, size: int) -> np.ndarray:
        """Features times models: each row's numbers times the row's factors."""
        return np.stack([np.bincount(self.index, self.value * f[self.row], size) for f in factors.T], axis=1)


def plain(rows: DataFrame, features: str):
    """The features as Arrow can carry them."""
    if rows.schema[features].dataType.typeName() == "vector" or "Vector" in type(rows.schema[features].dataType).__name__:
        return F.unwrap_udt(F.col(features))
    return F.col(features).cast("array<double>")


def logistic(margins: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(margins, -700, 700)))


def summed(rows: DataFrame, partial: Callable[[Iterator[pa.RecordBatch]], np.ndarray]) -> np.ndarray:
    """The sum of what every task makes of its rows (a written table). Arrays are added in the order of
    the tasks."""

    def work(batches):
        found = partial(batches)
        task = TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays([pa.array([task], pa.int64()), pa.array([found.tobytes()], pa.binary())], ["task", "data"])

    def merge(batches):
        total, first = None, None
        for batch in batches:
            for task, data in zip(batch["task"].to_pylist(), batch["data"]):
                one = np.frombuffer(data.as_buffer())
                total, first = (one.copy(), task) if total is None else (total + one, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int64()), pa.array([total.tobytes()], pa.binary())], ["task", "data"])

    kind = "task long, data binary"
    parts = rows.mapInArrow(work, kind)
    if rows.rdd.getNumPartitions() > FEW_TASKS:
        parts = parts.repartition(SUMMED_IN, F.col("task") % SUMMED_IN).sortWithinPartitions("task").mapInArrow(merge, kind)
    found = sorted(parts.collect(), key=lambda r: r.task)
    return np.sum([np.frombuffer(r.data) for r in found], axis=0) if found else np.zeros(0)


def width(rows: DataFrame, features: str = "features") -> int:
    """How many numbers the vectors have."""
    first = rows.select(plain(rows, features).alias("f")).where("f IS NOT NULL").first()
    if first is None:
        raise ValueError("no vectors to fit")
    return first.f["size"] or len(first.f["values"]) if hasattr(first.f, "asDict") else len(first.f)


def fit_logistic(
    rows: DataFrame, label: str = "label", weight: str | None = None, penalty: float = 1.0,
    features: str = "features", max_steps: int = 50, tolerance: float = 1e-9,
) -> LinearModel:
    """The one minimum of the weighted logistic loss plus ``penalty`` / 2 times the squared weights.

    Labels are shares in [0, 1]. Each step solves the normal equations of the rows, reweighted by how
    undecided they are; a step that makes the loss worse is halved. It ends when no coefficient's
    gradient exceeds ``tolerance`` times the total weight.
    """
    size = width(rows, features) + 1
    # Every step reads the rows again.
    ask = rows.select(plain(rows, features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(weight) if weight else F.lit(1.0)).cast("double").alias("w"))
    ask = landed(ask.where("x IS NOT NULL AND y IS NOT NULL AND w IS NOT NULL"), "weighted-rows")

    def at(point: np.ndarray) -> tuple[float, float, np.ndarray, np.ndarray]:
        def partial(batches):
            out = np.zeros(2 + size + size * size)
            for batch in batches:
                entries = Entries(batch["x"])
                x = np.zeros((entries.rows, size))
                x[entries.row, entries.index] = entries.value
                x[:, -1] = 1.0
                y, w = batch["y"].to_numpy(), batch["w"].to_numpy()
                margin = x @ point
                p = logistic(margin)
                out[0] += float(w @ (np.logaddexp(0.0, margin) - y * margin))
                out[1] += w.sum()
                out[2:2 + size] += x.T @ (w * (p - y))
                out[2 + size:] += (x.T * (w * p * (1 - p)) @ x).ravel()
            return out

        found = summed(ask, partial)
        own = np.append(np.full(size - 1, penalty), 0.0)
        return (
            found[0] + 0.5 * float(own @ point**2), found[1],
            found[2:2 + size] + own * point, found[2 + size:].reshape(size, size) + np.diag(own),
        )

    point = np.zeros(size)
    loss, total, gradient, gram = at(point)
    for _ in range(max_steps):
        if np.abs(gradient).max() <= tolerance * max(total, 1.0):
            break
        step = np.linalg.lstsq(gram, gradient, rcond=None)[0]
        for halved in range(30):
            trial = point - step / 2**halved
            found = at(trial)
            if found[0] <= loss * (1 + 1e-14):
                break
        else:
            break
        point, (loss, total, gradient, gram) = trial, found
    return LinearModel(point[:-1], float(point[-1]))


@dataclass
class Descent:
    """One model on its way down, by limited-memory quasi-Newton steps."""

    size: int
    loss: str  # "logistic" or "hinge" (its square, which has a gradient everywhere)
    without: int = -1  # the fold it must not see
    penalty: float = 1.0
    memory: int = 10
    point: np.ndarray = None
    value: float = np.inf
    gradient: np.ndarray = None
    trial: np.ndarray = None
    step: float = 1.0
    done: bool = False
    steps: list = field(default_factory=list)

    def __post_init__(self):
        self.trial = np.zeros(self.size)

    def tell(self, value: float, gradient: np.ndarray, tolerance: float) -> None:
        """Takes the value at the trial point; sets the next one."""
        if self.point is not None:
            moved = self.trial - self.point
            if value > self.value + 1e-4 * float(self.gradient @ moved):
                self.step /= 2
                self.done = self.step < 1e-10
                self.trial = self.point + moved / 2
                return
            turned = gradient - self.gradient
            if moved @ turned > 1e-12 * (moved @ moved):
                self.steps = [*self.steps, (moved, turned)][-self.memory:]
        else:
            self.first = np.abs(gradient).max()
        self.point, self.value, self.gradient, self.step = self.trial, value, gradient, 1.0
        self.done = np.abs(gradient).max() <= tolerance * max(self.first, 1e-12)
        direction = gradient.copy()
        parts = []
        for s, y in reversed(self.steps):
            a = (s @ direction) / (s @ y)
            direction -= a * y
            parts.append((a, s, y))
        if self.steps:
            s, y = self.steps[-1]
            direction *= (s @ y) / (y @ y)
        else:
            direction /= max(np.linalg.norm(gradient), 1.0)
        for a, s, y in reversed(parts):
            direction += (a - (y @ direction) / (s @ y)) * s
        self.trial = self.point - direction


def descend(
    rows: DataFrame, models: Sequence[Descent], label: str = "label", fold: str | None = None,
    features: str = "features", max_passes: int = 60, tolerance: float = 1e-3,
) -> list[LinearModel]:
    """All models fitted in the same passes over the rows.

    A model is done when its gradient has fallen to ``tolerance`` of the first one's.
    """
    asked = rows.select(plain(rows, features).alias("x"), F.col(label).cast("double").alias("y"), (F.col(fold) if fold else F.lit(-1)).cast("long").alias("fold"))
    asked = landed(asked.where("x IS NOT NULL AND y IS NOT NULL"), "labelled-rows")
    size = models[0].size
    for _ in range(max_passes):
        open_ = [m for m in models if not m.done]
        if not open_:
            break
        points = np.stack([m.trial for m in open_], axis=1)
        hinge = np.array([m.loss == "hinge" for m in open_])
        without = np.array([m.without for m in open_])

        def partial(batches):
            values, gradients = np.zeros(len(without)), np.zeros((size, len(without)))
            for batch in batches:
                entries, y = Entries(batch["x"]), batch["y"].to_numpy()[:, None]
                margin = entries.product(points[:-1]) + points[-1]
                seen = (batch["fold"].to_numpy()[:, None] != without) | (without < 0)
                short = np.maximum(0.0, 1.0 - (2 * y - 1) * margin)
                loss = np.where(hinge, short**2, np.logaddexp(0.0, margin) - y * margin)
                slope = np.where(hinge, -2 * (2 * y - 1) * short, logistic(margin) - y)
                values += (loss * seen).sum(axis=0)
                gradients[:-1] += entries.transposed(slope * seen, size - 1)
                gradients[-1] += (slope * seen).sum(axis=0)
            return np.concatenate([values, gradients.ravel()])

        found = summed(asked, partial)
        values, gradients = found[:len(open_)], found[len(open_):].reshape(size, len(open_))
        for i, model in enumerate(open_):
            own = np.append(np.full(size - 1, model.penalty), 0.0) * model.trial
            model.tell(values[i] + 0.5 * float(own @ model.trial), gradients[:, i] + own, tolerance)
    return [LinearModel(m.point[:-1], float(m.point[-1])) for m in models]


def fit_sigmoid(margins: DataFrame, label: str = "label", margin: str = "margin") -> tuple[float, float]:
    """(slope, shift) that turn margins into probabilities, by Platt's fit: targets are drawn in by one
    row of each class, so that separable margins have a finite slope."""
    sizes = margins.agg(F.count_if(F.col(label) == 1).alias("one"), F.count_if(F.col(label) == 0).alias("zero")).first()
    target = F.when(F.col(label) == 1, (sizes.one + 1) / (sizes.one + 2)).otherwise(1 / (sizes.zero + 2))
    rows = margins.select(F.array(F.col(margin).cast("double")).alias("features"), target.alias("target"))
    model = fit_logistic(rows, "target", penalty=0.0)
    return float(model.weights[0]), model.intercept


def fit_svm(
    rows: DataFrame, fold: str, folds: int, label: str = "label", features: str = "features", penalty: float = 1.0,
) -> LinearModel:
    """A linear support vector machine with probabilities.

    The machine of all rows and those that leave out a fold each go down together. Every row gets its
    margin from the machine that has not seen it, and these margins make the sigmoid.
    """
    size = width(rows, features) + 1
    starts = [Descent(size, "hinge", k, penalty) for k in [-1, *range(folds)]]
    whole, *parts = descend(rows, starts, label, fold, features)
    slope, shift = fit_sigmoid(held_out_margins(rows, parts, fold, label, features), label)
    return LinearModel(whole.weights, whole.intercept, slope, shift)


def held_out_margins(rows: DataFrame, parts: Sequence[LinearModel], fold: str, label: str = "label", features: str = "features") -> DataFrame:
    """(label, margin): of each row by the model of its own fold."""
    weights = np.stack([np.append(m.weights, m.intercept) for m in parts], axis=1)

    def work(batches):
        for batch in batches:
            own = Entries(batch["x"]).product(weights[:-1]) + weights[-1]
            margin = own[np.arange(len(own)), batch["fold"].to_numpy()]
            yield pa.RecordBatch.from_arrays([batch["y"], pa.array(margin)], [label, "margin"])

    asked = rows.select(plain(rows, features).alias("x"), F.col(label).cast("double").alias("y"), F.col(fold).cast("long").alias("fold"))
    return asked.where("x IS NOT NULL AND y IS NOT NULL").mapInArrow(work, f"{label} double, margin double")


def fit_bayes(rows: DataFrame, label: str = "label", features: str = "features", smoothing: float = 1.0) -> LinearModel:
    """Multinomial naive Bayes of two classes in closed form: sums of the features per class. Its log
    odds are linear in the features."""
    size = width(rows, features)
    asked = rows.select(plain(rows, features).alias("x"), F.col(label).cast("double").alias("y")).where("x IS NOT NULL AND y IN (0, 1)")

    def partial(batches):
        sums, count = np.zeros((size, 2)), np.zeros(2)
        for batch in batches:
            y = batch["y"].to_numpy()
            sums += Entries(batch["x"]).transposed(np.stack([1 - y, y], axis=1), size)
            count += [np.sum(y == 0), np.sum(y == 1)]
        return np.concatenate([sums.ravel(), count])

    found = summed(asked, partial)
    sums, count = found[:-2].reshape(size, 2) + smoothing, found[-2:]
    shares = np.log(sums) - np.log(sums.sum(axis=0))
    return LinearModel(shares[:, 1] - shares[:, 0], float(np.log(count[1]) - np.log(count[0])))
