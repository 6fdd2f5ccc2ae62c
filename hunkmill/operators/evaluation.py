"""Confusion counts, threshold choice, stratum checks and probability metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.functions import fixed_values as fv
from hunkmill.functions.scoring import ratio
from hunkmill.functions.shape import row_array

METRICS = [
    "accuracy", "balanced_accuracy", "precision", "recall", "false_positive_rate",
    "false_negative_rate",
]
COUNTS = ["tp", "tn", "fp", "fn"]
STRATUM = ["language", "file_category", "length_bucket"]


def confusion_counts(
    threshold: Column, label: str = "label", score: str = "prob_ai"
) -> list[Column]:
    machine, flagged = F.col(label) == 1, (F.col(score) >= threshold) & ~F.isnan(score)
    return [
        F.count_if(flagged & machine).alias("tp"), F.count_if(~flagged & ~machine).alias("tn"),
        F.count_if(flagged & ~machine).alias("fp"), F.count_if(~flagged & machine).alias("fn"),
    ]


def add_metrics(counts: DataFrame) -> DataFrame:
    """Six ratios from tp, tn, fp, fn; a division by zero gives 0.

    Balanced accuracy is the mean recall of the classes that occur.
    """
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    classes = F.when(tp + fn > 0, 1).otherwise(0) + F.when(tn + fp > 0, 1).otherwise(0)
    return counts.withColumns({
        "accuracy": ratio(tp + tn, tp + tn + fp + fn),
        "balanced_accuracy": ratio(ratio(tp, tp + fn) + ratio(tn, tn + fp), classes),
        "precision": ratio(tp, tp + fp),
        "recall": ratio(tp, tp + fn),
        "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp),
    })


def confusion_metrics(predictions: DataFrame, threshold: float) -> DataFrame:
    """One row of counts and metrics at a threshold."""
    counts = predictions.agg(*confusion_counts(F.lit(threshold)))
    return add_metrics(counts).select(F.lit(threshold).alias("threshold"), *METRICS, *COUNTS)


def threshold_sweep(
    predictions: DataFrame, thresholds: Sequence[float] = fv.THRESHOLD_GRID
) -> DataFrame:
    """Metrics at every threshold, from one pass over the predictions.

    Each row only needs to know how many thresholds its score reaches. That gives a table of at
    most ``len(thresholds) + 1`` rows, and the sweep is done on that table.
    """
    grid = sorted(thresholds)
    reached = sum((((F.col("prob_ai") >= t) & ~F.isnan("prob_ai")).cast("int") for t in grid), F.lit(0))
    levels = predictions.groupBy(reached.alias("reached")).agg(
        F.count_if(F.col("label") == 1).alias("machine"),
        F.count_if(F.col("label") == 0).alias("human"),
    )
    places = row_array(["place", "threshold"], *enumerate(grid))
    flagged = F.col("reached") > F.col("place")

    def total(column: str, condition: Column) -> Column:
        return F.sum(F.when(condition, F.col(column)).otherwise(0))

    counts = levels.select("*", F.inline(places)).groupBy("threshold").agg(
        total("machine", flagged).alias("tp"), total("human", ~flagged).alias("tn"),
        total("human", flagged).alias("fp"), total("machine", ~flagged).alias("fn"),
    )
    return add_metrics(counts).select("threshold", *METRICS, *COUNTS).orderBy(*_best_first())


def _best_first() -> list[Column]:
    return [
        F.col("balanced_accuracy").desc(), F.col("precision").desc(), F.col("recall").desc(),
        F.col("threshold"),
    ]


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The sweep's best row: balanced accuracy, then precision, then recall."""
    return sweep.orderBy(*_best_first()).limit(1)


def stratum_metrics(
    predictions: DataFrame,
    threshold: float,
    groupings: Sequence[Sequence[str]] = (
        ("language",), ("file_category",), ("length_bucket",), STRATUM,
    ),
    min_rows: int = fv.MIN_STRATUM_ROWS,
) -> DataFrame:
    """Metrics per stratum for several groupings at once; columns not grouped by are null.

    The rows are aggregated once, by the finest strata; the groupings are sums over that table.
    Strata with fewer than ``min_rows`` rows or only one class are left out.
    """
    columns = list(dict.fromkeys(c for grouping in groupings for c in grouping))
    finest = predictions.groupBy(*columns).agg(*confusion_counts(F.lit(threshold)))
    grouped = finest.groupingSets([list(g) for g in groupings], *columns).agg(
        *[F.sum(c).alias(c) for c in COUNTS],
        *[F.grouping(c).alias(f"_not_{c}") for c in columns],
    )
    for c in columns:
        grouped = grouped.where(F.col(c).isNotNull() | (F.col(f"_not_{c}") == 1))
    tp, tn, fp, fn = (F.col(c) for c in COUNTS)
    sound = grouped.withColumn("support", tp + tn + fp + fn).where(
        (F.col("support") >= min_rows) & (tp + fn > 0) & (tn + fp > 0)
    )
    return add_metrics(sound).select(
        "support", *columns, F.lit(threshold).alias("threshold"), *METRICS, *COUNTS
    )


def frozen_strata(combined: DataFrame, predictions: DataFrame) -> DataFrame:
    """Strata good enough to be used.

    Without any, every combination of seen values with source or test files that are not very short.
    """
    good = combined.where(
        (F.col("support") >= fv.FROZEN_MIN_SUPPORT)
        & (F.col("balanced_accuracy") >= fv.FROZEN_MIN_BALANCED_ACCURACY)
        & (F.col("false_positive_rate") <= fv.FROZEN_MAX_FALSE_POSITIVE_RATE)
    ).select(*STRATUM)
    seen = predictions.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in STRATUM])
    for c in STRATUM:  # three short value lists, unfolded one after the other
        seen = seen.withColumn(c, F.explode(c))
    fallback = seen.where(
        F.col("file_category").isin(fv.MAIN_FILE_CATEGORIES)
        & ~F.col("length_bucket").isin(fv.EXCLUDED_LENGTH_BUCKETS)
        & (good.agg(F.count(F.lit(1))).scalar() == 0)
    )
    return good.unionByName(fallback.select(*STRATUM))


def frozen_config(strata: DataFrame, predictions: DataFrame, threshold: float) -> DataFrame:
    """The one-row configuration the trend job runs with."""
    languages = predictions.agg(F.array_sort(F.collect_set("language"))).scalar()
    texts = [
        ("main_file_categories", fv.MAIN_FILE_CATEGORIES),
        ("excluded_file_categories", fv.EXCLUDED_FILE_CATEGORIES),
        ("excluded_length_buckets", fv.EXCLUDED_LENGTH_BUCKETS),
    ]
    return strata.agg(
        F.lit(threshold).alias("threshold"),
        F.array_sort(F.collect_list(F.struct(*STRATUM))).alias("allowed_combinations"),
    ).select(
        "threshold", "allowed_combinations", languages.alias("main_languages"),
        *[F.array(*[F.lit(v) for v in values]).alias(name) for name, values in texts],
        F.lit("Scores say how machine-like a hunk looks; calibrated on sampled hunks.").alias(
            "notes"
        ),
    )


def exclusion_table(config: DataFrame) -> DataFrame:
    rows = row_array(
        ["type", "value"],
        ["excluded_file_categories", F.array_join("excluded_file_categories", ",")],
        ["excluded_length_buckets", F.array_join("excluded_length_buckets", ",")],
        ["threshold", F.col("threshold").cast("string")],
        ["allowed_combinations", F.size("allowed_combinations").cast("string")],
    )
    return config.select(F.inline(rows))


def probability_metrics(
    rows: DataFrame,
    by: Sequence[str] = (),
    label: str = "label",
    probability: str = "probability",
    prediction: str | None = None,
) -> DataFrame:
    """Accuracy, F1, precision, recall, Brier score and R2 of predicted probabilities.

    Rows are flagged above one half unless ``prediction`` names a 0/1 column. R2 is null when only
    one class occurs.
    """
    y, p = F.col(label), F.col(probability)
    flagged = (p > 0.5) if prediction is None else (F.col(prediction) == 1)
    machine = y == 1
    sums = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(flagged & machine).alias("tp"), F.count_if(~flagged & ~machine).alias("tn"),
        F.count_if(flagged & ~machine).alias("fp"), F.count_if(~flagged & machine).alias("fn"),
        F.sum((y - p) * (y - p)).alias("_squares"),
    )
    positive = F.col("tp") + F.col("fn")
    spread = positive - positive * positive / F.col("n")
    precision, recall = ratio(F.col("tp"), F.col("tp") + F.col("fp")), ratio(F.col("tp"), positive)
    return sums.select(
        *by, "n",
        ratio(F.col("tp") + F.col("tn"), F.col("n")).alias("accuracy"),
        ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")).alias("f1"),
        precision.alias("precision"), recall.alias("recall"),
        (F.col("_squares") / F.col("n")).alias("mse"),
        F.when(spread > 0, 1 - F.col("_squares") / spread).alias("r2"),
    )


def metrics_long(wide: DataFrame, model: str = "Model") -> DataFrame:
    """(Model, Metric, Score) from one column per metric."""
    metrics = [c for c in wide.columns if c != model]
    doubles = wide.select(model, *[F.col(c).cast("double").alias(c) for c in metrics])
    return doubles.unpivot([model], metrics, "Metric", "Score")
