"""ROC and precision-recall curves, areas, and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.functions.scoring import ratio
from hunkmill.functions.shape import row_array
from hunkmill.operators.ordered import exact_quantiles, running_totals
from hunkmill.session import landed


def labelled_scores(pairs: DataFrame, real: str, sampled: str, kept: Sequence[str]) -> DataFrame:
    """Two rows per pair: (0, score of the real text) and (1, score of the sampled text)."""
    sides = row_array(["label", "score"], [0, F.col(real)], [1, F.col(sampled)])
    return pairs.select(*kept, F.inline(sides))


def predictions_long(results: DataFrame) -> DataFrame:
    """Result documents with score lists per side, unfolded to (name, position, label, score)."""
    sides = []
    for label, side in ((0, "real"), (1, "samples")):
        sides.append(
            results.select(
                "name", F.posexplode(f"predictions.{side}").alias("position", "score"),
            ).withColumn("label", F.lit(label))
        )
    return sides[0].unionByName(sides[1])


def score_curve(
    scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """Per distinct score, from high to low: ``tp`` and ``fp`` when it is the threshold."""
    counts = {"pos": F.count_if(F.col(label) == 1), "neg": F.count_if(F.col(label) == 0)}
    curve = running_totals(scores, score, counts, by)
    return curve.withColumnsRenamed({"run_pos": "tp", "run_neg": "fp"})


def roc_points(
    scores: DataFrame,
    by: Sequence[str] = (),
    score: str = "score",
    label: str = "label",
    corners_only: bool = True,
) -> DataFrame:
    """(threshold, fpr, tpr), starting at (0, 0) with an infinite threshold.

    ``corners_only`` leaves out points between two equal steps, which change nothing in the drawing
    or the area. The first and the last score always stay.
    """
    curve = score_curve(scores, by, score, label)
    if corners_only:
        same_step = (F.col("pos") == F.col("next_pos")) & (F.col("neg") == F.col("next_neg"))
        first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
        curve = curve.where(first | ~F.coalesce(same_step, F.lit(False)))
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    origin = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr")
    )
    here = F.struct(
        F.col(score).alias("threshold"),
        ratio(F.col("fp"), F.col("all_neg")).alias("fpr"),
        ratio(F.col("tp"), F.col("all_pos")).alias("tpr"),
    )
    return curve.select(
        *by, F.inline(F.when(first, F.array(origin, here)).otherwise(F.array(here)))
    )


def pr_points(
    scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """(threshold, precision, recall), with the closing point (1, 0) at an infinite threshold."""
    curve = score_curve(scores, by, score, label)
    first = (F.col("tp") == F.col("pos")) & (F.col("fp") == F.col("neg"))
    end = F.struct(
        F.lit(float("inf")).alias("threshold"), F.lit(1.0).alias("precision"),
        F.lit(0.0).alias("recall"),
    )
    here = F.struct(
        F.col(score).alias("threshold"),
        ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"),
        ratio(F.col("tp"), F.col("all_pos")).alias("recall"),
    )
    return curve.select(
        *by, F.inline(F.when(first, F.array(end, here)).otherwise(F.array(here)))
    )


def areas(
    scores: DataFrame, by: Sequence[str] = (), score: str = "score", label: str = "label"
) -> DataFrame:
    """One row (per group): sizes, ``roc_auc``, ``pr_auc`` by trapezoids, ``loss`` = 1 - pr_auc.

    The ROC area is summed in whole numbers (twice the area in units of one pair), hence exact with
    ties at any size. The point before a score is known from the score's own counts.
    """
    curve = score_curve(scores, by, score, label)
    tp, fp, pos, neg = (F.col(c) for c in ("tp", "fp", "pos", "neg"))
    twice_area = neg.cast("decimal(19,0)") * (2 * tp - pos).cast("decimal(19,0)")
    here = ratio(tp, tp + fp)
    before = F.when(tp + fp == pos + neg, 1.0).otherwise(
        ratio(tp - pos, tp + fp - pos - neg)
    )
    sums = curve.groupBy(*by).agg(
        F.max("all_pos").alias("positives"), F.max("all_neg").alias("negatives"),
        F.sum(twice_area).cast("double").alias("_roc"),
        F.sum(pos * (here + before)).alias("_pr"),
    )
    p, n = F.col("positives"), F.col("negatives")
    return sums.select(
        *by, "positives", "negatives",
        F.try_divide(F.col("_roc"), 2.0 * p * n).alias("roc_auc"),
        F.try_divide(F.col("_pr"), 2.0 * p).alias("pr_auc"),
    ).withColumn("loss", 1 - F.col("pr_auc"))


def histogram(
    rows: DataFrame, value: str, bins: int, log: bool = False
) -> DataFrame:
    """Equal-width histogram over the value range: (bin, low, high, count), empty bins included.

    The last bin holds the maximum. With ``log`` the widths are equal in log10 and only positive
    values count.
    """
    number = F.col(value).cast("double")
    if log:
        values = rows.where(number > 0).select(F.log10(number).alias("x"))
    else:
        values = rows.where(number.isNotNull() & ~F.isnan(number)).select(number.alias("x"))
    flat = F.min("x") == F.max("x")
    span = values.agg(
        F.struct(
            F.when(flat, F.min("x") - 0.5).otherwise(F.min("x")).alias("low"),
            F.when(flat, F.max("x") + 0.5).otherwise(F.max("x")).alias("high"),
            F.lit(bins).alias("bins"),
        ).alias("range")
    )
    # Three numbers, read once; as a subquery they would stand in every expression below.
    bounds = landed(span.select("range.*"), "histogram-range")
    found = bounds.first()
    low, high, n = (F.lit(found[name]) for name in ("low", "high", "bins"))
    x = F.col("x")

    def edge(place: Column, low: Column, high: Column, n: Column) -> Column:
        return low + place * ((high - low) / n)

    guess = F.least(F.floor((x - low) / (high - low) * n), n - 1)
    place = (
        F.when(x < edge(guess, low, high, n), guess - 1)
        .when((x >= edge(guess + 1, low, high, n)) & (guess < n - 1), guess + 1)
        .otherwise(guess)
    )
    counts = values.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = bounds.where(F.col("low").isNotNull()).select(
        "*", F.explode(F.sequence(F.lit(0), F.col("bins") - 1)).alias("bin")
    )
    at = [edge(F.col("bin") + i, F.col("low"), F.col("high"), F.col("bins")) for i in (0, 1)]
    if log:
        at = [F.pow(F.lit(10.0), a) for a in at]
    return grid.join(counts, "bin", "left").select(
        "bin", at[0].alias("low"), at[1].alias("high"),
        F.coalesce("count", F.lit(0)).alias("count"),
    )


def automatic_bins(rows: DataFrame, value: str) -> DataFrame:
    """One row with the number of bins: the narrower of the Sturges and Freedman-Diaconis widths."""
    stats = exact_quantiles(rows, value, {"q25": 0.25, "q75": 0.75})
    n, reach = F.col("n").cast("double"), F.col("high") - F.col("low")
    sturges = reach / (F.log2(n) + 1)
    freedman = 2 * (F.col("q75") - F.col("q25")) / F.cbrt(n)
    width = F.when(freedman > 0, F.least(freedman, sturges)).otherwise(sturges)
    return stats.select(
        "n", "low", "high", "q25", "q75",
        F.when(width > 0, F.ceil(reach / width)).otherwise(1).cast("int").alias("bins"),
    )


def automatic_histogram(rows: DataFrame, value: str) -> DataFrame:
    """The histogram with that number of bins (one number, read first)."""
    bins = automatic_bins(rows, value).first()["bins"]
    return histogram(rows, value, bins or 1)
