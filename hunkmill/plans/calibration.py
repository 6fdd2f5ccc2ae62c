"""From pull requests to a calibrated detector and its frozen configuration."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml import Transformer
from pyspark.sql import DataFrame, functions as F

from hunkmill.functions import fixed_values as fv
from hunkmill.operators import curves, evaluation, hunks, joins, models, rollups, sampling
from hunkmill.operators.linear import LinearModel
from hunkmill.session import landed
from hunkmill.sources import writers

@dataclass(frozen=True)
class Dataset:
    full: DataFrame
    sampled: DataFrame

    def write(self, folder: str) -> None:
        writers.parquet(self.full, f"{folder}/hunks_full")
        writers.parquet(self.sampled, f"{folder}/hunks_sampled")
        writers.csv(rollups.strata_counts(self.full), f"{folder}/full_counts")
        writers.csv(rollups.strata_counts(self.sampled), f"{folder}/sampled_counts")
        writers.run_summary(rollups.label_counts(self.full, self.sampled), f"{folder}/summary")


def build_dataset(
    details: DataFrame,
    ai_pulls: DataFrame,
    human_pulls: DataFrame,
    repositories: DataFrame,
    patches: DataFrame,
    languages: Sequence[str] = fv.TARGET_LANGUAGES,
    per_language: int | None = 40,
    per_stratum: int = 400,
    seed: int = 42,
) -> Dataset:
    """Labelled hunks of both sides, all of them and a sample of at most ``per_stratum`` of each
    stratum; ``per_language`` bounds the human pull requests that are read (None: all of them).

    The full table is landed: it is costly to cut out of the patches and is read several times.
    """
    merged = joins.join_repository(
        joins.join_commit_pr(details, ai_pulls), repositories, ["sha", "filename"]
    )
    both = hunks.union_ai_human(
        hunks.calibration_hunks_ai(merged, languages),
        hunks.calibration_hunks_human(
            human_pulls, repositories, patches, languages, per_language, seed
        ),
    )
    full = landed(both, "calibration-hunks")
    key = ["label", "pr_id", "sha", "filename", "hunk_index", "snippet"]
    return Dataset(full, sampling.sample_by_strata(full, key, per_stratum, seed))


@dataclass(frozen=True)
class Calibration:
    model: Transformer | LinearModel
    predictions: DataFrame
    sweep: DataFrame
    threshold: float
    overall: DataFrame
    strata: DataFrame
    allowed: DataFrame
    config: DataFrame

    def write(self, folder: str) -> None:
        models.save(models.Detector(self.model, self.threshold, self.allowed), f"{folder}/detector")
        writers.parquet(self.predictions, f"{folder}/predictions")
        writers.csv(self.sweep, f"{folder}/threshold_metrics")
        for c in evaluation.STRATUM:
            others = [o for o in evaluation.STRATUM if o != c]
            only = self.strata.where(F.col(c).isNotNull())
            for o in others:
                only = only.where(F.col(o).isNull())
            writers.csv(only.drop(*others), f"{folder}/metrics_by_{c}")
        writers.csv(
            self.strata.dropna(subset=evaluation.STRATUM), f"{folder}/metrics_by_combination"
        )
        writers.run_summary(self.config, f"{folder}/frozen_config")
        writers.run_summary(self.overall, f"{folder}/overall_metrics")


def calibrate(
    hunks_: DataFrame,
    key: Sequence[str],
    fit: Callable[[DataFrame], Transformer | LinearModel] = models.fit_embedding_detector,
    prepare: Callable[[DataFrame], DataFrame] = models.embedding_features,
    max_rows: int | None = 6000,
    test_share: float = 0.2,
    seed: int = 42,
) -> Calibration:
    """Cap, split by label, fit, score the test part, choose the threshold, judge the strata.

    The fit sees a bounded sample of the labelled rows: at most ``max_rows``, evenly from all strata
    (None: all rows).
    Only the threshold (one number) comes to the driver, as the later steps are built with it.
    """
    rows = hunks_
    if max_rows is not None:
        rows = sampling.capped_stratified(rows, key, max_rows, seed=seed)
    split = landed(sampling.split_exact(rows, key, test_share, seed), "calibration-split")
    train, test = split.where("is_test = 0"), split.where("is_test = 1")
    model = fit(train)
    scored = models.score(model, prepare(test)).drop("features")
    predictions = landed(scored, "calibration-predictions")
    sweep = evaluation.threshold_sweep(predictions)
    threshold = evaluation.best_threshold(sweep).first()["threshold"]
    strata = evaluation.stratum_metrics(predictions, threshold)
    allowed = evaluation.frozen_strata(strata.dropna(subset=evaluation.STRATUM), predictions)
    area = curves.areas(predictions, score="prob_ai").select("roc_auc").scalar()
    sizes = split.agg(F.count_if(F.col("is_test") == 0)).scalar()
    overall = evaluation.confusion_metrics(predictions, threshold).select(
        "*", area.alias("roc_auc"),
        (F.col("tp") + F.col("tn") + F.col("fp") + F.col("fn")).alias("test_rows"),
        sizes.alias("train_rows"),
    )
    config = evaluation.frozen_config(allowed, predictions, threshold)
    return Calibration(model, predictions, sweep, threshold, overall, strata, allowed, config)
