"""Mined commits to monthly, yearly and period trends, all repositories in one plan."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hunkmill.functions import fixed_values as fv
from hunkmill.operators import hunks, joins, rollups, sampling
from hunkmill.sources import writers


@dataclass(frozen=True)
class Mined:
    commits: DataFrame
    hunks: DataFrame
    since: str | None = None
    until: str | None = None

    def write(self, folder: str) -> None:
        writers.parquet_by_repo(self.commits, f"{folder}/commit_metrics")
        writers.parquet_by_repo(self.hunks, f"{folder}/hunk_metrics")
        writers.run_summary(repo_summaries(self.commits, self.hunks, self.since, self.until), f"{folder}/summary")


def mine(documents: DataFrame, since: str | None = None, until: str | None = None) -> Mined:
    """Commit and hunk tables out of nested commits (with ``repo`` and ``parents``)."""
    commits = hunks.minable_commits(documents, since, until)
    mined = hunks.commit_hunks(commits)
    return Mined(hunks.commit_metrics(commits, mined), mined, since, until)


def repo_summaries(
    commits: DataFrame, hunk_rows: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    """Commits and hunks per repository, with the window that was mined."""
    counted = hunk_rows.groupBy("repo").agg(F.count(F.lit(1)).alias("hunk_rows"))
    return (
        commits.groupBy("repo").agg(F.count(F.lit(1)).alias("commit_rows"))
        .join(counted, "repo", "left").fillna(0, subset=["hunk_rows"])
        .withColumns({"since": F.lit(since).cast("string"), "to": F.lit(until).cast("string")})
    )


@dataclass(frozen=True)
class Trends:
    scored: DataFrame
    analysis: DataFrame
    monthly: DataFrame
    pooled: DataFrame

    def write(self, folder: str) -> None:
        writers.parquet(self.scored, f"{folder}/hunk_predictions", ["repo"])
        writers.parquet(self.analysis, f"{folder}/commit_analysis", ["repo"])
        writers.csv(self.monthly, f"{folder}/monthly_summary")
        writers.csv(self.pooled, f"{folder}/pooled_monthly_summary")


STRATUM_FILTERS = ("main", "allowed", "both")


def usable_hunks(
    hunk_rows: DataFrame,
    languages: Sequence[str],
    allowed: DataFrame | None = None,
    stratum_filter: str = "main",
    categories: Sequence[str] = fv.MAIN_FILE_CATEGORIES,
    excluded_buckets: Sequence[str] = fv.EXCLUDED_LENGTH_BUCKETS,
) -> DataFrame:
    """Hunks of the main strata, of the calibrated ones, or of both."""
    if stratum_filter not in STRATUM_FILTERS:
        raise ValueError(f"stratum_filter must be one of {STRATUM_FILTERS}")
    rows = hunk_rows.withColumn(
        "length_bucket", rollups.length_bucket(F.col("line_count"))
    )
    if stratum_filter != "allowed":
        rows = rows.where(rollups.passes_main_filter(languages, categories, excluded_buckets))
    if stratum_filter != "main":
        rows = joins.allowed_hunks(rows, allowed)
    return rows


def analyse(
    commits: DataFrame,
    hunk_rows: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    threshold: float,
    languages: Sequence[str] = fv.TARGET_LANGUAGES,
    per_month: int | None = None,
    keys: Sequence[str] = ("repo", "commit_hash"),
    stratum_filter: str = "main",
    allowed: DataFrame | None = None,
    seed: int = 42,
    categories: Sequence[str] = fv.MAIN_FILE_CATEGORIES,
    excluded_buckets: Sequence[str] = fv.EXCLUDED_LENGTH_BUCKETS,
) -> Trends:
    """Keep the commits' hunks, score those and roll up; with ``per_month`` a sample of the commits.

    The sample and the stratum filter come before ``score``, the costly step.
    """
    if per_month is not None:
        commits = sampling.sample_commits_per_month(commits, per_month, seed)
        hunk_rows = joins.hunks_of_commits(hunk_rows, commits, keys)
    usable = usable_hunks(hunk_rows, languages, allowed, stratum_filter, categories, excluded_buckets)
    scored = score(usable)
    analysis = rollups.commit_analysis(commits, scored, threshold, keys)
    return Trends(
        scored, analysis, rollups.monthly_summary(analysis), rollups.pooled_monthly(analysis)
    )


def configured(config: DataFrame) -> dict[str, object]:
    """The arguments of ``analyse`` that a frozen configuration fixes; a row of short lists."""
    row = config.select(
        "threshold", "main_languages", "main_file_categories", "excluded_length_buckets"
    ).first()
    return {
        "threshold": row["threshold"], "languages": row["main_languages"],
        "categories": row["main_file_categories"],
        "excluded_buckets": row["excluded_length_buckets"],
    }
