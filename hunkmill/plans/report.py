"""The tables and the few numbers of the written report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from hunkmill.functions import fixed_values as fv
from hunkmill.operators import evaluation, rollups
from hunkmill.sources import writers

# Repositories that the text of a report names.
NAMED = 50


@dataclass(frozen=True)
class Report:
    pooled_trend: DataFrame
    repo_trends: DataFrame
    robustness: DataFrame
    yearly: DataFrame
    periods: DataFrame
    exclusions: DataFrame
    repos: DataFrame
    overall: DataFrame

    def write(self, folder: str) -> None:
        writers.csv(self.pooled_trend, f"{folder}/pooled_monthly_summary_medium")
        writers.csv(self.repo_trends, f"{folder}/repo_monthly_summary_medium")
        writers.csv(self.robustness, f"{folder}/threshold_robustness")
        writers.csv(self.yearly, f"{folder}/pre_post_yearly_summary")
        writers.csv(self.periods, f"{folder}/pre_post_period_summary")
        writers.csv(self.exclusions, f"{folder}/exclusions_and_thresholds")
        writers.csv(self.repos, f"{folder}/repo_sample_sizes")

    def numbers(self) -> dict[str, object]:
        """Fewer than twenty values, for the text of the report."""
        row = self.overall.first().asDict()
        ends = rollups.trend_endpoints(self.pooled_trend).first()
        row.update(ends.asDict())
        for period in self.periods.select("period", "weighted_commit_ai_fraction").collect():
            row[period["period"]] = period["weighted_commit_ai_fraction"]
        # A report names few repositories and counts all.
        names = self.repos.select("repo").distinct()
        row["repositories"] = [r.repo for r in names.orderBy("repo").limit(NAMED).collect()]
        row["repository_count"] = names.count()
        return row

    def text(self) -> str:
        """A short summary in Markdown."""
        n = self.numbers()
        shares = [n.get(fv.PRE_PERIOD), n.get(fv.POST_PERIOD)]
        lines = [
            "# Results", "", "## Detector",
            *[f"- {name.replace('_', ' ').capitalize()}: {n[name]:.3f}"
              for name in ("balanced_accuracy", "roc_auc", "precision", "recall")],
            f"- Threshold: {n['threshold']:.2f}", "", "## Trend",
            f"- Earliest pooled monthly fraction: {n['first_fraction'] or 0:.3f}",
            f"- Latest pooled monthly fraction: {n['last_fraction'] or 0:.3f}",
            f"- Repositories: {', '.join(n['repositories']) or 'n/a'}"
            + (f" and {n['repository_count'] - NAMED} more" if n["repository_count"] > NAMED else ""),
        ]
        if all(share is not None for share in shares):
            lines.append(f"- 2021-2022: {shares[0]:.3f}, 2023-2025: {shares[1]:.3f}")
        return "\n".join(lines) + "\n"


def build(
    monthly: DataFrame,
    pooled: DataFrame,
    config: DataFrame,
    repos: DataFrame,
    overall: DataFrame,
) -> Report:
    yearly = rollups.yearly_weighted(pooled)
    return Report(
        rollups.medium_trend(pooled), rollups.medium_trend(monthly),
        rollups.threshold_robustness(monthly), yearly, rollups.period_weighted(yearly),
        evaluation.exclusion_table(config), repos, overall,
    )
