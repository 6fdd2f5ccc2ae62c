"""Scores and counts rolled up to commit, month, year and period."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.functions import fixed_values as fv
from hunkmill.functions.shape import row_array
from hunkmill.functions.scoring import (
    ai_flag, bands, calendar_month, length_bucket, not_nan, period, plain_number, ratio,
    utc_moment, year_scaled,
)

STRATA = ["label", "language", "file_category", "length_bucket"]
BANDS = ["low", "medium", "high"]


def strata_counts(hunks: DataFrame) -> DataFrame:
    return hunks.dropna(subset=STRATA).groupBy(*STRATA).agg(
        F.count(F.lit(1)).alias("count")
    ).orderBy(*STRATA)


def label_counts(full: DataFrame, sampled: DataFrame) -> DataFrame:
    """One row: sizes, rows per label before and after sampling, languages, file categories."""

    def labels(rows: DataFrame, name: str) -> DataFrame:
        return rows.agg(
            F.count(F.lit(1)).alias(f"{name}_rows"),
            F.count_if(F.col("label") == 0).alias(f"{name}_human"),
            F.count_if(F.col("label") == 1).alias(f"{name}_machine"),
            F.array_sort(F.collect_set("language")).alias(f"{name}_languages"),
            F.array_sort(F.collect_set("file_category")).alias(f"{name}_file_categories"),
        )

    small = labels(sampled, "sampled").first()
    kept = {c: F.lit(small[c]) for c in ("sampled_rows", "sampled_human", "sampled_machine")}
    return labels(full, "full").withColumnsRenamed(
        {"full_languages": "languages", "full_file_categories": "file_categories"}
    ).withColumns(kept)


def passes_main_filter(
    languages: Sequence[str],
    categories: Sequence[str] = fv.MAIN_FILE_CATEGORIES,
    excluded_buckets: Sequence[str] = fv.EXCLUDED_LENGTH_BUCKETS,
) -> Column:
    return (
        F.col("language").isin(list(languages))
        & F.col("file_category").isin(list(categories))
        & ~F.col("length_bucket").isin(list(excluded_buckets))
    )


def main_hunks(hunks: DataFrame, languages: Sequence[str] = fv.TARGET_LANGUAGES) -> DataFrame:
    """Hunks with their length bucket, restricted to the strata the trends use."""
    return hunks.withColumn("length_bucket", length_bucket(F.col("line_count"))).where(
        passes_main_filter(languages)
    )


def commit_scores(
    hunks: DataFrame, threshold: float, keys: Sequence[str] = ("repo", "commit_hash")
) -> DataFrame:
    """Per commit: hunks, lines, maximum and mean score, and per band what lies at or above it.

    One aggregation for all bands; partial sums keep a commit with very many hunks cheap.
    """
    score, lines = not_nan(F.col("prob_ai")), F.col("line_count")
    columns = [
        F.count(F.lit(1)).alias("allowed_hunks"),
        F.sum(lines).alias("allowed_hunk_lines"),
        F.max(score).alias("max_hunk_score"),
        F.avg(score).alias("mean_hunk_score"),
    ]
    for band, cut in bands(threshold).items():
        columns.append(F.count_if(score >= cut).alias(f"ai_hunk_count_{band}"))
        columns.append(
            F.sum(F.when(score >= cut, lines).otherwise(0)).alias(f"ai_hunk_lines_{band}")
        )
    return hunks.groupBy(*keys).agg(*columns)


def commit_analysis(
    commits: DataFrame,
    hunks: DataFrame,
    threshold: float,
    keys: Sequence[str] = ("repo", "commit_hash"),
) -> DataFrame:
    """All commits with their scores; commits without scored hunks count as zero."""
    joined = commits.join(commit_scores(hunks, threshold, keys), list(keys), "left")
    counts = ["allowed_hunks", "allowed_hunk_lines", "max_hunk_score", "mean_hunk_score"]
    counts += [f"ai_hunk_{kind}_{band}" for band in BANDS for kind in ("count", "lines")]
    filled = joined.fillna(0, subset=counts)
    for band in BANDS:
        filled = filled.withColumns({
            f"has_ai_like_commit_{band}": F.col(f"ai_hunk_count_{band}") > 0,
            f"ai_line_fraction_{band}": ratio(
                F.col(f"ai_hunk_lines_{band}"), F.col("allowed_hunk_lines")
            ),
        })
    return filled


def _month_sums(analysis: DataFrame) -> DataFrame:
    sums = [
        F.count(F.lit(1)).alias("commits"),
        F.count_if(F.col("allowed_hunks") > 0).alias("commits_with_allowed_hunks"),
        F.sum("max_hunk_score").alias("sum_max"),
    ]
    for band in BANDS:
        sums.append(F.count_if(F.col(f"has_ai_like_commit_{band}")).alias(f"ai_{band}"))
        sums.append(F.sum(f"ai_line_fraction_{band}").alias(f"sum_fraction_{band}"))
    return analysis.where(F.col("calendar_month").isNotNull()).groupBy(
        "repo", "calendar_month"
    ).agg(*sums)


def _per_band(sums: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Bands from columns to rows, on the already small monthly table."""
    per_band = row_array(
        ["threshold_label", "ai_like_commits", "mean_ai_line_fraction"],
        *[[b, F.col(f"ai_{b}"), F.col(f"sum_fraction_{b}") / F.col("commits")] for b in BANDS],
    )
    return sums.select(
        *kept, "commits", (F.col("sum_max") / F.col("commits")).alias("mean_max_hunk_score"),
        F.inline(per_band),
    ).withColumn("commit_ai_fraction", F.col("ai_like_commits") / F.col("commits"))


def monthly_summary(analysis: DataFrame) -> DataFrame:
    """Per repository, month and band."""
    return _per_band(
        _month_sums(analysis), ["repo", "calendar_month", "commits_with_allowed_hunks"]
    )


def pooled_monthly(analysis: DataFrame) -> DataFrame:
    """Per month and band over all repositories."""
    sums = _month_sums(analysis)
    added = [c for c in sums.columns if c not in ("repo", "calendar_month")]
    pooled = sums.groupBy("calendar_month").agg(*[F.sum(c).alias(c) for c in added])
    return _per_band(pooled, ["calendar_month"])


def monthly_and_pooled(analysis: DataFrame) -> DataFrame:
    """Both in one pass; pooled rows have a null ``repo``.

    The commits are aggregated once, by repository and month; only that small table is expanded.
    """
    sums = _month_sums(analysis).dropna(subset=["repo"])
    added = [c for c in sums.columns if c not in ("repo", "calendar_month")]
    both = sums.groupingSets(
        [["repo", "calendar_month"], ["calendar_month"]], "repo", "calendar_month"
    ).agg(*[F.sum(c).alias(c) for c in added])
    return _per_band(both, ["repo", "calendar_month", "commits_with_allowed_hunks"])


def medium_trend(monthly: DataFrame, first_month: str = fv.FIRST_TREND_MONTH) -> DataFrame:
    return monthly.where(
        (F.col("threshold_label") == "medium") & (F.col("calendar_month") >= first_month)
    )


def threshold_robustness(monthly: DataFrame) -> DataFrame:
    """Mean over months by repository and band; the plain mean, and one weighted by commits."""
    return monthly.groupBy("repo", "threshold_label").agg(
        F.avg("commit_ai_fraction").alias("mean_commit_ai_fraction"),
        ratio(F.sum("ai_like_commits"), F.sum("commits")).alias("weighted_commit_ai_fraction"),
    )


def yearly_weighted(
    pooled: DataFrame,
    first_year: int = fv.FIRST_TREND_YEAR,
    last_pre_year: int = fv.LAST_PRE_YEAR,
) -> DataFrame:
    """Medium band per year, weighted by commits."""
    year = F.substring("calendar_month", 1, 4).cast("int")
    yearly = (
        pooled.where(F.col("threshold_label") == "medium")
        .withColumn("year", year)
        .where(F.col("year") >= first_year)
        .groupBy("year")
        .agg(
            F.sum("commits").alias("commits"),
            F.sum("ai_like_commits").alias("ai_like_commits"),
            F.sum(F.col("mean_ai_line_fraction") * F.col("commits")).alias("_lines"),
        )
    )
    return yearly.select(
        "year", "commits", "ai_like_commits",
        (F.col("ai_like_commits") / F.col("commits")).alias("weighted_commit_ai_fraction"),
        (F.col("_lines") / F.col("commits")).alias("weighted_mean_ai_line_fraction"),
        period(F.col("year"), last_pre_year).alias("period"),
    )


def period_weighted(yearly: DataFrame) -> DataFrame:
    return (
        yearly.groupBy("period")
        .agg(
            F.array_join(F.array_sort(F.collect_list(F.col("year").cast("string"))), ",").alias(
                "years"
            ),
            F.sum("commits").alias("commits"),
            F.sum("ai_like_commits").alias("ai_like_commits"),
            F.sum(F.col("weighted_mean_ai_line_fraction") * F.col("commits")).alias("_lines"),
        )
        .select(
            "period", "years", "commits", "ai_like_commits",
            (F.col("ai_like_commits") / F.col("commits")).alias("weighted_commit_ai_fraction"),
            (F.col("_lines") / F.col("commits")).alias("weighted_mean_ai_line_fraction"),
        )
    )


def trend_endpoints(trend: DataFrame) -> DataFrame:
    """First and last month of a trend and their fractions, one row."""
    month, share = F.col("calendar_month"), F.col("commit_ai_fraction")
    return trend.agg(
        F.min(month).alias("first_month"), F.min_by(share, month).alias("first_fraction"),
        F.max(month).alias("last_month"), F.max_by(share, month).alias("last_fraction"),
    )


def score_messages_by_year(messages: DataFrame) -> DataFrame:
    """Adds the year-scaled probability and both flags (``year``, ``raw_ai_probability``).

    The scaling alone keeps every year up to 2021 below the flag; the raw flag stays beside it.
    """
    raw = F.col("raw_ai_probability")
    return messages.withColumn("ai_probability", year_scaled(raw, F.col("year"))).withColumns(
        {"is_ai": ai_flag(F.col("ai_probability")), "is_ai_raw": ai_flag(raw)}
    )


def usage_by_year(scored: DataFrame) -> DataFrame:
    counted = scored.groupBy("year").agg(
        F.count("is_ai").alias("total_commits"),
        F.sum("is_ai").alias("ai_commits"),
        F.sum("is_ai_raw").alias("ai_commits_raw"),
        F.avg("ai_probability").alias("avg_ai_probability"),
    )
    return counted.withColumns({
        "percentage_ai": F.col("ai_commits") / F.col("total_commits") * 100,
        "percentage_ai_raw": F.col("ai_commits_raw") / F.col("total_commits") * 100,
    })


def clean_commit_rows(
    rows: DataFrame, first_year: int | None = None, last_year: int | None = None
) -> DataFrame:
    """Text columns of a commit export to numbers and moments; undated rows go, and years outside the
    bounds if any are given."""
    dated = (
        rows.withColumns({
            "author_date": utc_moment(F.col("author_date").cast("string")),
            **{c: plain_number(F.col(c)) for c in ("insertions", "deletions", "files_count")},
        })
        .where(F.col("author_date").isNotNull())
    )
    if first_year is not None:
        dated = dated.where(F.year("author_date") >= first_year)
    return dated if last_year is None else dated.where(F.year("author_date") <= last_year)


def commit_churn(rows: DataFrame, order: str | None = None) -> DataFrame:
    """Per hash: date, summed insertions and deletions, most files, churn.

    The date is that of the first row by ``order`` (a position in the file), else the earliest.
    """
    moment = F.min("author_date") if order is None else F.min_by("author_date", order)
    return (
        rows.where(F.col("hash").isNotNull())
        .groupBy("hash")
        .agg(
            moment.alias("author_date"), F.sum("insertions").alias("insertions"),
            F.sum("deletions").alias("deletions"), F.max("files_count").alias("files_count"),
        )
        .withColumn("churn", F.col("insertions") + F.col("deletions"))
    )


def monthly_churn(commits: DataFrame) -> DataFrame:
    return commits.groupBy(calendar_month(F.col("author_date")).alias("month_year")).agg(
        F.count("author_date").alias("commit_count"), F.sum("churn").alias("churn")
    )


def union_exports(exports: Sequence[tuple[DataFrame, dict[str, str]]]) -> DataFrame:
    """Commit exports with differing column names under one set of names; duplicates stay."""
    columns = ["hash", "author_date", "insertions", "deletions", "files_count", "message"]
    parts = [
        frame.withColumnsRenamed(names).select(
            *[F.col(c) if c in {*frame.withColumnsRenamed(names).columns}
              else F.lit(None).cast("string").alias(c) for c in columns]
        )
        for frame, names in exports
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
