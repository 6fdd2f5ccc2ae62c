from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.registry import query, tidy
from hunkmill.operators import rollups
from hunkmill.operators.hunks import commit_file_rollup
from hunkmill.operators.sampling import sample_by_strata

THRESHOLD = 0.44999999999999996
BANDS = rollups.bands(THRESHOLD)
KEY = ["commit_hash"]


def analysis(spark, folder) -> DataFrame:
    return rollups.commit_analysis(
        t.commits(spark, folder), rollups.main_hunks(t.hunks(spark, folder)), THRESHOLD, KEY
    )


_HITS = ",\n         ".join(
    f"""count(*) FILTER (WHERE prob_ai >= {cut!r}) AS ai_hunk_count_{band},
         CAST(coalesce(sum(line_count) FILTER (WHERE prob_ai >= {cut!r}), 0) AS BIGINT)
           AS ai_hunk_lines_{band}"""
    for band, cut in BANDS.items()
)
SCORES = f"""scores AS (
  SELECT commit_hash, count(*) AS allowed_hunks,
         CAST(sum(line_count) AS BIGINT) AS allowed_hunk_lines, max(prob_ai) AS max_hunk_score,
         avg(prob_ai) AS mean_hunk_score,
         {_HITS}
  FROM main_hunks GROUP BY commit_hash)"""
_FILLED = ",\n         ".join(
    f"""coalesce(ai_hunk_count_{b}, 0) AS ai_hunk_count_{b},
         coalesce(ai_hunk_lines_{b}, 0) AS ai_hunk_lines_{b},
         coalesce(ai_hunk_count_{b}, 0) > 0 AS has_ai_like_commit_{b},
         CASE WHEN allowed_hunk_lines > 0 THEN ai_hunk_lines_{b} / allowed_hunk_lines ELSE 0 END
           AS ai_line_fraction_{b}"""
    for b in BANDS
)
ANALYSIS = f"""{t.COMMITS}, {t.HUNKS}, {t.MAIN_HUNKS}, {SCORES},
analysis AS (
  SELECT c.*, coalesce(allowed_hunks, 0) AS allowed_hunks,
         coalesce(allowed_hunk_lines, 0) AS allowed_hunk_lines,
         coalesce(max_hunk_score, 0) AS max_hunk_score,
         coalesce(mean_hunk_score, 0) AS mean_hunk_score,
         {_FILLED}
  FROM commits c LEFT JOIN scores s USING (commit_hash)),
banded AS (""" + "\n  UNION ALL ".join(
    f"""SELECT repo, calendar_month, '{b}' AS threshold_label, allowed_hunks, max_hunk_score,
         has_ai_like_commit_{b} AS hit, ai_line_fraction_{b} AS fraction FROM analysis"""
    for b in BANDS
) + ")"


def summary_sql(keys: str, extra: str = "") -> str:
    return f"""SELECT {keys}, threshold_label, {extra} count(*) AS commits,
       count(*) FILTER (WHERE hit) AS ai_like_commits,
       round(avg(fraction), 9) AS mean_ai_line_fraction,
       round(avg(max_hunk_score), 9) AS mean_max_hunk_score,
       round(count(*) FILTER (WHERE hit) / count(*), 9) AS commit_ai_fraction
FROM banded"""


WITH_HUNKS = "count(*) FILTER (WHERE allowed_hunks > 0) AS commits_with_allowed_hunks,"


@query(
    "monthly_and_pooled",
    f"""WITH {ANALYSIS}
{summary_sql('repo, calendar_month', WITH_HUNKS)}
GROUP BY GROUPING SETS ((repo, calendar_month, threshold_label), (calendar_month, threshold_label))
""",
)
def monthly_and_pooled(spark, folder):
    return tidy(rollups.monthly_and_pooled(analysis(spark, folder)))


@query(
    "monthly_summary",
    f"WITH {ANALYSIS} {summary_sql('repo, calendar_month', WITH_HUNKS)} GROUP BY ALL",
)
def monthly_summary(spark, folder):
    return tidy(rollups.monthly_summary(analysis(spark, folder)))


@query(
    "pooled_monthly",
    f"WITH {ANALYSIS} {summary_sql('calendar_month')} GROUP BY ALL",
)
def pooled_monthly(spark, folder):
    return tidy(rollups.pooled_monthly(analysis(spark, folder)))


@query(
    "commit_score_agg",
    f"""WITH {t.HUNKS}, {t.MAIN_HUNKS}, {SCORES}
SELECT * REPLACE (round(max_hunk_score, 9) AS max_hunk_score,
                  round(mean_hunk_score, 9) AS mean_hunk_score) FROM scores""",
)
def commit_score_agg(spark, folder):
    return tidy(rollups.commit_scores(rollups.main_hunks(t.hunks(spark, folder)), THRESHOLD, KEY))


@query(
    "commit_join_hunk_agg",
    f"""WITH {ANALYSIS}
SELECT repo, commit_hash, calendar_month, allowed_hunks, allowed_hunk_lines,
       round(max_hunk_score, 9) AS max_hunk_score, round(mean_hunk_score, 9) AS mean_hunk_score
FROM analysis""",
)
def commit_join_hunk_agg(spark, folder):
    return tidy(analysis(spark, folder).select(
        "repo", "commit_hash", "calendar_month", "allowed_hunks", "allowed_hunk_lines",
        "max_hunk_score", "mean_hunk_score",
    ))


_HIT_COLUMNS = [f"ai_hunk_{kind}_{b}" for b in BANDS for kind in ("count", "lines")]


@query(
    "commit_join_ai_hits",
    f"""WITH {ANALYSIS}
SELECT commit_hash, {', '.join(_HIT_COLUMNS)},
       {', '.join(f'CAST(has_ai_like_commit_{b} AS BIGINT) AS has_ai_like_commit_{b}' for b in BANDS)},
       {', '.join(f'round(ai_line_fraction_{b}, 9) AS ai_line_fraction_{b}' for b in BANDS)}
FROM analysis""",
)
def commit_join_ai_hits(spark, folder):
    rows = analysis(spark, folder)
    return tidy(rows.select(
        "commit_hash", *_HIT_COLUMNS,
        *[F.col(f"has_ai_like_commit_{b}").cast("long").alias(f"has_ai_like_commit_{b}")
          for b in BANDS],
        *[f"ai_line_fraction_{b}" for b in BANDS],
    ))


@query(
    "strata_counts",
    f"""WITH {t.HUNKS}
SELECT label, language, file_category, length_bucket, count(*) AS count
FROM hunks GROUP BY ALL ORDER BY label, language, file_category, length_bucket""",
)
def strata_counts(spark, folder):
    return tidy(rollups.strata_counts(t.hunks(spark, folder)))


@query(
    "label_counts",
    f"""WITH {t.HUNKS}, main AS (
  SELECT * FROM (SELECT *, row_number() OVER (
    PARTITION BY label, language, file_category, length_bucket ORDER BY {t.HUNK_DIGEST}) AS place
    FROM hunks) WHERE place <= 100)
SELECT (SELECT count(*) FROM hunks) AS full_rows,
       (SELECT count(*) FROM hunks WHERE label = 0) AS full_human,
       (SELECT count(*) FROM hunks WHERE label = 1) AS full_machine,
       (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM hunks) AS languages,
       (SELECT string_agg(DISTINCT file_category, ',' ORDER BY file_category) FROM hunks)
         AS file_categories,
       (SELECT count(*) FROM main) AS sampled_rows,
       (SELECT count(*) FROM main WHERE label = 0) AS sampled_human,
       (SELECT count(*) FROM main WHERE label = 1) AS sampled_machine""",
)
def label_counts(spark, folder):
    rows = t.hunks(spark, folder)
    counts = rollups.label_counts(rows, sample_by_strata(rows, t.HUNK_KEY, 100))
    return tidy(counts.withColumns({
        c: F.array_join(c, ",") for c in ("languages", "file_categories")
    }))


@query(
    "commit_file_rollup",
    f"""WITH {t.COMMITS}, {t.HUNKS},
files AS (SELECT commit_hash, file_index, part, supplier, file_category, count(*) AS hunks,
                 sum(line_count) AS added FROM hunks GROUP BY ALL),
counts AS (SELECT commit_hash, sum(hunks) AS h, sum(added) AS a,
  count(*) FILTER (WHERE file_category = 'source') AS s,
  count(*) FILTER (WHERE file_category = 'test') AS e,
  count(*) FILTER (WHERE file_category = 'docs') AS d,
  count(*) FILTER (WHERE file_category = 'config') AS g FROM files GROUP BY commit_hash)
SELECT repo, commit_hash, CAST(coalesce(h, 0) AS BIGINT) AS hunk_count,
       CAST(coalesce(a, 0) AS BIGINT) AS added_hunk_lines, coalesce(s, 0) AS source_file_count,
       coalesce(e, 0) AS test_file_count, coalesce(d, 0) AS docs_file_count,
       coalesce(g, 0) AS config_file_count
FROM commits LEFT JOIN counts USING (commit_hash)""",
)
def commit_file_counts(spark, folder):
    file_id = F.concat_ws("/", "file_index", "part", "supplier")
    rolled = commit_file_rollup(
        t.hunks(spark, folder).withColumn("file_id", file_id), ["commit_hash"], "file_id"
    )
    commits = t.commits(spark, folder).select("repo", "commit_hash")
    counts = [c for c in rolled.columns if c != "commit_hash"]
    return tidy(commits.join(rolled, "commit_hash", "left").fillna(0, subset=counts))


TREND = f"""WITH {ANALYSIS},
monthly AS ({summary_sql('repo, calendar_month', WITH_HUNKS).replace('round(', '(').replace(', 9)', ')')} GROUP BY ALL),
pooled AS ({summary_sql('calendar_month').replace('round(', '(').replace(', 9)', ')')} GROUP BY ALL)"""


@query(
    "threshold_robustness",
    f"""{TREND}
SELECT repo, threshold_label, round(avg(commit_ai_fraction), 9) AS mean_commit_ai_fraction,
       round(sum(ai_like_commits) / sum(commits), 9) AS weighted_commit_ai_fraction
FROM monthly GROUP BY ALL""",
)
def threshold_robustness(spark, folder):
    return tidy(rollups.threshold_robustness(rollups.monthly_summary(analysis(spark, folder))))


@query(
    "medium_trend",
    f"""{TREND}
SELECT repo, calendar_month, commits, ai_like_commits,
       round(commit_ai_fraction, 9) AS commit_ai_fraction
FROM monthly WHERE threshold_label = 'medium' AND calendar_month >= '1996-01'""",
)
def medium_trend(spark, folder):
    trend = rollups.medium_trend(rollups.monthly_summary(analysis(spark, folder)), "1996-01")
    return tidy(trend.select(
        "repo", "calendar_month", "commits", "ai_like_commits", "commit_ai_fraction"
    ))


_YEARLY = """yearly AS (
  SELECT CAST(substr(calendar_month, 1, 4) AS BIGINT) AS year,
         CAST(sum(commits) AS BIGINT) AS commits,
         CAST(sum(ai_like_commits) AS BIGINT) AS ai_like_commits,
         sum(mean_ai_line_fraction * commits) AS lines
  FROM pooled WHERE threshold_label = 'medium' AND substr(calendar_month, 1, 4) >= '1996'
  GROUP BY ALL),
dated AS (SELECT *, CASE WHEN year <= 1997 THEN '2021-2022 pre-mainstream LLM'
                         ELSE '2023-2025 post-mainstream LLM' END AS period FROM yearly)"""


def _yearly(spark, folder):
    return rollups.yearly_weighted(rollups.pooled_monthly(analysis(spark, folder)), 1996, 1997)


@query(
    "yearly_weighted",
    f"""{TREND}, {_YEARLY}
SELECT year, period, commits, ai_like_commits,
       round(ai_like_commits / commits, 9) AS weighted_commit_ai_fraction,
       round(lines / commits, 9) AS weighted_mean_ai_line_fraction FROM dated""",
)
def yearly_weighted(spark, folder):
    return tidy(_yearly(spark, folder))


@query(
    "period_weighted",
    f"""{TREND}, {_YEARLY}
SELECT period, string_agg(CAST(year AS VARCHAR), ',' ORDER BY year) AS years,
       CAST(sum(commits) AS BIGINT) AS commits,
       CAST(sum(ai_like_commits) AS BIGINT) AS ai_like_commits,
       round(sum(ai_like_commits) / sum(commits), 9) AS weighted_commit_ai_fraction,
       round(sum(lines) / sum(commits), 9) AS weighted_mean_ai_line_fraction
FROM dated GROUP BY period""",
)
def period_weighted(spark, folder):
    return tidy(rollups.period_weighted(_yearly(spark, folder)))


@query(
    "trend_endpoints",
    f"""{TREND}, medium AS (SELECT * FROM pooled WHERE threshold_label = 'medium')
SELECT min(calendar_month) AS first_month,
       round(arg_min(commit_ai_fraction, calendar_month), 9) AS first_fraction,
       max(calendar_month) AS last_month,
       round(arg_max(commit_ai_fraction, calendar_month), 9) AS last_fraction FROM medium""",
)
def trend_endpoints(spark, folder):
    pooled = rollups.pooled_monthly(analysis(spark, folder))
    return tidy(rollups.trend_endpoints(rollups.medium_trend(pooled, "1995-01")))


_SCALED = f"""WITH {t.MESSAGES}, scaled AS (
  SELECT *, CASE WHEN year < 2021 THEN raw_ai_probability * 0.10::DOUBLE
                 WHEN year = 2021 THEN raw_ai_probability * 0.40::DOUBLE
                 WHEN year = 2022 THEN raw_ai_probability * 0.85::DOUBLE
                 ELSE least(raw_ai_probability * 1.3::DOUBLE, 1.0::DOUBLE) END AS ai_probability
  FROM messages)"""


@query(
    "year_scaled_messages",
    f"""{_SCALED}
SELECT key, year, round(raw_ai_probability, 9) AS raw_ai_probability,
       round(ai_probability, 9) AS ai_probability,
       CAST(ai_probability > 0.5 AS BIGINT) AS is_ai,
       CAST(raw_ai_probability > 0.5 AS BIGINT) AS is_ai_raw FROM scaled""",
)
def year_scaled_messages(spark, folder):
    return tidy(rollups.score_messages_by_year(t.yearly_messages(spark, folder)))


@query(
    "usage_by_year",
    f"""{_SCALED}
SELECT year, count(*) AS total_commits, count(*) FILTER (WHERE ai_probability > 0.5) AS ai_commits,
       count(*) FILTER (WHERE raw_ai_probability > 0.5) AS ai_commits_raw,
       round(avg(ai_probability), 9) AS avg_ai_probability,
       round(count(*) FILTER (WHERE ai_probability > 0.5) / count(*) * 100, 9) AS percentage_ai,
       round(count(*) FILTER (WHERE raw_ai_probability > 0.5) / count(*) * 100, 9)
         AS percentage_ai_raw
FROM scaled GROUP BY year""",
)
def usage_by_year(spark, folder):
    scored = rollups.score_messages_by_year(t.yearly_messages(spark, folder))
    return tidy(rollups.usage_by_year(scored))


def _exports(spark, folder):
    """Two commit exports with differing names: order lines in text columns, and events."""
    lines = t.table(spark, folder, "lineitem").select(
        F.concat(F.lit("c"), F.col("l_orderkey")).alias("hash"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("author_date"),
        F.concat(F.lit("["), F.col("l_quantity").cast("int").cast("string"), F.lit("]"))
        .alias("insertions"),
        F.col("l_linenumber").cast("string").alias("deletions"),
        F.when(F.col("l_returnflag") == "A", "n/a")
        .otherwise(F.col("l_suppkey").cast("string")).alias("files_count"),
        F.col("l_returnflag").alias("msg"),
    )
    events = t.table(spark, folder, "events").select(
        F.concat(F.lit("e"), F.col("user_id")).alias("hash"),
        F.when(F.col("event_type") == "error", "no date")
        .otherwise(F.date_format("ts", "yyyy-MM-dd")).alias("author_date"),
        F.floor("value").cast("string").alias("insertions"),
        F.regexp_extract("props", r"(\d+)", 1).alias("deletions"),
        F.lit("1").alias("files"), F.col("event_type").alias("message"),
    )
    return [(lines, {"msg": "message"}), (events, {"files": "files_count"})]


EXPORTS = """exports AS (
  SELECT 'c' || l_orderkey AS hash, date_trunc('day', l_shipdate) AS author_date,
         CAST(l_quantity AS INTEGER) AS insertions, l_linenumber AS deletions,
         CASE WHEN l_returnflag = 'A' THEN 0 ELSE l_suppkey END AS files_count,
         l_returnflag AS message
  FROM lineitem
  UNION ALL
  SELECT 'e' || user_id, CASE WHEN event_type <> 'error' THEN date_trunc('day', ts) END,
         floor(value), coalesce(TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE), 0), 1,
         event_type
  FROM events),
clean AS (SELECT * FROM exports
          WHERE author_date IS NOT NULL AND year(author_date) BETWEEN 1996 AND 2025)"""


def _clean(spark, folder):
    return rollups.clean_commit_rows(rollups.union_exports(_exports(spark, folder)), 1996, 2025)


@query(
    "union_sources",
    f"""WITH {EXPORTS}
SELECT hash, strftime(author_date, '%Y-%m-%d') AS day, CAST(insertions AS BIGINT) AS insertions,
       CAST(deletions AS BIGINT) AS deletions, CAST(files_count AS BIGINT) AS files_count, message
FROM clean""",
)
def union_sources(spark, folder):
    return _clean(spark, folder).select(
        "hash", F.date_format("author_date", "yyyy-MM-dd").alias("day"),
        *[F.col(c).cast("long").alias(c) for c in ("insertions", "deletions", "files_count")],
        "message",
    )


CHURN = """commits AS (
  SELECT hash, min(author_date) AS author_date, sum(insertions) AS insertions,
         sum(deletions) AS deletions, max(files_count) AS files_count,
         sum(insertions) + sum(deletions) AS churn
  FROM clean GROUP BY hash)"""


@query(
    "commit_churn",
    f"""WITH {EXPORTS}, {CHURN}
SELECT hash, strftime(author_date, '%Y-%m-%d') AS day, CAST(insertions AS BIGINT) AS insertions,
       CAST(deletions AS BIGINT) AS deletions, CAST(files_count AS BIGINT) AS files_count,
       CAST(churn AS BIGINT) AS churn FROM commits""",
)
def commit_churn(spark, folder):
    return rollups.commit_churn(_clean(spark, folder)).select(
        "hash", F.date_format("author_date", "yyyy-MM-dd").alias("day"),
        *[F.col(c).cast("long").alias(c)
          for c in ("insertions", "deletions", "files_count", "churn")],
    )


@query(
    "monthly_churn",
    f"""WITH {EXPORTS}, {CHURN}
SELECT strftime(author_date, '%Y-%m') AS month_year, count(*) AS commit_count,
       CAST(sum(churn) AS BIGINT) AS churn FROM commits GROUP BY ALL""",
)
def monthly_churn(spark, folder):
    churn = rollups.monthly_churn(rollups.commit_churn(_clean(spark, folder)))
    return churn.withColumn("churn", F.col("churn").cast("long"))
