"""The end-to-end jobs, from tables to the files they leave, read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from hunkmill import schemas
from hunkmill.catalog import tables as t
from hunkmill.catalog.corpus_queries import _BASELINE, _CONTRAST, _benchmark_model
from hunkmill.catalog.file_queries import _LINE
from hunkmill.catalog.hunk_queries import (
    _AI, _HUMAN_HUNKS, _MINED, _human_pulls, _merged_parts, _nested,
)
from hunkmill.catalog.metric_queries import _FROZEN, _frozen, areas_sql
from hunkmill.catalog.model_queries import _HUNK_SCORE
from hunkmill.catalog.registry import query, tidy
from hunkmill.catalog.rollup_queries import ANALYSIS, THRESHOLD, TREND, WITH_HUNKS, summary_sql
from hunkmill.functions import fixed_values as fv
from hunkmill.operators import evaluation, joins, rollups
from hunkmill.plans import calibration, contrast, report, trends
from hunkmill.session import new_shared_path
from hunkmill.sources import corpora, readers, writers

# --- the calibration data set -----------------------------------------------------------------
_PER_STRATUM = 150


@query(
    "calibration_dataset",
    f"""WITH {_AI.replace('numbered', 'ai_numbered').replace('runs', 'ai_runs').replace('snippets', 'ai_snippets')},
{_HUMAN_HUNKS},
both_sides AS (
  SELECT 1 AS label, language, file_category, line_count FROM sized JOIN wanted USING (sha)
  UNION ALL
  SELECT 0, language, file_category, line_count FROM human_sized JOIN human_files USING (pr_id, section))
SELECT label, language, file_category, {t.BUCKET} AS length_bucket, count(*) AS hunks,
       least(count(*), {_PER_STRATUM}) AS sampled
FROM both_sides WHERE line_count > 0 GROUP BY ALL""",
)
def calibration_dataset(spark, folder):
    """The labelled hunks of both sides, written in full and sampled, with the counts of both files."""
    details, pulls, repositories = _merged_parts(spark, folder)
    built = calibration.build_dataset(
        details, pulls, _human_pulls(spark, folder), repositories, t.pull_patches(spark, folder),
        per_language=None, per_stratum=_PER_STRATUM,
    )
    path = new_shared_path(spark, "calibration")
    built.write(path)
    strata = list(rollups.STRATA)

    def counted(name, column):
        rows = spark.read.parquet(f"{path}/{name}")
        return rows.groupBy(*strata).agg(F.count(F.lit(1)).alias(column))

    return tidy(counted("hunks_full", "hunks").join(counted("hunks_sampled", "sampled"), strata))


# --- the trend out of a frozen configuration --------------------------------------------------
_CONFIGURED = ANALYSIS.replace(
    t.MAIN_HUNKS,
    f"""main_hunks AS (
  SELECT * REPLACE ({_HUNK_SCORE} AS prob_ai) FROM hunks
  WHERE language = 'Java' AND file_category IN ('source', 'docs')
    AND length_bucket NOT IN ('very_short', 'short'))""",
)


@query(
    "configured_trend",
    f"WITH {_CONFIGURED} {summary_sql('repo, calendar_month', WITH_HUNKS)} GROUP BY ALL",
)
def configured_trend(spark, folder):
    """The trend with threshold, languages, categories and lengths of a configuration file, as the
    monthly file that it leaves has it."""
    rows = t.hunks(spark, folder)
    config = evaluation.frozen_config(rows.select(*evaluation.STRATUM).distinct(), rows, THRESHOLD)
    config = config.withColumns({
        "main_languages": F.array(F.lit("Java")),
        "main_file_categories": F.array(F.lit("source"), F.lit("docs")),
        "excluded_length_buckets": F.array(F.lit("very_short"), F.lit("short")),
    })
    path = new_shared_path(spark, "configured")
    writers.run_summary(config, f"{path}/config")

    def score(usable):
        margin = F.col("line_count") / 20.0 - F.col("file_index") / 3.0 + F.col("score") - 1
        return usable.withColumn("prob_ai", 1 / (1 + F.exp(-margin)))

    arguments = trends.configured(readers.frozen_config(spark, f"{path}/config"))
    found = trends.analyse(t.commits(spark, folder), rows, score, keys=["commit_hash"], **arguments)
    writers.csv(found.monthly.select(*schemas.MONTHLY_SUMMARY.names), f"{path}/monthly")
    return tidy(readers.summary_csv(spark, f"{path}/monthly", schemas.MONTHLY_SUMMARY))


# --- the report -------------------------------------------------------------------------------
_LATER = TREND.replace(
    "strftime(o_orderdate, '%Y-%m') AS calendar_month",
    "(year(o_orderdate) + 27) || strftime(o_orderdate, '-%m') AS calendar_month",
)


@query(
    "report_tables",
    f"""{_LATER},
yearly AS (
  SELECT CAST(substr(calendar_month, 1, 4) AS BIGINT) AS year, sum(commits) AS commits,
         sum(ai_like_commits) AS hits
  FROM pooled WHERE threshold_label = 'medium' AND calendar_month >= '2021' GROUP BY ALL)
SELECT 'threshold_robustness' AS file, repo || ' ' || threshold_label AS name,
       round(avg(commit_ai_fraction), 7) AS value
FROM monthly GROUP BY repo, threshold_label
UNION ALL
SELECT 'pooled_monthly_summary_medium', calendar_month, round(commit_ai_fraction, 7) FROM pooled
WHERE threshold_label = 'medium' AND calendar_month >= '2021-01'
UNION ALL
SELECT 'repo_monthly_summary_medium', repo || ' ' || calendar_month, round(commit_ai_fraction, 7)
FROM monthly WHERE threshold_label = 'medium' AND calendar_month >= '2021-01'
UNION ALL
SELECT 'pre_post_yearly_summary', CAST(year AS VARCHAR), round(hits / commits, 7) FROM yearly
UNION ALL
SELECT 'pre_post_period_summary',
       CASE WHEN year <= 2022 THEN '2021-2022 pre-mainstream LLM' ELSE '2023-2025 post-mainstream LLM' END,
       round(sum(hits) / sum(commits), 7) FROM yearly GROUP BY 2
UNION ALL
SELECT 'repo_sample_sizes', repo, count(*)::DOUBLE FROM commits GROUP BY repo
UNION ALL
SELECT 'exclusions_and_thresholds', 'allowed_combinations', n::DOUBLE
FROM (WITH {_FROZEN} SELECT count(*) AS n FROM good)
UNION ALL
SELECT 'exclusions_and_thresholds', 'threshold', 0.45""",
)
def report_tables(spark, folder):
    """All tables of the report, as its files have them."""
    commits = t.commits(spark, folder).withColumn("calendar_month", F.concat(
        (F.year("author_date") + 27).cast("string"), F.date_format("author_date", "-MM")
    ))
    hunk_rows = t.hunks(spark, folder)
    analysis = rollups.commit_analysis(commits, rollups.main_hunks(hunk_rows), THRESHOLD, ["commit_hash"])
    rows, strata = _frozen(spark, folder)
    threshold = fv.THRESHOLD_GRID[3]
    with_repo = hunk_rows.join(commits.select("repo", "commit_hash"), "commit_hash")
    made = report.build(
        rollups.monthly_summary(analysis), rollups.pooled_monthly(analysis),
        evaluation.frozen_config(strata, rows, threshold), trends.repo_summaries(commits, with_repo),
        evaluation.confusion_metrics(rows, threshold),
    )
    path = new_shared_path(spark, "report")
    made.write(path)
    files = {
        "threshold_robustness": (["repo", "threshold_label"], "mean_commit_ai_fraction"),
        "pooled_monthly_summary_medium": (["calendar_month"], "commit_ai_fraction"),
        "repo_monthly_summary_medium": (["repo", "calendar_month"], "commit_ai_fraction"),
        "pre_post_yearly_summary": (["year"], "weighted_commit_ai_fraction"),
        "pre_post_period_summary": (["period"], "weighted_commit_ai_fraction"),
        "repo_sample_sizes": (["repo"], "commit_rows"),
        "exclusions_and_thresholds": (["type"], "value"),
    }
    found = None
    for file, (names, value) in files.items():
        read = spark.read.option("header", True).option("escape", '"').csv(f"{path}/{file}")
        part = read.select(
            F.lit(file).alias("file"), F.concat_ws(" ", *names).alias("name"),
            F.col(value).try_cast("double").alias("value"),
        )
        found = part if found is None else found.unionByName(part)
    return tidy(found.where("value IS NOT NULL"), 7)


# --- the whole contrast experiment ------------------------------------------------------------
@query(
    "contrast_experiments",
    f"""SELECT criterion || '_threshold' AS name, positives, negatives, roc_auc, pr_auc, loss
FROM (WITH {_BASELINE}, {areas_sql('named', 'criterion')})
UNION ALL
SELECT name, positives, negatives, roc_auc, pr_auc, loss
FROM (WITH {_CONTRAST}, {areas_sql('named', 'name')})""",
)
def contrast_experiments(spark, folder):
    """Areas and losses of the four baselines and of the perturbation experiments."""
    found = contrast.experiments(t.text_pairs(spark, folder), _benchmark_model(spark, folder), [1, 10])
    return tidy(found)


# --- corpora by name --------------------------------------------------------------------------
_WORD_COUNT = f"len({t.words_sql('text')})"


@query(
    "named_corpora",
    f"""SELECT 'writing' AS corpus, count(*) AS texts,
       CAST(sum(length(trim(lang || chr(10) || {_LINE}, ' '))) AS BIGINT) AS characters FROM documents
UNION ALL
SELECT CASE lang WHEN 'en' THEN 'english' ELSE 'german' END, count(*), CAST(sum(length(text)) AS BIGINT)
FROM documents WHERE lang IN ('en', 'de') AND {_WORD_COUNT} > 100 AND {_WORD_COUNT} < 150 GROUP BY lang
UNION ALL
SELECT 'pubmed', count(*), CAST(sum(length('Question: ' || lang || ' Answer:<<<SEP>>>' || text)) AS BIGINT)
FROM documents
UNION ALL
SELECT 'commits_gpt2', count(*), CAST(sum(length('order ' || o_orderkey || chr(10) || 'by ' || o_orderstatus)) AS BIGINT) FROM orders
UNION ALL
SELECT 'commits_gpt3', count(*), CAST(sum(length('customer "' || c_name || '" {{}}')) AS BIGINT) FROM customer""",
)
def named_corpora(spark, folder):
    """All corpora, laid out as files and loaded by their names."""
    base = new_shared_path(spark, "corpora")
    documents = t.table(spark, folder, "documents")
    one_line = F.replace(F.replace("text", F.lit("\n"), F.lit(" ")), F.lit("\r"), F.lit(" "))
    for name, column in (("source", F.col("lang")), ("target", one_line)):
        ordered = documents.orderBy("doc_id").select(column.alias("value"))
        writers.text_lines(ordered, f"{base}/writingPrompts/valid.wp_{name}")
    key = F.col("doc_id").alias("key")
    writers.parquet(documents.select(key, F.col("lang").alias("question"), F.col("text").alias("long_answer")), f"{base}/pubmed")
    writers.parquet(documents.select(key, F.create_map("lang", "text").alias("translation")), f"{base}/wmt16")
    orders, customers = t.table(spark, folder, "orders"), t.table(spark, folder, "customer")
    writers.json_arrays(orders.select(
        F.col("o_orderkey").cast("string").alias("hash"),
        F.concat(F.lit("order "), "o_orderkey", F.lit("\nby "), "o_orderstatus").alias("msg"),
    ), f"{base}/commits_gpt2.json")
    writers.json_arrays(customers.select(
        F.col("c_custkey").cast("string").alias("hash"),
        F.concat(F.lit('customer "'), "c_name", F.lit('" {}')).alias("msg"),
    ), f"{base}/commits_gpt3.json")
    found = None
    for name in corpora.CORPORA:
        sums = corpora.load(spark, name, base).agg(
            F.lit(name).alias("corpus"), F.count(F.lit(1)).alias("texts"),
            F.sum(F.length("text")).alias("characters"),
        )
        found = sums if found is None else found.unionByName(sums)
    return found


# --- tables in buckets ------------------------------------------------------------------------
_BUCKETS = 16


@query(
    "mined_hunk_rollup",
    f"""WITH {_MINED},
per_commit AS (SELECT repo, commit_hash, count(*) AS hunks, CAST(sum(line_count) AS BIGINT) AS lines
               FROM mined_hunks GROUP BY ALL)
SELECT repo, commit_hash, coalesce(hunks, 0) AS hunks, coalesce(lines, 0) AS lines
FROM (SELECT DISTINCT repo, commit_hash FROM mined) LEFT JOIN per_commit USING (repo, commit_hash)
WHERE repo IN ('r0', 'r2')""",
)
def mined_hunk_rollup(spark, folder):
    """Hunks and lines of all commits of two repositories, from mined tables in buckets of the commit:
    kept, counted and joined where they lie."""
    path = new_shared_path(spark, "mined")
    mined = trends.mine(_nested(spark, folder))
    mined.write(path)
    wanted, keys, name = ["r0", "r2"], ["repo", "commit_hash"], uuid.uuid4().hex
    tables = {}
    for kind, rows in (
        ("commits", readers.mined_commits(spark, f"{path}/commit_metrics")),
        ("hunks", readers.mined_hunks(spark, f"{path}/hunk_metrics")),
    ):
        at = f"{path}/{kind}_in_buckets"
        tables[kind] = writers.co_located(rows, at, f"{kind}_{name}", keys, _BUCKETS).where(F.col("repo").isin(wanted))
    kept = joins.co_located_hunks(tables["hunks"], tables["commits"], keys)
    counts = kept.groupBy(*keys).agg(F.count(F.lit(1)).alias("hunks"), F.sum("line_count").alias("lines"))
    joined = tables["commits"].select(*keys).join(counts, keys, "left")
    return joined.fillna(0, subset=["hunks", "lines"])


# --- bad lines kept apart ---------------------------------------------------------------------
@query(
    "csv_quarantine",
    """WITH lines AS (
  SELECT o_orderkey AS k,
         CASE WHEN o_orderkey % 7 = 3 THEN o_orderkey || ',a,b,surplus,"more, of it"'
              WHEN o_orderkey % 11 = 5 THEN o_orderkey || ',short' END AS bad FROM orders)
SELECT 'kept' AS kind, k || '|say "a"' || chr(10) || 'b|' || k % 5 AS content FROM lines WHERE bad IS NULL
UNION ALL SELECT 'apart', bad FROM lines WHERE bad IS NOT NULL""",
)
def csv_quarantine(spark, folder):
    """Records of CSV files with quotes and line breaks, and whole those that do not fit the header."""
    key = F.col("o_orderkey").cast("string")
    lines = t.table(spark, folder, "orders").select(
        F.when(F.col("o_orderkey") % 7 == 3, F.concat(key, F.lit(',a,b,surplus,"more, of it"')))
        .when(F.col("o_orderkey") % 11 == 5, F.concat(key, F.lit(",short")))
        .otherwise(F.concat(key, F.lit(',"say ""a""\nb",'), (F.col("o_orderkey") % 5).cast("string"))).alias("value")
    )
    path = new_shared_path(spark, "lines")
    writers.text_lines(lines, path)
    kept, apart = readers.csv_and_quarantine(spark, path, ["hash", "message", "n"], has_header=False)
    return kept.select(F.lit("kept").alias("kind"), F.concat_ws("|", "hash", "message", "n").alias("content")).union(
        apart.select(F.lit("apart"), F.col("line"))
    )
