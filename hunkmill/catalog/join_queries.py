from __future__ import annotations

from pyspark.sql import functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.registry import query, tidy
from hunkmill.functions import identity
from hunkmill.operators import joins, pairs
from hunkmill.operators.evaluation import frozen_strata, stratum_metrics
from hunkmill.operators.sampling import sample_commits_per_month


def _normalised_pulls(spark, folder):
    return t.pulls(spark, folder).select(
        "id", "agent", "title", identity.repo_url(F.col("raw_url")).alias("repo_url")
    )


def _details(spark, folder):
    return t.table(spark, folder, "orders").select(
        F.col("o_custkey").alias("pr_id"), F.col("o_orderkey").alias("sha"),
        F.col("o_orderpriority").alias("filename"),
    )


@query(
    "join_commit_pr",
    f"""WITH {t.PULLS}
SELECT o_custkey AS pr_id, o_orderkey AS sha, o_orderpriority AS filename, agent, title, repo_url
FROM orders JOIN pulls ON o_custkey = id""",
)
def join_commit_pr(spark, folder):
    return joins.join_commit_pr(_details(spark, folder), _normalised_pulls(spark, folder))


@query(
    "join_repo_left",
    f"""WITH {t.PULLS}
SELECT id, agent, p.repo_url, language, stars
FROM pulls p LEFT JOIN (SELECT * FROM repositories WHERE repo_url IS NOT NULL) r USING (repo_url)""",
)
def join_repo_left(spark, folder):
    rows = _normalised_pulls(spark, folder).select("id", "agent", "repo_url")
    return joins.join_repository(rows, t.repositories(spark, folder), ["id"])


@query(
    "repo_key_check",
    f"""WITH {t.PULLS}
SELECT repo_url, count(*) AS rows FROM repositories GROUP BY repo_url HAVING count(*) > 1""",
)
def repo_key_check(spark, folder):
    return joins.duplicate_keys(t.repositories(spark, folder), ["repo_url"])


_SAMPLED = """sampled AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, calendar_month
                   ORDER BY md5(concat_ws('|', '42', commit_hash))) AS place FROM commits)
  WHERE place <= 60)"""


@query(
    "sampled_commit_hunks",
    f"""WITH {t.COMMITS}, {t.HUNKS}, {_SAMPLED}
SELECT commit_hash, file_index, part, supplier, cents, line_count, round(prob_ai, 9) AS prob_ai
FROM hunks WHERE commit_hash IN (SELECT commit_hash FROM sampled)""",
)
def sampled_commit_hunks(spark, folder):
    sampled = sample_commits_per_month(t.commits(spark, folder))
    kept = joins.hunks_of_commits(t.hunks(spark, folder), sampled, ["commit_hash"])
    return tidy(kept.select(*t.HUNK_KEY, "line_count", "prob_ai"))


@query(
    "allowed_strata_semi",
    f"""WITH {t.HUNKS}, counts AS (
  SELECT language, file_category, length_bucket,
         count(*) FILTER (WHERE prob_ai >= 0.5 AND label = 1) AS tp,
         count(*) FILTER (WHERE prob_ai < 0.5 AND label = 0) AS tn,
         count(*) FILTER (WHERE prob_ai >= 0.5 AND label = 0) AS fp,
         count(*) FILTER (WHERE prob_ai < 0.5 AND label = 1) AS fn
  FROM hunks GROUP BY ALL),
good AS (SELECT * FROM counts
         WHERE tp + tn + fp + fn >= 25 AND tp + fn > 0 AND tn + fp > 0
           AND (tp / (tp + fn) + tn / (tn + fp)) / 2 >= 0.60 AND fp / (fp + tn) <= 0.35),
seen AS (SELECT DISTINCT h.language, c.file_category, b.length_bucket
         FROM hunks h, (SELECT DISTINCT file_category FROM hunks) c,
              (SELECT DISTINCT length_bucket FROM hunks) b
         WHERE c.file_category IN ('source', 'test') AND b.length_bucket <> 'very_short'
           AND NOT EXISTS (SELECT 1 FROM good)),
allowed AS (SELECT language, file_category, length_bucket FROM good
            UNION ALL SELECT * FROM seen)
SELECT commit_hash, file_index, part, supplier, cents, language, file_category, length_bucket
FROM hunks JOIN allowed USING (language, file_category, length_bucket)""",
)
def allowed_strata_semi(spark, folder):
    rows = t.hunks(spark, folder)
    strata = ["language", "file_category", "length_bucket"]
    allowed = frozen_strata(stratum_metrics(rows, 0.5, [strata]), rows)
    return tidy(joins.allowed_hunks(rows, allowed).select(*t.HUNK_KEY, *strata))


@query(
    "positional_pairs",
    f"""WITH {t.PAIRS}
SELECT pair_id, md5(original) AS original_md5, md5(sampled) AS sampled_md5 FROM pairs""",
)
def positional_pairs(spark, folder):
    rows = t.text_pairs(spark, folder)
    originals = rows.select("pair_id", F.col("original").alias("text"))
    sampled = rows.select("pair_id", F.col("sampled").alias("text"))
    return pairs.match_sides(originals, sampled).select(
        "pair_id", F.md5("original").alias("original_md5"), F.md5("sampled").alias("sampled_md5")
    )
