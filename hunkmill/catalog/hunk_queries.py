from __future__ import annotations

from pyspark.sql import functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.registry import query, tidy
from hunkmill.operators import hunks, joins, rollups
from hunkmill.operators.sampling import sample_by_strata

_HUNK_COLUMNS = f"""hunk_index, md5(snippet) AS snippet_md5, {t.LINE_COUNT} AS line_count,
       length(snippet) AS char_count"""


def _digest(rows):
    return rows.withColumn("snippet_md5", F.md5("snippet")).drop("snippet")


@query(
    "added_hunks",
    f"""WITH {t.PATCH_LINES}, {t.hunk_sql('patch_lines', 'doc_id, lang')}
SELECT doc_id, lang, {_HUNK_COLUMNS} FROM snippets""",
)
def added_hunks(spark, folder):
    return tidy(_digest(hunks.explode_hunks(t.patches(spark, folder))))


@query(
    "patch_files",
    f"""WITH {t.PULL_FILES}
SELECT pr_id, row_number() OVER (PARTITION BY pr_id ORDER BY section) - 1 AS kept_index, filename,
       md5(string_agg(line, chr(10) ORDER BY i)) AS patch_md5
FROM files JOIN file_lines USING (pr_id, section) GROUP BY pr_id, section, filename""",
)
def patch_files(spark, folder):
    from pyspark.sql import Window

    rows = hunks.split_files(t.pull_patches(spark, folder))
    order = Window.partitionBy("pr_id").orderBy("file_index")
    return rows.select(
        "pr_id", (F.row_number().over(order) - 1).cast("long").alias("kept_index"), "filename",
        F.md5("patch").alias("patch_md5"),
    )


# --- calibration hunks, machine side ----------------------------------------------------------
# One commit file per document, named by its language; pull request and repository by number.


def _merged_parts(spark, folder):
    """File details, pull requests and repositories."""
    people = t.table(spark, folder, "supplier").agg(F.count(F.lit(1))).scalar()
    details = t.patches(spark, folder).select(
        (F.col("doc_id") % people).alias("pr_id"),
        F.concat(F.lit("s"), F.col("doc_id")).alias("sha"),
        F.when(F.col("doc_id") % 9 == 0, "helper[bot]").otherwise("Ann").alias("author"),
        F.when(F.col("doc_id") % 10 == 0, "GitHub-Actions").otherwise(None).alias("committer"),
        F.lit("m").alias("message"),
        F.when(F.col("lang") == "en", "src/a.py").when(F.col("lang") == "fr", "web/App.ts")
        .when(F.col("lang") == "de", "x/vendor/B.java").otherwise("tests/C.txt").alias("filename"),
        F.lit("modified").alias("status"), "patch",
    )
    suppliers = t.table(spark, folder, "supplier")
    pulls = suppliers.select(
        F.col("s_suppkey").alias("id"), F.lit(1).alias("label"), F.col("s_name").alias("agent"),
        F.lit("2025-01-01").alias("created_at"),
        F.concat(F.lit("https://github.com/org/n"), F.col("s_nationkey").cast("string"))
        .alias("repo_url"),
        F.concat(F.lit("org/n"), F.col("s_nationkey").cast("string")).alias("repo_full_name"),
        F.lit("h").alias("html_url"), F.lit("t").alias("title"),
    )
    return details, pulls, t.repositories(spark, folder)


def _merged(spark, folder):
    details, pulls, repositories = _merged_parts(spark, folder)
    return joins.join_repository(joins.join_commit_pr(details, pulls), repositories, ["sha"])


_MERGED = """details AS (
  SELECT doc_id % (SELECT count(*) FROM supplier) AS pr_id, 's' || doc_id AS sha, doc_id,
         CASE lang WHEN 'en' THEN 'src/a.py' WHEN 'fr' THEN 'web/App.ts'
                   WHEN 'de' THEN 'x/vendor/B.java' ELSE 'tests/C.txt' END AS filename
  FROM documents WHERE doc_id % 9 <> 0 AND doc_id % 10 <> 0),
prs AS (SELECT s_suppkey AS id, s_name AS agent,
               'https://github.com/org/n' || s_nationkey AS repo_url FROM supplier),
typed AS (
  SELECT sha, doc_id, pr_id, agent, p.repo_url, filename, r.language AS repo_language, stars,
         CASE WHEN filename = 'src/a.py' THEN 'Python' WHEN filename = 'web/App.ts'
              THEN 'TypeScript' ELSE coalesce(r.language, 'Unknown') END AS language,
         CASE WHEN filename = 'tests/C.txt' THEN 'docs' ELSE 'source' END AS file_category
  FROM details JOIN prs p ON pr_id = id
       LEFT JOIN (SELECT * FROM repositories WHERE repo_url IS NOT NULL) r USING (repo_url)
  WHERE filename <> 'x/vendor/B.java'),
wanted AS (SELECT * FROM typed WHERE language IN ('Java', 'Python'))"""
_AI = f"""{t.PULLS}, {_MERGED}, {t.PATCH_LINES},
wanted_lines AS (SELECT sha, i, line FROM patch_lines JOIN wanted USING (doc_id)),
{t.hunk_sql('wanted_lines', 'sha')},
sized AS (SELECT sha, hunk_index, snippet, {t.LINE_COUNT} AS line_count FROM snippets)"""


@query(
    "calibration_hunks_ai",
    f"""WITH {_AI}
SELECT pr_id, sha, agent, repo_url, repo_language, stars, filename, file_category, language,
       hunk_index, md5(snippet) AS snippet_md5, line_count, length(snippet) AS char_count,
       {t.BUCKET} AS length_bucket, 1 AS label
FROM sized JOIN wanted USING (sha)""",
)
def calibration_hunks_ai(spark, folder):
    rows = _digest(hunks.calibration_hunks_ai(_merged(spark, folder)))
    return tidy(rows.select(
        "pr_id", "sha", "agent", "repo_url", "repo_language", "stars", "filename",
        "file_category", "language", "hunk_index", "snippet_md5", "line_count", "char_count",
        "length_bucket", "label",
    ))


# --- calibration hunks, human side ------------------------------------------------------------


def _human_pulls(spark, folder):
    return t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("id"), F.lit(0).alias("label"), F.lit("Human").alias("agent"),
        F.lit("2025-01-01").alias("created_at"),
        F.concat(F.lit("https://github.com/org/n"), (F.col("doc_id") % 25).cast("string"))
        .alias("repo_url"),
        F.lit("f").alias("repo_full_name"), F.lit("h").alias("html_url"),
        F.lit("t").alias("title"),
    )


def _human(spark, folder):
    return hunks.calibration_hunks_human(
        _human_pulls(spark, folder), t.repositories(spark, folder),
        t.pull_patches(spark, folder), per_language=None,
    )


_HUMAN = f"""human AS (
  SELECT d.doc_id AS pr_id, repo_url, language AS repo_language, coalesce(stars, 0) AS stars
  FROM documents d
       JOIN (SELECT * FROM repositories WHERE repo_url IS NOT NULL) r
       ON r.repo_url = 'https://github.com/org/n' || (d.doc_id % 25)
  WHERE language IN ('Java', 'Python')),
{t.PULL_FILES},
bases AS (SELECT *, regexp_replace(filename, '^moved/', '') AS base FROM files),
typed_files AS (
  SELECT pr_id, section, filename, base, repo_url, repo_language, stars,
         CASE WHEN base LIKE '%.py' THEN 'Python' WHEN base LIKE '%.java' THEN 'Java'
              WHEN base LIKE '%.ts' THEN 'TypeScript' WHEN base LIKE '%.kt' THEN 'Kotlin'
              ELSE repo_language END AS language,
         CASE WHEN base = 'docs/readme.md' THEN 'docs'
              WHEN base IN ('src/test_b.py', 'core/tests/E.java') THEN 'test'
              WHEN base = 'conf/g.yml' THEN 'config' ELSE 'source' END AS file_category
  FROM bases JOIN human USING (pr_id)
  WHERE base NOT IN ('pkg/vendor/c.py', 'app/yarn.lock')),
human_files AS (SELECT * FROM typed_files WHERE language IN ('Java', 'Python')),
human_lines AS (SELECT pr_id, section, i, line FROM file_lines
                JOIN human_files USING (pr_id, section))"""
_HUMAN_HUNKS = (
    f"{_HUMAN}, {t.hunk_sql('human_lines', 'pr_id, section')}, "
    f"human_sized AS (SELECT pr_id, section, hunk_index, snippet, {t.LINE_COUNT} AS line_count "
    "FROM snippets)"
)


@query(
    "calibration_hunks_human",
    f"""WITH {t.PULLS}, {_HUMAN_HUNKS}
SELECT pr_id, repo_url, repo_language, stars, filename, 'patch' AS status, file_category, language,
       hunk_index, md5(snippet) AS snippet_md5, line_count, length(snippet) AS char_count,
       {t.BUCKET} AS length_bucket, 0 AS label
FROM human_sized JOIN human_files USING (pr_id, section)""",
)
def calibration_hunks_human(spark, folder):
    return tidy(_digest(_human(spark, folder)).select(
        "pr_id", "repo_url", "repo_language", "stars", "filename", "status", "file_category",
        "language", "hunk_index", "snippet_md5", "line_count", "char_count", "length_bucket",
        "label",
    ))


@query(
    "union_ai_human",
    f"""WITH {_AI.replace('numbered', 'ai_numbered').replace('runs', 'ai_runs').replace('snippets', 'ai_snippets')},
{_HUMAN_HUNKS},
both_sides AS (
  SELECT 1 AS label, language, file_category, line_count, hunk_index, length(snippet) AS chars
  FROM sized JOIN wanted USING (sha)
  UNION ALL
  SELECT 0, language, file_category, line_count, hunk_index, length(snippet)
  FROM human_sized JOIN human_files USING (pr_id, section))
SELECT label, language, file_category, {t.BUCKET} AS length_bucket, count(*) AS hunks,
       CAST(sum(line_count) AS BIGINT) AS lines, CAST(sum(chars) AS BIGINT) AS chars,
       max(hunk_index) AS last_index
FROM both_sides WHERE line_count > 0 GROUP BY ALL""",
)
def union_ai_human(spark, folder):
    both = hunks.union_ai_human(
        hunks.calibration_hunks_ai(_merged(spark, folder)), _human(spark, folder)
    )
    return tidy(both.groupBy(*rollups.STRATA).agg(
        F.count(F.lit(1)).alias("hunks"), F.sum("line_count").alias("lines"),
        F.sum("char_count").alias("chars"), F.max("hunk_index").alias("last_index"),
    ))


# --- nested commits: orders with their lines and documents as files ---------------------------


def _nested(spark, folder):
    """Commits by document source and hundred; every document is one modified file."""
    file = F.struct(
        F.when(F.col("lang") == "en", "m.py").otherwise("n.md").alias("filename"),
        F.when(F.col("lang") == "fr", "").otherwise(F.lit(None)).alias("old_path"),
        F.when(F.col("lang") == "en", F.concat(F.lit("src/m"), F.col("doc_id"), F.lit(".py")))
        .when(F.col("lang") == "de", F.concat(F.lit("a/build/"), F.col("doc_id"), F.lit(".java")))
        .otherwise("").alias("new_path"),
        F.col("patch").alias("diff"), F.col("doc_id"),
    )
    people = [F.struct(F.lit(n).alias("name"), F.lit(None).cast("string").alias("email"))
              for n in ("Ann", "renovate")]
    grouped = t.patches(spark, folder).groupBy((F.floor(F.col("doc_id") / 4)).alias("n")).agg(
        F.array_sort(F.collect_list(F.struct(F.col("doc_id").alias("place"), file.alias("f"))))
        .alias("files_")
    )
    n = F.col("n")
    return grouped.select(
        F.concat(F.lit("r"), (n % 3).cast("string")).alias("repo"),
        F.concat(F.lit("h"), n.cast("string")).alias("hash"),
        F.lit("2024-05-06T07:08:09+00:00").alias("author_date"),
        F.lit("2024-05-06T07:08:09+00:00").cast("timestamp").alias("committer_date"),
        F.when(n % 7 == 0, people[1]).otherwise(people[0]).alias("author"),
        people[0].alias("committer"), F.lit("one\ntwo").alias("msg"),
        F.when(n % 5 == 0, F.array(F.lit("p"), F.lit("q"))).otherwise(F.array(F.lit("p")))
        .alias("parents"),
        F.size("files_").alias("files"), n.cast("int").alias("insertions"),
        F.lit(1).alias("deletions"), (n.cast("int") + 1).alias("lines"),
        F.transform("files_", lambda x: x["f"]).alias("modified_files"),
    )


_MINED = f"""nested AS (
  SELECT doc_id, doc_id // 4 AS n, lang, 'r' || ((doc_id // 4) % 3) AS repo,
         'h' || (doc_id // 4) AS commit_hash,
         row_number() OVER (PARTITION BY doc_id // 4 ORDER BY doc_id) - 1 AS file_index,
         count(*) OVER (PARTITION BY doc_id // 4) AS commit_files,
         CASE lang WHEN 'en' THEN 'src/m' || doc_id || '.py' ELSE 'n.md' END AS filename,
         CASE lang WHEN 'en' THEN 'source' ELSE 'docs' END AS file_category,
         CASE lang WHEN 'en' THEN 'Python' ELSE 'Unknown' END AS language
  FROM documents),
mined AS (SELECT * FROM nested WHERE n % 7 <> 0 AND n % 5 <> 0),
{t.PATCH_LINES},
mined_lines AS (SELECT doc_id, i, line FROM patch_lines JOIN mined USING (doc_id)
                WHERE mined.lang <> 'de'),
{t.hunk_sql('mined_lines', 'doc_id')},
mined_hunks AS (SELECT *, {t.LINE_COUNT} AS line_count FROM snippets JOIN mined USING (doc_id))"""


@query(
    "commit_hunks",
    f"""WITH {_MINED}
SELECT repo, commit_hash, file_index, filename, file_category, language, hunk_index, line_count,
       length(snippet) AS char_count, md5(snippet) AS snippet_md5, n AS commit_insertions,
       commit_files
FROM mined_hunks""",
)
def commit_hunks(spark, folder):
    mined = hunks.commit_hunks(hunks.minable_commits(_nested(spark, folder)))
    return tidy(_digest(mined).drop("author_date", "commit_deletions"))


@query(
    "commit_metrics",
    f"""WITH {_MINED},
per_file AS (SELECT commit_hash, doc_id, file_category, count(*) AS hunks,
                    sum(line_count) AS added FROM mined_hunks GROUP BY ALL),
rolled AS (SELECT commit_hash, sum(hunks) AS h, sum(added) AS a,
                  count(*) FILTER (WHERE file_category = 'source') AS s,
                  count(*) FILTER (WHERE file_category = 'docs') AS d
           FROM per_file GROUP BY ALL)
SELECT repo, commit_hash, 'one\\ntwo' AS message, 1 AS parents, commit_files AS files,
       n AS insertions, CAST(coalesce(h, 0) AS BIGINT) AS hunk_count,
       CAST(coalesce(a, 0) AS BIGINT) AS added_hunk_lines, coalesce(s, 0) AS source_file_count,
       0 AS test_file_count, coalesce(d, 0) AS docs_file_count, 0 AS config_file_count
FROM (SELECT DISTINCT repo, commit_hash, commit_files, n FROM mined)
     LEFT JOIN rolled USING (commit_hash)""",
)
def commit_metrics(spark, folder):
    commits = hunks.minable_commits(
        _nested(spark, folder), "2021-01-01", "2025-12-31T23:59:59"
    )
    metrics = hunks.commit_metrics(commits, hunks.commit_hunks(commits))
    return tidy(metrics.select(
        "repo", "commit_hash", "message", "parents", "files", "insertions", *hunks.ROLLUP_COUNTS
    ))


@query(
    "sample_counts",
    f"""WITH {t.HUNKS}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY label, language, file_category, length_bucket
                               ORDER BY {t.HUNK_DIGEST}) AS place FROM hunks)
SELECT label, language, file_category, length_bucket, count(*) AS count
FROM ranked WHERE place <= 400 GROUP BY ALL""",
)
def sample_counts(spark, folder):
    return tidy(rollups.strata_counts(sample_by_strata(t.hunks(spark, folder), t.HUNK_KEY)))
