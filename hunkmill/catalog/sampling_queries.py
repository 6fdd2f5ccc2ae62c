from __future__ import annotations

from pyspark.sql import functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.registry import query, tidy
from hunkmill.functions import identity
from hunkmill.operators import sampling

KEY = ", ".join(t.HUNK_KEY)


def _ranked(rows: str, strata: str, digest: str) -> str:
    return f"(SELECT *, row_number() OVER (PARTITION BY {strata} ORDER BY {digest}) AS place FROM {rows})"


@query(
    "sample_by_strata",
    f"""WITH {t.HUNKS}
SELECT label, language, file_category, length_bucket, {KEY}
FROM {_ranked('hunks', 'label, language, file_category, length_bucket', t.HUNK_DIGEST)}
WHERE place <= 400""",
)
def sample_by_strata(spark, folder):
    rows = sampling.sample_by_strata(t.hunks(spark, folder), t.HUNK_KEY)
    return tidy(rows.select(*sampling.STRATA, *t.HUNK_KEY))


@query(
    "capped_stratified",
    f"""WITH {t.HUNKS}, shape AS (
  SELECT count(*) AS n, count(DISTINCT (label, language, file_category, length_bucket)) AS strata
  FROM hunks),
capped AS (
  SELECT h.* FROM {_ranked('hunks', 'label, language, file_category, length_bucket', t.HUNK_DIGEST)} h,
         shape
  WHERE n <= 6000 OR place <= greatest(6000 // strata, 20))
SELECT label, language, file_category, length_bucket, {KEY} FROM capped
ORDER BY {t.HUNK_DIGEST} LIMIT 6000""",
)
def capped_stratified(spark, folder):
    rows = sampling.capped_stratified(t.hunks(spark, folder), t.HUNK_KEY)
    return tidy(rows.select(*sampling.STRATA, *t.HUNK_KEY))


@query(
    "sample_per_language",
    f"""WITH {t.PULLS}, known AS (
  SELECT id, agent, language, coalesce(stars, 0) AS stars
  FROM pulls JOIN (SELECT * FROM repositories WHERE repo_url IS NOT NULL) USING (repo_url)
  WHERE language IN ('Java', 'Python'))
SELECT id, agent, language, stars
FROM {_ranked('known', 'language', "md5(concat_ws('|', '42', id))")} WHERE place <= 40""",
)
def sample_per_language(spark, folder):
    pulls = t.pulls(spark, folder).withColumn("repo_url", identity.repo_url(F.col("raw_url")))
    known = pulls.join(t.repositories(spark, folder).dropna(subset=["repo_url"]), "repo_url", "left")
    rows = sampling.sample_per_language(known, ["Java", "Python"])
    return rows.select("id", "agent", "language", "stars")


@query(
    "sample_commits_per_month",
    f"""WITH {t.COMMITS}
SELECT repo, calendar_month, commit_hash
FROM {_ranked('commits', 'repo, calendar_month', "md5(concat_ws('|', '42', commit_hash))")}
WHERE place <= 60""",
)
def sample_commits_per_month(spark, folder):
    rows = sampling.sample_commits_per_month(t.commits(spark, folder))
    return rows.select("repo", "calendar_month", "commit_hash")


@query(
    "sample_per_year",
    f"""WITH {t.MESSAGES}
SELECT year, key FROM {_ranked('messages', 'year', "md5(concat_ws('|', '42', key))")}
WHERE place <= 400""",
)
def sample_per_year(spark, folder):
    rows = sampling.sample_per_year(t.yearly_messages(spark, folder), ["key"])
    return tidy(rows.select("year", "key"))


@query(
    "balance_classes",
    f"""WITH {t.HUNKS}, human AS (
  SELECT *, row_number() OVER (ORDER BY {t.HUNK_DIGEST}) AS place FROM hunks WHERE label = 0)
SELECT label, {KEY} FROM human WHERE place <= (SELECT count(*) FROM hunks WHERE label = 1)
UNION ALL SELECT label, {KEY} FROM hunks WHERE label = 1""",
)
def balance_classes(spark, folder):
    rows = t.hunks(spark, folder)
    human, machine = rows.where(F.col("label") == 0), rows.where(F.col("label") == 1)
    balanced = sampling.balance_classes(
        human.select(*t.HUNK_KEY), machine.select(*t.HUNK_KEY), t.HUNK_KEY, require_enough=True
    )
    return tidy(balanced.select("label", *t.HUNK_KEY))


@query(
    "stratified_split",
    f"""WITH {t.HUNKS}, placed AS (
  SELECT *, row_number() OVER (PARTITION BY label ORDER BY {t.HUNK_DIGEST}) AS place,
         count(*) OVER (PARTITION BY label) AS n FROM hunks)
SELECT label, {KEY}, CAST(place <= ceil(n * 0.2::DOUBLE) AS BIGINT) AS is_test FROM placed""",
)
def stratified_split(spark, folder):
    rows = t.hunks(spark, folder).select("label", *t.HUNK_KEY)
    return tidy(sampling.split_exact(rows, t.HUNK_KEY))


@query(
    "draw_split",
    f"""WITH {t.HUNKS}
SELECT label, {KEY},
       CAST(('0x' || substr({t.HUNK_DIGEST}, 1, 8))::BIGINT / 4294967296 < 0.2 AS BIGINT) AS is_test
FROM hunks""",
)
def draw_split(spark, folder):
    rows = t.hunks(spark, folder).select("label", *t.HUNK_KEY)
    return tidy(sampling.split_by_draw(rows, t.HUNK_KEY))


@query(
    "shuffle_head",
    """SELECT doc_id, place // 50 AS batch FROM (
  SELECT doc_id, row_number() OVER (ORDER BY md5(concat_ws('|', '0', doc_id))) - 1 AS place
  FROM documents)
WHERE place < least((SELECT count(*) FROM documents), 5000) // 50 * 50""",
)
def shuffle_head(spark, folder):
    """Whole batches of the shuffled documents, numbered in shuffle order."""
    from pyspark.sql import Window

    from hunkmill.functions.draws import order_key

    head = sampling.shuffle_head(
        t.table(spark, folder, "documents").select("doc_id"), 5000, ["doc_id"], batch=50
    )
    place = F.row_number().over(Window.orderBy(order_key(0, F.col("doc_id")))) - 1
    return head.select("doc_id", F.floor(place / 50).alias("batch"))
