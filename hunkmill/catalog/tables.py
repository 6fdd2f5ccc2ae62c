"""The test tables in the roles the jobs expect, and the same views as SQL.

Whole tables and whole texts: the mappings add columns, they never leave rows out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from hunkmill.functions.scoring import calendar_month, length_bucket


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- commits: orders --------------------------------------------------------------------------
def commits(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderstatus").alias("repo"), F.col("o_orderkey").alias("commit_hash"),
        F.col("o_orderdate").cast("timestamp").alias("author_date"),
        calendar_month(F.col("o_orderdate")).alias("calendar_month"),
    )


COMMITS = """commits AS (
  SELECT o_orderstatus AS repo, o_orderkey AS commit_hash, o_orderdate AS author_date,
         strftime(o_orderdate, '%Y-%m') AS calendar_month
  FROM orders)"""


# --- hunks: lineitem --------------------------------------------------------------------------
HUNK_KEY = ["commit_hash", "file_index", "part", "supplier", "cents"]


def hunks(spark: SparkSession, folder: str) -> DataFrame:
    line = F.col("l_linenumber")
    rows = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("commit_hash"), line.alias("file_index"),
        F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"),
        F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"),
        F.when(F.col("l_suppkey") % 5 == 0, "Go")
        .when(F.col("l_linestatus") == "O", "Python").otherwise("Java").alias("language"),
        F.when(line <= 3, "source").when(line <= 5, "test").when(line == 6, "docs")
        .otherwise("config").alias("file_category"),
        F.col("l_quantity").cast("int").alias("line_count"),
        (F.col("l_discount") * 10).alias("prob_ai"),
        (F.col("l_extendedprice") % 1000 / 1000).alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
    )
    return rows.withColumn("length_bucket", length_bucket(F.col("line_count")))


HUNKS = """hunks AS (
  SELECT *, CASE WHEN line_count < 5 THEN 'very_short' WHEN line_count < 15 THEN 'short'
                 WHEN line_count < 40 THEN 'medium' ELSE 'long' END AS length_bucket
  FROM (SELECT l_orderkey AS commit_hash, l_linenumber AS file_index, l_partkey AS part,
               l_suppkey AS supplier, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents,
               CASE WHEN l_suppkey % 5 = 0 THEN 'Go' WHEN l_linestatus = 'O' THEN 'Python'
                    ELSE 'Java' END AS language,
               CASE WHEN l_linenumber <= 3 THEN 'source' WHEN l_linenumber <= 5 THEN 'test'
                    WHEN l_linenumber = 6 THEN 'docs' ELSE 'config' END AS file_category,
               CAST(l_quantity AS INTEGER) AS line_count, l_discount * 10 AS prob_ai,
               (l_extendedprice % 1000) / 1000 AS score,
               CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS label
        FROM lineitem))"""
HUNK_DIGEST = "md5(concat_ws('|', '42', commit_hash, file_index, part, supplier, cents))"

MAIN_HUNKS = """main_hunks AS (
  SELECT * FROM hunks
  WHERE language IN ('Java', 'Python') AND file_category IN ('source', 'test')
    AND length_bucket NOT IN ('very_short'))"""

# --- patches: documents, line by line with diff marks -----------------------------------------
# Eight line kinds in turn; every sixteenth line is an added blank one.


def _marked(line: Column, i: Column) -> Column:
    kind = i % 8
    return (
        F.when(i % 16 == 15, "+")
        .when(kind == 0, F.concat(F.lit("@@ -1,3 +1,4 @@ "), line))
        .when(kind == 3, F.concat(F.lit("+++ b/"), line))
        .when(kind == 5, F.concat(F.lit(" "), line))
        .when(kind == 6, F.concat(F.lit("-"), line))
        .when(kind == 7, F.concat(F.lit("+    "), line))
        .otherwise(F.concat(F.lit("+"), line))
    )


def _sentences(text: Column) -> Column:
    return F.split(F.replace(text, F.lit(". "), F.lit(".\n")), "\n")


def patches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        "doc_id", "lang",
        F.array_join(F.transform(_sentences(F.col("text")), _marked), "\n").alias("patch"),
    )


SENTENCES = "string_split(replace(text, '. ', '.' || chr(10)), chr(10))"
PATCH_LINES = f"""patch_lines AS (
  SELECT doc_id, lang, i,
         CASE WHEN i % 16 = 15 THEN '+' WHEN i % 8 = 0 THEN '@@ -1,3 +1,4 @@ ' || line
              WHEN i % 8 = 3 THEN '+++ b/' || line WHEN i % 8 = 5 THEN ' ' || line
              WHEN i % 8 = 6 THEN '-' || line WHEN i % 8 = 7 THEN '+    ' || line
              ELSE '+' || line END AS line
  FROM (SELECT doc_id, lang, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
        FROM (SELECT doc_id, lang, {SENTENCES} AS ls FROM documents)))"""


def hunk_sql(lines: str, keys: str) -> str:
    """CTEs from (keys, i, line) to ``snippets`` (keys, hunk_index, snippet), by window runs."""
    return f"""numbered AS (
  SELECT {keys}, i, line, starts_with(line, '+') AS added,
         sum(CASE WHEN starts_with(line, '+') THEN 0 ELSE 1 END)
           OVER (PARTITION BY {keys} ORDER BY i) AS run
  FROM {lines} WHERE NOT starts_with(line, '+++')),
runs AS (
  SELECT {keys}, run, string_agg(substr(line, 2), chr(10) ORDER BY i) AS body
  FROM numbered WHERE added GROUP BY {keys}, run),
snippets AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY run) - 1 AS hunk_index,
         trim(body, chr(10)) AS snippet
  FROM runs WHERE regexp_matches(body, '[A-Za-z_{{}}();=\\[\\].]'))"""


LINE_COUNT = "len(list_filter(string_split(snippet, chr(10)), lambda l: trim(l) <> ''))"
BUCKET = """CASE WHEN line_count < 5 THEN 'very_short' WHEN line_count < 15 THEN 'short'
       WHEN line_count < 40 THEN 'medium' ELSE 'long' END"""

# --- pull-request patches: documents with file headers ----------------------------------------
# A header every twelfth line from the third on; some without a usable name, some with a later
# name line. The text before the first header belongs to no file.
FILE_NAMES = [
    "src/a.py", "src/test_b.py", "pkg/vendor/c.py", "docs/readme.md", "app/yarn.lock",
    "core/D.java", "core/tests/E.java", "web/f.ts", "conf/g.yml", "lib/h.kt",
]


def _diff_line(line: Column, i: Column) -> Column:
    name = F.element_at(
        F.array(*[F.lit(n) for n in FILE_NAMES]), (F.floor(i / 12) % 10 + 1).cast("int")
    )
    kind = i % 12
    return (
        F.when((kind == 2) & (i % 48 == 38), F.concat(F.lit("diff --git a/"), name))
        .when(kind == 2, F.concat(F.lit("diff --git a/"), name, F.lit(" b/"), name))
        .when(i % 36 == 4, F.concat(F.lit("+++ b/moved/"), name))
        .when(kind == 5, F.concat(F.lit("-"), line))
        .when(kind == 6, F.concat(F.lit("@@ "), line))
        .when(kind == 9, F.concat(F.lit(" "), line))
        .otherwise(F.concat(F.lit("+"), line))
    )


def pull_patches(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").select(
        F.col("doc_id").alias("pr_id"),
        F.array_join(F.transform(_sentences(F.col("text")), _diff_line), "\n").alias("patch_text"),
    )


_NAME = "[" + ", ".join(f"'{n}'" for n in FILE_NAMES) + "][(i // 12) % 10 + 1]"
PULL_FILES = f"""diff_lines AS (
  SELECT pr_id, i,
         CASE WHEN i % 12 = 2 AND i % 48 = 38 THEN 'diff --git a/' || {_NAME}
              WHEN i % 12 = 2 THEN 'diff --git a/' || {_NAME} || ' b/' || {_NAME}
              WHEN i % 36 = 4 THEN '+++ b/moved/' || {_NAME}
              WHEN i % 12 = 5 THEN '-' || line WHEN i % 12 = 6 THEN '@@ ' || line
              WHEN i % 12 = 9 THEN ' ' || line ELSE '+' || line END AS line
  FROM (SELECT doc_id AS pr_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i
        FROM (SELECT doc_id, {SENTENCES} AS ls FROM documents))),
file_lines AS (
  SELECT *, sum(CASE WHEN starts_with(line, 'diff --git ') THEN 1 ELSE 0 END)
              OVER (PARTITION BY pr_id ORDER BY i) AS section
  FROM diff_lines),
named AS (
  SELECT pr_id, section,
         first(line ORDER BY i) AS header,
         last(CASE WHEN starts_with(line, '+++ b/') THEN substr(line, 7) END ORDER BY i)
           FILTER (WHERE starts_with(line, '+++ b/')) AS later
  FROM file_lines WHERE section > 0 GROUP BY pr_id, section),
files AS (
  SELECT pr_id, section, coalesce(later, split_part(header, ' b/', 2)) AS filename
  FROM named WHERE contains(header, ' b/'))"""

# --- pull requests and repositories: customer, nation -----------------------------------------


def pulls(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as pull requests; some have no repository address."""
    return table(spark, folder, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("agent"),
        F.when(F.col("c_custkey") % 11 == 0, F.lit(None).cast("string"))
        .otherwise(
            F.concat(F.lit("https://api.github.com/repos/org/n"),
                     F.col("c_nationkey").cast("string"), F.lit(".git"))
        ).alias("raw_url"),
        F.col("c_name").alias("title"),
    )


def repositories(spark: SparkSession, folder: str) -> DataFrame:
    """Nations as repositories; every seventh is unknown to the table."""
    key = F.col("n_nationkey")
    return table(spark, folder, "nation").select(
        F.when(key % 7 == 6, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("https://github.com/org/n"), key.cast("string")))
        .alias("repo_url"),
        F.when(key % 3 == 0, "Python").when(key % 3 == 1, "Java").alias("language"),
        F.when(key % 4 != 0, key.cast("long") * 10).alias("stars"),
    )


PULLS = """pulls AS (
  SELECT c_custkey AS id, c_mktsegment AS agent, c_name AS title,
         CASE WHEN c_custkey % 11 = 0 THEN NULL
              ELSE 'https://github.com/org/n' || c_nationkey END AS repo_url
  FROM customer),
repositories AS (
  SELECT CASE WHEN n_nationkey % 7 = 6 THEN NULL
              ELSE 'https://github.com/org/n' || n_nationkey END AS repo_url,
         CASE WHEN n_nationkey % 3 = 0 THEN 'Python' WHEN n_nationkey % 3 = 1 THEN 'Java' END
           AS language,
         CASE WHEN n_nationkey % 4 <> 0 THEN CAST(n_nationkey AS BIGINT) * 10 END AS stars
  FROM nation)"""

# --- messages with a year: orders moved by 22 years -------------------------------------------


def yearly_messages(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), (F.year("o_orderdate") + 22).alias("year"),
        (F.col("o_totalprice") % 1000 / 1000).alias("raw_ai_probability"),
    )


MESSAGES = """messages AS (
  SELECT o_orderkey AS key, year(o_orderdate) + 22 AS year,
         (o_totalprice % 1000) / 1000 AS raw_ai_probability
  FROM orders)"""

# --- labelled texts ---------------------------------------------------------------------------


def labelled_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that have a label."""
    return table(spark, folder, "documents").join(
        table(spark, folder, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id"
    ).select("doc_id", "text", "label")


# --- text pairs: a user turn and the assistant's answer ---------------------------------------


def text_pairs(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations")
    users = turns.where(F.col("role") == "user").select(
        "conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("original")
    )
    answers = turns.where(F.col("role") == "assistant").select(
        "conv_id", "turn", F.col("text").alias("sampled")
    )
    return users.join(answers, ["conv_id", "turn"]).select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("pair_id"), "original", "sampled"
    )


PAIRS = """pairs AS (
  SELECT u.conv_id * 1000 + a.turn AS pair_id, u.text AS original, a.text AS sampled
  FROM conversations u JOIN conversations a ON u.conv_id = a.conv_id AND u.turn + 1 = a.turn
  WHERE u.role = 'user' AND a.role = 'assistant')"""

WORDS = "list_filter(regexp_split_to_array({0}, '\\s+'), lambda w: w <> '')"
TOKENS = "regexp_extract_all(lower({0}), '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]')"


def words_sql(column: str) -> str:
    return WORDS.format(column)


def tokens_sql(column: str) -> str:
    return TOKENS.format(column)
