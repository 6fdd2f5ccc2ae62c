from __future__ import annotations

from pyspark.sql import functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.registry import query, tidy
from hunkmill.functions import files, fixed_values as fv, identity, pytext, scoring
from hunkmill.operators import pairs, rollups
from hunkmill.sources import corpora


# --- URLs, identities, file names -------------------------------------------------------------
def _raw_urls(spark, folder):
    path = F.regexp_replace("url", "^https?://", "")
    kind = F.col("page_id") % 4
    return t.table(spark, folder, "pages").select(
        "page_id",
        F.when(kind == 0, F.concat(F.lit("https://api.github.com/repos/"), path, F.lit(".git")))
        .when(kind == 1, F.concat(F.lit(" https://github.com/"), path, F.lit(".git.git\n")))
        .when(kind == 2, F.col("url")).otherwise("").alias("raw"),
    )


@query(
    "repo_urls",
    """WITH raw AS (
  SELECT page_id, page_id % 4 AS kind, url, regexp_replace(url, '^https?://', '') AS path
  FROM pages)
SELECT page_id, CASE kind WHEN 0 THEN 'https://github.com/' || path
                          WHEN 1 THEN 'https://github.com/' || path || '.git'
                          WHEN 2 THEN url END AS repo_url,
       CASE kind WHEN 0 THEN path WHEN 1 THEN path || '.git' END AS repo_full_name
FROM raw""",
)
def repo_urls(spark, folder):
    return _raw_urls(spark, folder).select(
        "page_id", identity.repo_url(F.col("raw")).alias("repo_url"),
        identity.repo_full_name(F.col("raw")).alias("repo_full_name"),
    )


@query(
    "bot_identities",
    """WITH people AS (
  SELECT c_custkey,
         CASE c_custkey % 5 WHEN 0 THEN c_name || '[BOT]' WHEN 1 THEN 'Dependabot ' || c_name
                            WHEN 2 THEN '' WHEN 3 THEN NULL ELSE c_name END AS author,
         CASE c_custkey % 7 WHEN 0 THEN 'github-Actions' WHEN 1 THEN 'Copi' WHEN 2 THEN 'lot'
                            ELSE 'Ann' END AS committer
  FROM customer)
SELECT c_custkey, CAST(regexp_matches(lower(coalesce(author, '') || ' ' || committer),
  '\\[bot\\]|dependabot|renovate|github-actions|claude|codex|cursor|devin|copilot') AS BIGINT)
  AS is_bot FROM people""",
)
def bot_identities(spark, folder):
    name = F.col("c_name")
    five, seven = F.col("c_custkey") % 5, F.col("c_custkey") % 7
    people = t.table(spark, folder, "customer").select(
        "c_custkey",
        F.when(five == 0, F.concat(name, F.lit("[BOT]")))
        .when(five == 1, F.concat(F.lit("Dependabot "), name))
        .when(five == 2, "").when(five == 4, name).alias("author"),
        F.when(seven == 0, "github-Actions").when(seven == 1, "Copi").when(seven == 2, "lot")
        .otherwise("Ann").alias("committer"),
    )
    return people.select(
        "c_custkey", identity.is_bot(F.col("author"), F.col("committer")).cast("long").alias("is_bot")
    )


_FOLDERS = ["src/", "src/test/", "docs/", "app/docs/", "vendor/", "a/vendor/", ".github/",
            "x\\build\\"]
_ENDINGS = [".py", ".java", ".MD", ".yml", ".Json", ".lock", ".min.js", "", ".tar.gz", "_test.go",
            ".kt", ".hpp", "."]
_PATH = (
    "([" + ", ".join(f"'{x}'" for x in _FOLDERS) + "])[p_partkey % 8 + 1] || "
    "CASE WHEN p_size = 1 THEN 'yarn.lock' WHEN p_size = 2 THEN '.gitignore' "
    "WHEN p_size = 3 THEN 'latest_release' ELSE replace(p_name, ' ', '_') || "
    "([" + ", ".join(f"'{x}'" for x in _ENDINGS) + "])[(p_partkey // 8) % 13 + 1] END"
)


def _paths(spark, folder):
    def pick(values, index):
        return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))

    key = F.col("p_partkey")
    name = (
        F.when(F.col("p_size") == 1, "yarn.lock").when(F.col("p_size") == 2, ".gitignore")
        .when(F.col("p_size") == 3, "latest_release")
        .otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("_")),
                            pick(_ENDINGS, F.floor(key / 8) % 13)))
    )
    return t.table(spark, folder, "part").select(
        "p_partkey", F.concat(pick(_FOLDERS, key % 8), name).alias("filename"),
        F.when(key % 3 == 0, F.lit("Scala")).when(key % 3 == 1, "").alias("repo_language"),
    )


@query(
    "file_columns",
    f"""WITH paths AS (
  SELECT p_partkey, {_PATH} AS filename,
         CASE WHEN p_partkey % 3 = 0 THEN 'Scala' END AS repo_language FROM part),
parsed AS (
  SELECT *, replace(lower(filename), '\\', '/') AS p,
         regexp_extract(lower(split_part(filename, '/', -1)), '^.+(\\.[^.]+)$', 1) AS raw_suffix,
         regexp_extract(split_part(replace(lower(filename), '\\', '/'), '/', -1),
                        '^.+(\\.[^.]+)$', 1) AS suffix,
         split_part(replace(lower(filename), '\\', '/'), '/', -1) AS base FROM paths)
SELECT p_partkey, filename, raw_suffix AS suffix,
       coalesce(map {{'.py': 'Python', '.java': 'Java', '.js': 'JavaScript', '.go': 'Go',
                      '.kt': 'Kotlin', '.hpp': 'C/C++ Header'}}[raw_suffix], repo_language,
                'Unknown') AS language,
       CASE WHEN base = 'yarn.lock' THEN 'lockfile'
            WHEN p LIKE '%/docs/%' OR suffix = '.md' THEN 'docs'
            WHEN p LIKE '%/test/%' OR p LIKE '%test\\_%' ESCAPE '\\'
                 OR p LIKE '%\\_test.%' ESCAPE '\\' THEN 'test'
            WHEN p LIKE '%.github/%' OR suffix IN ('.yml', '.json') THEN 'config'
            ELSE 'source' END AS file_category,
       CAST(base = 'yarn.lock' OR p LIKE '%/vendor/%' OR p LIKE '%/build/%'
            OR p LIKE '%.min.js%' AS BIGINT) AS is_excluded
FROM parsed""",
)
def file_columns(spark, folder):
    name = F.col("filename")
    return _paths(spark, folder).select(
        "p_partkey", "filename", files.suffix(name).alias("suffix"),
        files.language(name, F.col("repo_language")).alias("language"),
        files.category(name).alias("file_category"),
        files.is_excluded(name).cast("long").alias("is_excluded"),
    )


@query(
    "main_filter",
    f"""WITH {t.HUNKS}, {t.MAIN_HUNKS}
SELECT language, file_category, length_bucket, count(*) AS hunks,
       CAST(sum(line_count) AS BIGINT) AS lines FROM main_hunks GROUP BY ALL""",
)
def main_filter(spark, folder):
    kept = rollups.main_hunks(t.hunks(spark, folder))
    return kept.groupBy("language", "file_category", "length_bucket").agg(
        F.count(F.lit(1)).alias("hunks"), F.sum("line_count").alias("lines")
    )


@query(
    "calendar_columns",
    """SELECT event_id, strftime(ts, '%Y-%m') AS calendar_month, CAST(year(ts) AS BIGINT) AS year,
       coalesce(TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS DOUBLE), 0) AS number,
       CASE WHEN event_type = 'click' THEN 0.0::DOUBLE ELSE floor(value) END AS coerced
FROM events""",
)
def calendar_columns(spark, folder):
    moment = scoring.utc_moment(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"))
    text = F.when(F.col("event_type") == "click", "n/a").otherwise(
        F.concat(F.lit("["), F.floor("value").cast("string"), F.lit("]"))
    )
    return t.table(spark, folder, "events").select(
        "event_id", scoring.calendar_month(moment).alias("calendar_month"),
        F.year(moment).cast("long").alias("year"),
        scoring.plain_number(F.regexp_extract("props", r"(\d+)", 1)).alias("number"),
        scoring.plain_number(text).alias("coerced"),
    )


# --- text preparation -------------------------------------------------------------------------
def _documents(spark, folder):
    return t.table(spark, folder, "documents").select("doc_id", "text")


_WORDS = t.words_sql("text")


@query(
    "story_cleanup",
    """WITH raw AS (
  SELECT doc_id, '[ WP ]' || chr(10) || ' ' || replace(replace(replace(text, ',', ' ,'), '. ', ' . '), chr(10),
                                     '<newline> ') || ' ( i''m `` it '' was ''''n''t ' AS text
  FROM documents),
tagged AS (SELECT doc_id, replace(replace(text, '[ WP ]', ''), '[ OT ]', '') AS x FROM raw),
"""
    + ",\n".join(
        "s{0} AS (SELECT doc_id, replace(x, {1}, {2}) AS x FROM {3})".format(
            i, *["'" + v.replace("'", "''") + "'" for v in pair], "tagged" if i == 0 else f"s{i - 1}"
        )
        for i, pair in enumerate(fv.STORY_REPLACEMENTS)
    )
    + f"""
SELECT doc_id, md5(trim(x, ' ' || chr(10))) AS text_md5, length(trim(x, ' ' || chr(10))) AS n_chars
FROM s{len(fv.STORY_REPLACEMENTS) - 1}
WHERE NOT contains(x, 'nsfw') AND NOT contains(x, 'NSFW')""",
)
def story_cleanup(spark, folder):
    spaced = F.replace(F.col("text"), F.lit(","), F.lit(" ,"))
    spaced = F.replace(spaced, F.lit(". "), F.lit(" . "))
    spaced = F.replace(spaced, F.lit("\n"), F.lit("<newline> "))
    raw = F.concat(spaced, F.lit(" ( i'm `` it ' was ''n't "))
    rows = _documents(spark, folder).select(
        F.col("doc_id").alias("line"), F.lit("[ WP ]").alias("left"), raw.alias("right")
    )
    return tidy(corpora.stories(rows).select(
        F.col("key").alias("doc_id"), F.md5("text").alias("text_md5"),
        F.length("text").alias("n_chars"),
    ))


@query(
    "one_line_texts",
    f"""SELECT doc_id, md5(array_to_string({_WORDS}, ' ')) AS text_md5, len({_WORDS}) AS words,
       len({t.tokens_sql('text')}) AS tokens FROM documents""",
)
def one_line_texts(spark, folder):
    text = F.col("text")
    return tidy(_documents(spark, folder).select(
        "doc_id", F.md5(pytext.one_space(text)).alias("text_md5"),
        pytext.word_count(text).alias("words"), pytext.token_count(text).alias("tokens"),
    ))


@query(
    "dedup_texts",
    "SELECT min(doc_id) AS doc_id, md5(text) AS text_md5 FROM documents GROUP BY text",
)
def dedup_texts(spark, folder):
    rows = pairs.distinct_texts(_documents(spark, folder), "doc_id")
    return rows.select("doc_id", F.md5("text").alias("text_md5"))


_PREPARED = f"""firsts AS (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text),
cleaned AS (SELECT doc_id, array_to_string({_WORDS}, ' ') AS text FROM firsts),
lengthy AS (SELECT * FROM cleaned WHERE len({_WORDS}) > 250),
chosen AS (SELECT * FROM lengthy
           UNION ALL SELECT * FROM cleaned WHERE NOT EXISTS (SELECT 1 FROM lengthy)),
shuffled AS (SELECT *, row_number() OVER (ORDER BY md5(concat_ws('|', '0', doc_id))) AS place
             FROM chosen),
prepared AS (SELECT * FROM shuffled)"""


@query(
    "prepare_corpus",
    f"WITH {_PREPARED} SELECT doc_id, md5(text) AS text_md5 FROM prepared",
)
def prepare_corpus(spark, folder):
    rows = pairs.prepare_corpus(_documents(spark, folder), "doc_id", long_only=True)
    return rows.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "corpus_stats",
    f"""SELECT count(*) AS samples, round(avg(len({_WORDS})), 9) AS mean_words FROM documents""",
)
def corpus_stats(spark, folder):
    return tidy(pairs.corpus_stats(_documents(spark, folder)))


@query(
    "translation_corpus",
    f"""SELECT doc_id AS key, md5(text) AS text_md5 FROM documents
WHERE lang = 'de' AND len({_WORDS}) > 100 AND len({_WORDS}) < 150""",
)
def translation_corpus(spark, folder):
    rows = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("key"), F.create_map("lang", "text").alias("translation")
    )
    texts = corpora.translations(rows, "de")
    return texts.select("key", F.md5("text").alias("text_md5"))


@query(
    "question_corpus",
    """SELECT doc_id AS key,
       md5('Question: ' || lang || ' Answer:<<<SEP>>>' || text) AS text_md5,
       'Question: ' || lang || ' Answer:' AS question,
       md5('Question: ' || lang || ' Answer: ' || text) AS original_md5 FROM documents""",
)
def question_corpus(spark, folder):
    rows = t.table(spark, folder, "documents").select(
        F.col("doc_id").alias("key"), F.col("lang").alias("question"),
        F.col("text").alias("long_answer"),
    )
    text = F.col("text")
    return corpora.questions(rows).select(
        "key", F.md5(text).alias("text_md5"), pytext.before_separator(text).alias("question"),
        F.md5(pytext.separator_to_space(text)).alias("original_md5"),
    )


@query(
    "cut_texts",
    """SELECT doc_id, md5(CASE WHEN len(string_split(text, 'the')) > 2
                THEN array_to_string(string_split(text, 'the')[1:2], 'the') ELSE text END) AS cut_md5,
       md5(array_to_string(string_split(text, ' ')[1:len(string_split(text, ' ')) - 1], ' '))
         AS dropped_md5,
       md5(substr(text, 1, 512)) AS head_md5,
       CAST(length(trim(text, ' ' || chr(10))) > 5 AS BIGINT) AS is_long
FROM documents""",
)
def cut_texts(spark, folder):
    text = F.col("text")
    return _documents(spark, folder).select(
        "doc_id", F.md5(pytext.cut_at_occurrence(text, "the", 2)).alias("cut_md5"),
        F.md5(pytext.drop_last_word(text)).alias("dropped_md5"),
        F.md5(F.substring(text, 1, 512)).alias("head_md5"),
        (F.length(pytext.strip(text)) > 5).cast("long").alias("is_long"),
    )


@query(
    "prompt_prefixes",
    """SELECT doc_id, array_to_string(
  regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_\\s]')[1:30], ' ') AS prompt
FROM documents""",
)
def prompt_prefixes(spark, folder):
    return pairs.prompts(_documents(spark, folder)).select("doc_id", "prompt")


# --- pairs ------------------------------------------------------------------------------------
_SHORTER = """list_min([len(string_split(original, ' ')), len(string_split(sampled, ' '))])"""


@query(
    "make_pairs",
    f"""WITH {t.PAIRS}
SELECT pair_id, md5(array_to_string(string_split(original, ' ')[1:{_SHORTER}], ' ')) AS original_md5,
       md5(array_to_string(string_split(sampled, ' ')[1:{_SHORTER}], ' ')) AS sampled_md5
FROM pairs""",
)
def make_pairs(spark, folder):
    made = pairs.make_pairs(t.text_pairs(spark, folder))
    return made.select(
        "pair_id", F.md5("original").alias("original_md5"), F.md5("sampled").alias("sampled_md5")
    )


@query(
    "accepted_generations",
    f"""WITH {t.PAIRS}
SELECT pair_id, CAST(len({t.words_sql('sampled')}) >= 30 AS BIGINT) AS accepted FROM pairs""",
)
def accepted_generations(spark, folder):
    return tidy(pairs.long_enough(t.text_pairs(spark, folder), 30).select("pair_id", "accepted"))


@query(
    "unfold_pairs",
    f"""WITH {t.PAIRS}, placed AS (
  SELECT pair_id // 1000 AS conv_id, original, sampled,
         row_number() OVER (PARTITION BY pair_id // 1000 ORDER BY pair_id) - 1 AS pair_id FROM pairs)
SELECT conv_id, pair_id, md5(original) AS original_md5, md5(sampled) AS sampled_md5 FROM placed""",
)
def unfold_pairs(spark, folder):
    ordered = F.array_sort(F.collect_list(F.struct("pair_id", "original", "sampled")))
    documents = t.text_pairs(spark, folder).groupBy(
        F.floor(F.col("pair_id") / 1000).alias("conv_id")
    ).agg(ordered.alias("o")).select(
        "conv_id", F.transform("o", lambda x: x["original"]).alias("original"),
        F.transform("o", lambda x: x["sampled"]).alias("sampled"),
    )
    return tidy(pairs.unfold_pairs(documents, ["conv_id"]).select(
        "conv_id", "pair_id", F.md5("original").alias("original_md5"),
        F.md5("sampled").alias("sampled_md5"),
    ))


@query(
    "perturbation_copies",
    """SELECT doc_id, copy_id, md5(text) AS text_md5
FROM documents, (SELECT unnest(range(1, 11)) AS copy_id)""",
)
def perturbation_copies(spark, folder):
    return tidy(pairs.copies(_documents(spark, folder), 10).select(
        "doc_id", "copy_id", F.md5("text").alias("text_md5")
    ))


@query(
    "fill_dictionary",
    f"""WITH {t.PAIRS}
SELECT DISTINCT word FROM (
  SELECT unnest({t.words_sql('original')}) AS word FROM pairs
  UNION ALL SELECT unnest({t.words_sql('sampled')}) FROM pairs) ORDER BY word""",
)
def fill_dictionary(spark, folder):
    return pairs.fill_dictionary(t.text_pairs(spark, folder))
