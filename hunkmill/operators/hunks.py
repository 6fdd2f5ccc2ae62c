"""Patches and commits to added-code hunks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.functions import files, fixed_values as fv, identity, patch as diff, pytext
from hunkmill.functions.scoring import length_bucket, utc_moment
from hunkmill.operators.joins import spread_join
from hunkmill.operators.sampling import sample_per_language


def explode_hunks(rows: DataFrame, patch: str = "patch") -> DataFrame:
    """One row per added hunk, with its place, text, non-blank lines and characters.

    The patch itself does not go on. Patches that hold no hunk give no row.
    """
    kept = [c for c in rows.columns if c != patch]
    return rows.select(
        *kept, F.posexplode(diff.added_snippets(F.col(patch))).alias("hunk_index", "snippet")
    ).select(
        *kept, "hunk_index", "snippet",
        diff.line_count(F.col("snippet")).alias("line_count"),
        diff.char_count(F.col("snippet")).alias("char_count"),
    )


def split_files(rows: DataFrame, diff_text: str = "patch_text") -> DataFrame:
    """One row per file section of a multi-file diff: ``file_index``, ``filename``, ``patch``."""
    kept = [c for c in rows.columns if c != diff_text]
    sections = rows.select(
        *kept, F.posexplode(diff.file_sections(F.col(diff_text))).alias("file_index", "patch")
    )
    return sections.withColumn("filename", diff.section_filename(F.col("patch"))).where(
        F.col("filename").isNotNull()
    )


CALIBRATION_COLUMNS = [
    "label", "agent", "pr_id", "sha", "repo_url", "repo_full_name", "repo_language", "stars",
    "created_at", "html_url", "title", "filename", "status", "file_category", "language",
    "commit_author", "commit_committer", "commit_message", "hunk_index", "snippet", "line_count",
    "char_count", "length_bucket",
]


def _target_files(rows: DataFrame, languages: Sequence[str], strict: Column | None) -> DataFrame:
    """File filters, all before any patch text is read apart."""
    name = F.col("filename")
    wanted = rows.where(name.isNotNull() & (name != "") & ~files.is_excluded(name))
    if strict is not None:
        wanted = wanted.where(strict)
    return wanted.select(
        *[F.col(c) for c in rows.columns if c != "language"],
        F.col("language").alias("repo_language"),
        files.category(name).alias("file_category"),
        files.language(name, F.col("language")).alias("language"),
    ).where(F.col("language").isin(list(languages)))


def calibration_hunks_ai(
    merged: DataFrame,
    languages: Sequence[str] = fv.TARGET_LANGUAGES,
    drop_bots: bool = True,
) -> DataFrame:
    """Labelled hunks out of commit details joined with pull request and repository."""
    people = None
    if drop_bots:
        people = ~identity.is_bot(F.col("author"), F.col("committer"))
    rows = _target_files(merged, languages, people).withColumnsRenamed(
        {"author": "commit_author", "committer": "commit_committer", "message": "commit_message"}
    )
    return (
        explode_hunks(rows)
        .withColumn("length_bucket", length_bucket(F.col("line_count")))
        .select(*CALIBRATION_COLUMNS)
    )


def calibration_hunks_human(
    pulls: DataFrame,
    repositories: DataFrame,
    patches: DataFrame,
    languages: Sequence[str] = fv.TARGET_LANGUAGES,
    per_language: int | None = 40,
    seed: int = 42,
) -> DataFrame:
    """Labelled hunks out of whole pull-request patches (``pr_id``, ``patch_text``).

    There is no bot filter on this side. ``per_language=None`` takes every pull request.
    """
    known = repositories.where(F.col("repo_url").isNotNull())
    rows = spread_join(pulls, known, ["repo_url"], "left", ["id"])
    if per_language is None:
        rows = rows.where(F.col("language").isin(list(languages))).fillna(0, subset=["stars"])
    else:
        rows = sample_per_language(rows, languages, per_language, ["id"], seed)
    rows = rows.withColumnRenamed("id", "pr_id").join(patches, "pr_id")
    sections = split_files(rows.where(F.length("patch_text") > 0))
    nothing = F.lit(None).cast("string")
    hunks = explode_hunks(_target_files(sections, languages, None))
    return hunks.select(
        *[c for c in hunks.columns if c not in ("status", "sha")],
        nothing.alias("sha"), F.lit("patch").alias("status"),
        nothing.alias("commit_author"), nothing.alias("commit_committer"),
        nothing.alias("commit_message"),
        length_bucket(F.col("line_count")).alias("length_bucket"),
    ).select(*CALIBRATION_COLUMNS)


def union_ai_human(ai: DataFrame, human: DataFrame) -> DataFrame:
    """Both sides, duplicates kept, hunks without a non-blank line dropped."""
    return ai.unionByName(human).where(F.col("line_count") > 0)


def minable_commits(
    commits: DataFrame, since: str | None = None, until: str | None = None
) -> DataFrame:
    """No merges, no bots; with bounds only commits dated within them."""
    rows = commits.where(F.size("parents") <= 1)
    committed = utc_moment(F.col("committer_date").cast("string"))
    if since is not None:
        rows = rows.where(committed >= F.lit(since).cast("timestamp"))
    if until is not None:
        rows = rows.where(committed <= F.lit(until).cast("timestamp"))
    return rows.where(
        ~identity.is_bot(
            F.col("author.name"), F.col("author.email"),
            F.col("committer.name"), F.col("committer.email"),
        )
    )


def file_path() -> Column:
    """New path, else old path, else bare name; empty ones do not count."""
    return F.coalesce(
        *[F.nullif(F.col(f"file.{c}"), F.lit("")) for c in ("new_path", "old_path", "filename")]
    )


def commit_hunks(commits: DataFrame) -> DataFrame:
    """Hunks of (already filtered) commits with nested ``modified_files``."""
    per_file = (
        commits.select(
            "repo", F.col("hash").alias("commit_hash"), "author_date",
            F.col("insertions").alias("commit_insertions"),
            F.col("deletions").alias("commit_deletions"), F.col("files").alias("commit_files"),
            F.posexplode("modified_files").alias("file_index", "file"),
        )
        .withColumn("filename", file_path())
        .where(F.col("filename").isNotNull() & ~files.is_excluded(F.col("filename")))
        .withColumn("file_category", files.category(F.col("filename")))
        .withColumn("language", files.language(F.col("filename")))
        .withColumn("patch", F.col("file.diff"))
        .drop("file")
    )
    return explode_hunks(per_file)


def commit_metrics(commits: DataFrame, hunks: DataFrame) -> DataFrame:
    """Commits with hunk, added-line and per-category file counts; zero where there are none."""
    return (
        commits.select(
            "repo", F.col("hash").alias("commit_hash"),
            F.col("author.name").alias("author_name"), F.col("author.email").alias("author_email"),
            F.col("committer.name").alias("committer_name"),
            F.col("committer.email").alias("committer_email"),
            F.col("author_date").cast("string").alias("author_date"),
            F.col("committer_date").cast("string").alias("committer_date"),
            pytext.escape_newlines(F.col("msg")).alias("message"),
            F.size("parents").alias("parents"), "files", "insertions", "deletions", "lines",
        )
        .join(commit_file_rollup(hunks), ["repo", "commit_hash"], "left")
        .fillna(0, subset=ROLLUP_COUNTS)
    )


ROLLUP_COUNTS = [
    "hunk_count", "added_hunk_lines", "source_file_count", "test_file_count", "docs_file_count",
    "config_file_count",
]


def commit_file_rollup(
    hunks: DataFrame,
    commit_keys: Sequence[str] = ("repo", "commit_hash"),
    file_key: str = "file_index",
) -> DataFrame:
    """Per commit: hunks, added lines, and files of each category that have a hunk.

    First per file, where a huge commit is still spread over its files.
    """
    per_file = hunks.groupBy(*commit_keys, file_key, "file_category").agg(
        F.count(F.lit(1)).alias("hunks"), F.sum("line_count").alias("added")
    )
    return per_file.groupBy(*commit_keys).agg(
        F.sum("hunks").alias("hunk_count"),
        F.sum("added").alias("added_hunk_lines"),
        *[
            F.count_if(F.col("file_category") == name).alias(f"{name}_file_count")
            for name in ("source", "test", "docs", "config")
        ],
    )


def flatten_files(commits: DataFrame) -> DataFrame:
    """One row per commit and modified file; commits without files keep one row."""
    return commits.select(
        "hash", "author_date", F.col("author.name").alias("author_name"),
        F.posexplode_outer("modified_files").alias("file_index", "file"),
    ).select(
        "hash", "author_date", "author_name", "file_index",
        F.col("file.filename").alias("filename"), F.col("file.change_type").alias("change_type"),
        F.col("file.added_lines").alias("added_lines"),
        F.col("file.deleted_lines").alias("deleted_lines"),
        F.col("file.nloc").alias("nloc"), F.col("file.complexity").alias("complexity"),
        F.col("file.token_count").alias("token_count"),
    )


def flatten_methods(commits: DataFrame) -> DataFrame:
    """One row per method of each modified file, flagged when the commit changed it."""
    changed = F.transform(
        "file.changed_methods", lambda m: F.struct(m.long_name, m.start_line, m.end_line)
    )
    return (
        commits.select("hash", F.posexplode("modified_files").alias("file_index", "file"))
        .select(
            "hash", "file_index", F.col("file.filename").alias("filename"),
            changed.alias("changed"), F.explode("file.methods").alias("method"),
        )
        .select(
            "hash", "file_index", "filename", F.col("method.name").alias("name"),
            F.col("method.long_name").alias("long_name"),
            F.col("method.start_line").alias("start_line"),
            F.col("method.end_line").alias("end_line"),
            F.col("method.complexity").alias("complexity"), F.col("method.nloc").alias("nloc"),
            F.size("method.params").alias("param_count"),
            F.array_contains(
                "changed",
                F.struct("method.long_name", "method.start_line", "method.end_line"),
            ).alias("is_changed"),
        )
    )


def flatten_co_authors(commits: DataFrame) -> DataFrame:
    return commits.select("hash", F.explode("co_authors").alias("person")).select(
        "hash", F.col("person.name").alias("name"), F.col("person.email").alias("email")
    )


def flatten_changed_lines(commits: DataFrame) -> DataFrame:
    """Added and deleted lines from the parsed diff, as (side, line, text)."""
    files_ = commits.select("hash", F.posexplode("modified_files").alias("file_index", "file"))

    def side(name: str) -> Column:
        pairs = F.coalesce(f"file.diff_parsed.{name}", F.array().cast("array<array<string>>"))
        return F.transform(
            pairs,
            lambda pair: F.struct(
                F.lit(name).alias("side"), pair[0].try_cast("int").alias("line"),
                pair[1].alias("text"),
            ),
        )

    lines = F.concat(side("added"), side("deleted"))
    return files_.select("hash", "file_index", F.inline(lines))
