"""Declared schemas of all inputs; nothing is inferred."""

from pyspark.sql import types as T


def _struct(*fields: tuple[str, T.DataType | str]) -> T.StructType:
    schema = T.StructType()
    for name, kind in fields:
        schema = schema.add(name, kind)
    return schema


PULL_REQUESTS = _struct(
    ("id", "long"), ("agent", "string"), ("created_at", "string"), ("repo_url", "string"),
    ("html_url", "string"), ("title", "string"),
)
HUMAN_PULL_REQUESTS = T.StructType([*PULL_REQUESTS.fields, T.StructField("number", T.LongType())])
REPOSITORIES = _struct(
    ("url", "string"), ("full_name", "string"), ("language", "string"), ("stars", "long"),
)
COMMIT_DETAILS = _struct(
    ("pr_id", "long"), ("sha", "string"), ("author", "string"), ("committer", "string"),
    ("message", "string"), ("filename", "string"), ("status", "string"), ("patch", "string"),
)
PATCHES = _struct(("pr_id", "long"), ("patch_text", "string"))

COMMIT_METRICS = _struct(
    ("repo", "string"), ("commit_hash", "string"), ("author_name", "string"),
    ("author_email", "string"), ("committer_name", "string"), ("committer_email", "string"),
    ("author_date", "string"), ("committer_date", "string"), ("message", "string"),
    ("parents", "integer"), ("files", "integer"), ("insertions", "integer"), ("deletions", "integer"),
    ("lines", "integer"), ("hunk_count", "long"), ("added_hunk_lines", "long"),
    ("source_file_count", "long"), ("test_file_count", "long"), ("docs_file_count", "long"),
    ("config_file_count", "long"),
)
HUNK_METRICS = _struct(
    ("repo", "string"), ("commit_hash", "string"), ("author_date", "string"),
    ("filename", "string"), ("file_category", "string"), ("language", "string"),
    ("hunk_index", "integer"), ("line_count", "integer"), ("char_count", "integer"), ("snippet", "string"),
    ("commit_insertions", "integer"), ("commit_deletions", "integer"), ("commit_files", "integer"),
)
MONTHLY_SUMMARY = _struct(
    ("calendar_month", "string"), ("commits", "long"), ("commits_with_allowed_hunks", "long"),
    ("ai_like_commits", "long"), ("mean_ai_line_fraction", "double"),
    ("mean_max_hunk_score", "double"), ("repo", "string"), ("threshold_label", "string"),
    ("commit_ai_fraction", "double"),
)
POOLED_SUMMARY = _struct(
    ("calendar_month", "string"), ("commits", "long"), ("ai_like_commits", "long"),
    ("mean_ai_line_fraction", "double"), ("mean_max_hunk_score", "double"),
    ("threshold_label", "string"), ("commit_ai_fraction", "double"),
)
THRESHOLD_METRICS = _struct(
    ("threshold", "double"), ("accuracy", "double"), ("balanced_accuracy", "double"),
    ("precision", "double"), ("recall", "double"), ("false_positive_rate", "double"),
    ("false_negative_rate", "double"), ("tp", "long"), ("tn", "long"), ("fp", "long"),
    ("fn", "long"),
)
FROZEN_CONFIG = _struct(
    ("threshold", "double"),
    ("allowed_combinations",
     T.ArrayType(_struct(("language", "string"), ("file_category", "string"),
                         ("length_bucket", "string")))),
    ("main_file_categories", T.ArrayType(T.StringType())),
    ("main_languages", T.ArrayType(T.StringType())),
    ("excluded_file_categories", T.ArrayType(T.StringType())),
    ("excluded_length_buckets", T.ArrayType(T.StringType())),
    ("notes", "string"),
)
REPO_SUMMARY = _struct(
    ("repo", "string"), ("commit_rows", "long"), ("hunk_rows", "long"), ("since", "string"),
    ("to", "string"), ("output_dir", "string"),
)

PERSON = _struct(("name", "string"), ("email", "string"))
METHOD = _struct(
    ("name", "string"), ("long_name", "string"), ("start_line", "integer"), ("end_line", "integer"),
    ("complexity", "integer"), ("nloc", "integer"), ("params", T.ArrayType(T.StringType())),
)
CHANGED_METHOD = _struct(
    ("name", "string"), ("long_name", "string"), ("start_line", "integer"), ("end_line", "integer"),
)
LINE_PAIRS = T.ArrayType(T.ArrayType(T.StringType()))
MODIFIED_FILE = _struct(
    ("filename", "string"), ("old_path", "string"), ("new_path", "string"),
    ("change_type", "string"), ("diff", "string"),
    ("diff_parsed", _struct(("added", LINE_PAIRS), ("deleted", LINE_PAIRS))),
    ("added_lines", "integer"), ("deleted_lines", "integer"), ("source_code", "string"),
    ("source_code_before", "string"), ("nloc", "integer"), ("complexity", "integer"),
    ("token_count", "integer"), ("methods", T.ArrayType(METHOD)),
    ("changed_methods", T.ArrayType(CHANGED_METHOD)),
)
COMMIT_DOCUMENT = _struct(
    ("msg", "string"), ("author", PERSON), ("co_authors", T.ArrayType(PERSON)),
    ("committer", PERSON), ("author_date", "string"), ("deletions", "integer"),
    ("insertions", "integer"), ("lines", "integer"), ("files", "integer"), ("hash", "string"),
    ("modified_files", T.ArrayType(MODIFIED_FILE)),
)

RAW_PAIRS = _struct(
    ("original", T.ArrayType(T.StringType())), ("sampled", T.ArrayType(T.StringType())),
)
DOUBLES = T.ArrayType(T.DoubleType())
EXPERIMENT_RESULT = _struct(
    ("name", "string"),
    ("predictions", _struct(("real", DOUBLES), ("samples", DOUBLES))),
    ("info", _struct(("pct_words_masked", "double"), ("span_length", "integer"),
                     ("n_perturbations", "integer"), ("n_samples", "integer"))),
    ("metrics", _struct(("roc_auc", "double"), ("fpr", DOUBLES), ("tpr", DOUBLES))),
    ("pr_metrics", _struct(("pr_auc", "double"), ("precision", DOUBLES), ("recall", DOUBLES))),
    ("loss", "double"),
)
