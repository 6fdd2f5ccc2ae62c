"""Registered queries: every job on the test tables, with the SQL that must give the same rows."""

from hunkmill.catalog.registry import ORACLES, QUERIES
from hunkmill.catalog import (  # noqa: F401  (imported for their registrations)
    corpus_queries, file_queries, hunk_queries, join_queries, metric_queries, model_queries,
    plan_queries, rollup_queries, sampling_queries, text_queries,
)

__all__ = ["ORACLES", "QUERIES"]
