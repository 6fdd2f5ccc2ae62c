"""Broadcasts only behind a check of the size."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

#: Bytes of a table that is sent to every executor, at most.
BROADCAST_BYTES = 32 << 20


def sent_if_small(landed_rows: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """The written table, marked for broadcast if its rows of ``row_bytes`` are within the limit; a
    larger one is joined by shuffle (with Spark's own splitting of skewed keys)."""
    return F.broadcast(landed_rows) if landed_rows.count() * row_bytes <= limit else landed_rows.hint("merge")
