"""Numbers dealt to buckets as packed blobs, so that a shuffle moves few rows.

A blob row is (kind, bucket, data): kind 0 is worked on in its bucket, kind 1 is passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

BLOBS = "kind int, bucket long, data binary"
#: Numbers gathered by a task before it deals them: 16 bytes each, held several times while they are sorted.
GATHERED = 1 << 20


def mixed(numbers: np.ndarray, seed: int) -> np.ndarray:
    """Another hash of 64-bit hashes; a global order of its own for each seed."""
    x = (numbers ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(32)


def dealt(rows: np.ndarray, by: str, buckets: int, kind: int = 0) -> pa.RecordBatch:
    """Blob rows of a structured array, by the hash of one of its fields."""
    bucket = (mixed(rows[by], 7) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(rows)]]) if len(rows) else np.zeros(1, np.int64)
    data = [rows[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:])]
    return pa.RecordBatch.from_arrays([
        pa.array(np.full(len(data), kind, np.int32)), pa.array(bucket[cuts[:-1]] if len(data) else np.zeros(0, np.int64)), pa.array(data, pa.binary()),
    ], ["kind", "bucket", "data"])


def in_buckets(rows: DataFrame, partitions: int) -> DataFrame:
    """Each bucket in the partition of its number: as many buckets as partitions, evenly filled."""
    return rows.repartitionById(partitions, F.col("bucket").cast("int")).sortWithinPartitions("bucket")


def bucket_runs(batches: Iterator[pa.RecordBatch], dtype: np.dtype) -> Iterator[tuple[int, np.ndarray | pa.RecordBatch]]:
    """(0, all rows of a bucket) for worked blobs, (1, blob rows as they are) for passed ones."""
    held, at = [], None
    for batch in batches:
        kinds, buckets = batch["kind"].to_numpy(), batch["bucket"].to_numpy()
        if (kinds == 1).any():
            yield 1, batch.filter(pa.array(kinds == 1))
        for kind, bucket, data in zip(kinds, buckets, batch["data"]):
            if kind == 1:
                continue
            if bucket != at and held:
                yield 0, np.concatenate(held)
                held = []
            at = bucket
            held.append(np.frombuffer(data.as_buffer(), dtype))
    if held:
        yield 0, np.concatenate(held)


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """The rows of each group of a stream that is sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch[k].to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in columns)
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for n, (a, b) in enumerate(zip(cuts, cuts[1:])):
            if held and (n or first != last):
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
