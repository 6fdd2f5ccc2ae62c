"""Sinks: Parquet, CSV and JSON; nothing goes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkmill.sources import readers
from hunkmill.sources.json_arrays import MARKER

FRAME_BYTES = 1 << 18


def parquet(rows: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    rows.write.mode("overwrite").partitionBy(*partition_by).parquet(path)


def parquet_by_repo(
    rows: DataFrame, path: str
) -> None:
    """One directory per repository, with as many files as its size asks for.

    Rows are brought together by repository and evened out by size at run time, so a repository with
    most of the rows has many writers and small ones do not leave one file per task.
    """
    rows.hint("rebalance", "repo").write.mode("overwrite").partitionBy("repo").parquet(path)


def co_located(rows: DataFrame, path: str, table: str, keys: Sequence[str], buckets: int) -> DataFrame:
    """The rows in ``buckets`` files by the hash of their keys, in order of the keys, as a table.

    Tables with the same number of buckets of the same keys are joined and grouped by them without a
    shuffle. As the files are in order, a filter on the first key reads only the parts that may hold it.
    """
    dealt = rows.repartition(buckets, *keys)
    dealt.write.mode("overwrite").bucketBy(buckets, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def json_documents(rows: DataFrame, path: str, compression: str | None = None, file_rows: int = 0) -> None:
    """One document per line. Compressed files are read by one task each; ``file_rows`` bounds them."""
    rows.write.mode("overwrite").option("maxRecordsPerFile", file_rows).json(path, compression=compression)


def json_arrays(rows: DataFrame, path: str, packed: bool = False) -> None:
    """Each output file is one JSON array, or with ``packed`` a zstandard file of one, which can be cut."""
    def enclosed(batches):
        begun = False
        for batch in batches:
            signs = [","] * batch.num_rows
            if batch.num_rows and not begun:
                signs[0], begun = "[", True
            lines = pc.binary_join_element_wise(pa.array(signs, pa.string()), batch["value"].cast(pa.string()), "")
            yield pa.RecordBatch.from_arrays([lines], ["value"])
        if begun:
            yield pa.RecordBatch.from_arrays([pa.array(["]"])], ["value"])

    def framed(batches):
        codec = pa.Codec("zstd", compression_level=3)
        for batch in enclosed(batches):
            lines = batch["value"].cast(pa.binary()).to_pylist()
            frames = np.cumsum([0, *map(len, lines)])[:-1] // FRAME_BYTES
            cuts = [0, *(np.flatnonzero(np.diff(frames)) + 1).tolist(), len(lines)]
            texts = [b"\n".join([*lines[a:b], b""]) for a, b in zip(cuts, cuts[1:]) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array([codec.compress(t, asbytes=True) for t in texts], pa.binary())], ["value"])

    lines = rows.select(F.to_json(F.struct("*")).alias("value"))
    if packed:
        frames = lines.mapInArrow(framed, "value binary").select(F.col("value").cast("string"))
        frames.write.mode("overwrite").option("lineSep", MARKER).text(path)
    else:
        text_lines(lines.mapInArrow(enclosed, "value string"), path)


def run_summary(summary: DataFrame, path: str) -> None:
    """A one-row summary as a JSON document."""
    summary.coalesce(1).write.mode("overwrite").json(path)


def text_lines(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").text(path)


def land_commits(spark: SparkSession, source: str, path: str, lines: bool = False) -> DataFrame:
    """JSON commits to Parquet, once; later jobs read the splittable copy."""
    readers.commit_documents(spark, source, lines).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)
