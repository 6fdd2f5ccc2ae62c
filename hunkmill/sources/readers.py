"""Readers: Parquet, CSV, JSON and text files with declared schemas."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql import types as T

from hunkmill import schemas
from hunkmill.functions import identity
from hunkmill.functions.pytext import strip
from hunkmill.functions.scoring import calendar_month, not_nan, utc_moment
from hunkmill.session import existing, landed  # noqa: F401  (``existing`` is part of this module)
from hunkmill.sources import json_arrays

PULL_COLUMNS = ["id", "agent", "created_at", "repo_url", "html_url", "title"]


def _pulls(rows: DataFrame, columns: Sequence[str], label: int) -> DataFrame:
    return rows.select(*columns).withColumns({
        "label": F.lit(label),
        "repo_url": identity.repo_url(F.col("repo_url")),
        "repo_full_name": identity.repo_full_name(F.col("repo_url")),
    })


def ai_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    return _pulls(spark.read.schema(schemas.PULL_REQUESTS).parquet(path), PULL_COLUMNS, 1)


def human_pull_requests(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.HUMAN_PULL_REQUESTS).parquet(path)
    return _pulls(rows, [*PULL_COLUMNS, "number"], 0)


def repositories(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(schemas.REPOSITORIES).parquet(path)
    return rows.select(identity.repo_url(F.col("url")).alias("repo_url"), "language", "stars")


def commit_details(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.COMMIT_DETAILS).parquet(path)


def pull_request_patches(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PATCHES).parquet(path)


def calibration_sample(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).where(F.length("snippet") > 0)


def mined_commits(spark: SparkSession, path: str, repos: Sequence[str] | None = None) -> DataFrame:
    """All repositories are one table partitioned by ``repo``; unwanted ones are not opened."""
    rows = spark.read.schema(schemas.COMMIT_METRICS).parquet(path)
    if repos is not None:
        rows = rows.where(F.col("repo").isin(list(repos)))
    return rows.withColumn("calendar_month", calendar_month(utc_moment(F.col("author_date"))))


def mined_hunks(spark: SparkSession, path: str, repos: Sequence[str] | None = None) -> DataFrame:
    rows = spark.read.schema(schemas.HUNK_METRICS).parquet(path)
    return rows if repos is None else rows.where(F.col("repo").isin(list(repos)))


def co_located(
    spark: SparkSession, path: str, table: str, schema: T.StructType, keys: Sequence[str], buckets: int
) -> DataFrame:
    """A table that ``writers.co_located`` has written, also from another session: its buckets are told
    to Spark again."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
    by = ", ".join(f"`{k}`" for k in keys)
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {table} ({columns}) USING parquet "
        f"CLUSTERED BY ({by}) SORTED BY ({by}) INTO {buckets} BUCKETS LOCATION '{path}'"
    )
    return spark.table(table)


def scored_hunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("prob_ai", not_nan(F.col("prob_ai")))


def csv_columns(
    spark: SparkSession, path: str | Sequence[str], header: Sequence[str], wanted: Sequence[str]
) -> DataFrame:
    """Some columns of CSV files, all as text, with quoted line breaks and doubled quotes.

    ``header`` lists the file's columns in order. Rows with too few or too many fields are kept
    (missing fields are null); dropping them would lose rows.
    """
    schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    reader = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    return reader.csv(path).select(*wanted)


def csv_and_quarantine(
    spark: SparkSession, path: str | Sequence[str], header: Sequence[str], has_header: bool = True
) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files with as many fields as the header, and the raw lines of all others.

    Both come out of one pass, which is written: ``line`` is the text of a record with too few or too
    many fields, of which nothing is lost, and ``fields`` what could be read of it.
    """
    columns = [T.StructField(name, T.StringType()) for name in [*header, "_line"]]
    reader = spark.read.schema(T.StructType(columns)).option("header", has_header).option("mode", "PERMISSIVE")
    reader = reader.option("multiLine", True).option("escape", '"').option("enforceSchema", True)
    read = landed(reader.option("columnNameOfCorruptRecord", "_line").csv(path), "csv-records")
    kept = read.where(F.col("_line").isNull()).drop("_line")
    apart = read.where(F.col("_line").isNotNull())
    return kept, apart.select(F.col("_line").alias("line"), F.array_compact(F.array(*header)).alias("fields"))


def summary_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("escape", '"').csv(path)


def dated_messages(
    rows: DataFrame, message: str, date: str, first_year: int | None = None,
    last_year: int | None = None,
) -> DataFrame:
    """(message, year) of rows that have both, within the years if any are given."""
    dated = (
        rows.select(F.col(message).alias("message"), F.col(date).alias("_date"))
        .dropna()
        .select("message", F.year(utc_moment(F.col("_date"))).alias("year"))
        .dropna(subset=["year"])
    )
    for bound, inside in ((first_year, F.col("year") >= first_year if first_year else None),
                          (last_year, F.col("year") <= last_year if last_year else None)):
        dated = dated.where(inside) if bound else dated
    return dated


def commit_documents(
    spark: SparkSession, path: str, lines: bool = False, columns: Sequence[str] | None = None,
    packed: bool = False,
) -> DataFrame:
    """Nested commits out of JSON arrays, or with ``lines`` out of one document per line.

    Both are read by as many tasks as their size asks for, also where all is one array. Out of arrays,
    documents are parsed and written here; ``columns`` names those that are needed.
    """
    schema = schemas.COMMIT_DOCUMENT
    if columns is not None:
        schema = T.StructType([schema[name] for name in columns])
    if lines:
        return spark.read.schema(schema).json(path)
    return json_arrays.objects(spark, path, schema, packed).select("document.*")


def messages_of(documents: DataFrame) -> DataFrame:
    return documents.select("hash", F.col("msg").alias("text"))


def raw_pair_documents(spark: SparkSession, pattern: str, lines: bool = False) -> DataFrame:
    """Result documents matching a glob that parse and have generated texts, with their path.

    ``lines``: one document per line instead of one per file.
    """
    schema = T.StructType([*schemas.RAW_PAIRS.fields,
                           T.StructField("_corrupt_record", T.StringType())])
    rows = (
        spark.read.schema(schema).option("multiLine", not lines).option("mode", "PERMISSIVE")
        .json(pattern)
        .withColumn("path", F.col("_metadata.file_path"))
    )
    return rows.where(F.col("_corrupt_record").isNull() & F.col("sampled").isNotNull()).drop(
        "_corrupt_record"
    )


def generated_texts(documents: DataFrame, min_length: int = 5) -> DataFrame:
    """Generated texts longer than ``min_length`` characters once trimmed."""
    return documents.select(
        "path", F.posexplode("sampled").alias("position", "text")
    ).where(F.length(strip(F.col("text"))) > min_length)


def experiment_results(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.schema(schemas.EXPERIMENT_RESULT).option("multiLine", True).json(pattern)


def frozen_config(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.FROZEN_CONFIG).option("multiLine", True).json(path)


def repo_summaries(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.schema(schemas.REPO_SUMMARY).option("multiLine", True).json(pattern)


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines of text files, in order of path, with their number from 0.

    Lines are counted per file block; a block's first number is the sum of the blocks before it, those
    of earlier files included.
    Only that short table (one row per block) is ordered.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("id"),
    )
    blocks = lines.groupBy("file", "block").agg(
        F.count(F.lit(1)).alias("lines"), F.min("id").alias("first_id")
    )
    before = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "file", "block", "first_id", F.coalesce(F.sum("lines").over(before), F.lit(0)).alias("start")
    )
    return lines.join(starts, ["file", "block"]).select(
        (F.col("start") + F.col("id") - F.col("first_id")).alias("line"), "value"
    )


def aligned_lines(spark: SparkSession, left: str, right: str) -> DataFrame:
    """Two files line by line, as far as both go."""
    return numbered_lines(spark, left).withColumnRenamed("value", "left").join(
        numbered_lines(spark, right).withColumnRenamed("value", "right"), "line"
    )
