"""Five stages from documents to token files; each is written as Parquet and read by the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkmill.llm import decontamination, jaccard, mixing, quality, token_files
from hunkmill.llm.sized import sent_if_small
from hunkmill.session import apply_settings, landed

#: Target weights of the domains' tokens. Clean tokens stay as many as they are, and a little more, so
#: that documents that are surely clean have rates of 1 and above; the others come down to their weight
#: against clean ones, and are never raised.
WEIGHTS = {"clean": 0.97, "toxic": 0.02, "low": 0.01}
HEADROOM = 1.05
SEED = 11


def _labels(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/labels.parquet")


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules and the forest keep."""
    judge = quality.fit(docs, _labels(spark, sf_dir))
    return quality.judged(docs, judge).where("verdict.kept").drop("verdict")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each class of linked ones.

    Rows are told apart by id and text, so other texts under the same id stay; rows that repeat both are
    one document and stay or go together.
    """
    row = F.xxhash64("doc_id", "text").alias("_row")
    rows = landed(docs.select(row, "doc_id").distinct(), "rows")
    classes = jaccard.jaccard_classes(docs.select(row, "text"), key="_row").select("_row", "component_id").distinct()
    placed = landed(classes.join(rows, "_row"), "placed")
    first = placed.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row"))["_row"].alias("first"))
    others = landed(placed.join(first, "component_id").where("_row <> first").select("_row"), "near-duplicates")
    kept = docs.withColumn("_row", row).join(sent_if_small(others, 8), "_row", "left_anti")
    return kept.select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    leaks = decontamination.find_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    leaking = landed(leaks.select("doc_id").distinct(), "leaking")
    return docs.join(sent_if_small(leaking, 8), docs["doc_id"].eqNullSafe(leaking["doc_id"]), "left_anti").select(docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents drawn by their rates: all with a rate of 1 or more, of others that share."""
    def targets(now: dict[str, float]) -> dict[str, float]:
        clean = HEADROOM * now.get("clean", 0.0)
        return {d: clean if d == "clean" else min(n, clean * WEIGHTS[d] / WEIGHTS["clean"]) for d, n in now.items()}

    rated, _ = mixing.with_rates(docs, mixing.label_domains(_labels(spark, sf_dir)), WEIGHTS, targets_of=targets)
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col("row.doc_id"), F.col("row.text")), F.lit(1 << 30)) / float(1 << 30)
    return rated.where(F.col("rate") > draw).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of what is left, read back: doc_id, start, n_tokens, ids_crc32."""
    return token_files.read_tokens(token_files.write_tokens(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


STAGES = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("without_benchmark", without_benchmark),
    ("mixed", mixed),
    ("token_output", token_output),
]

#: The forest, the fitted rates and the tokenizer are beyond SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, from the documents table."""
    apply_settings(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
