"""Text corpora by name, out of local tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkmill.functions import pytext
from hunkmill.sources import readers


def stories(prompts: DataFrame) -> DataFrame:
    """(line, left = prompt, right = story) to cleaned texts without rejected words.

    Prompt and story stand on lines of their own.

    Cleaning neither makes nor breaks a rejected word, so those texts go before the costly part.
    """
    joined = F.concat(pytext.clean_prompt(F.col("left")), F.lit("\n "), F.col("right"))
    kept = prompts.where(~pytext.has_rejected_word(joined))
    return kept.select(F.col("line").alias("key"), pytext.clean_story(joined).alias("text"))


def questions(rows: DataFrame) -> DataFrame:
    return rows.select(
        "key", pytext.question_answer(F.col("question"), F.col("long_answer")).alias("text")
    )


def translations(rows: DataFrame, language: str) -> DataFrame:
    """One language of a ``translation`` struct or map; texts of 101 to 149 words."""
    text = F.col("translation")[language]
    words = pytext.word_count(F.col("text"))
    return rows.select("key", text.alias("text")).where((words > 100) & (words < 150))


def _stories(spark: SparkSession, folder: str) -> DataFrame:
    return stories(
        readers.aligned_lines(
            spark, f"{folder}/writingPrompts/valid.wp_source",
            f"{folder}/writingPrompts/valid.wp_target",
        )
    )


def _questions(spark: SparkSession, folder: str) -> DataFrame:
    return questions(spark.read.parquet(f"{folder}/pubmed"))


def _translations(language: str):
    return lambda spark, folder: translations(spark.read.parquet(f"{folder}/wmt16"), language)


def _commits(name: str):
    def build(spark: SparkSession, folder: str) -> DataFrame:
        documents = readers.commit_documents(spark, f"{folder}/{name}.json", columns=["hash", "msg"])
        return documents.select(F.col("hash").alias("key"), F.col("msg").alias("text"))

    return build


# The names corpora are asked for by.
CORPORA = {
    "writing": _stories,
    "english": _translations("en"),
    "german": _translations("de"),
    "pubmed": _questions,
    "commits_gpt2": _commits("commits_gpt2"),
    "commits_gpt3": _commits("commits_gpt3"),
}


def load(spark: SparkSession, name: str, folder: str) -> DataFrame:
    """(key, text) of a corpus below ``folder``."""
    if name not in CORPORA:
        raise ValueError(f"unknown corpus {name}; known are {', '.join(CORPORA)}")
    return CORPORA[name](spark, folder)
