"""Commit messages: compare detectors, and follow the machine-like share over the years."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, functions as F

from hunkmill.functions import pytext
from hunkmill.operators import models, pairs, rollups, sampling


def training_texts(
    human: DataFrame,
    machine: DataFrame,
    key: Sequence[str] = ("key",),
    require_enough: bool = False,
    one_line: bool = False,
    max_characters: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Balanced (key, text, label) rows with ``is_test``.

    ``one_line`` gives both sides the same white space and drops repeated texts, so that neither
    the line ends nor copies on both sides of the split tell the classes apart.
    """
    columns = [*key, "text"]
    human, machine = (rows.select(*columns).dropna(subset=["text"]) for rows in (human, machine))
    if one_line:
        human, machine = (
            pairs.distinct_texts(rows.withColumn("text", pytext.one_space(F.col("text"))), key[0])
            for rows in (human, machine)
        )
    rows = sampling.balance_classes(human, machine, key, seed, require_enough)
    if max_characters is not None:
        rows = rows.withColumn("text", F.substring("text", 1, max_characters))
    return sampling.split_by_draw(rows, ["label", *key], seed=seed)


def compare_detectors(texts: DataFrame, key: str = "key", **how) -> DataFrame:
    return models.compare_text_models(texts, key, **how)


def usage_trend(
    messages: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    key: Sequence[str] = ("key",),
    per_year: int | None = None,
    seed: int = 42,
) -> DataFrame:
    """Yearly share of flagged messages, from (key, message, year) rows.

    ``score`` adds ``raw_ai_probability``; it only sees the sampled messages.
    """
    if per_year is not None:
        messages = sampling.sample_per_year(messages, key, per_year, seed)
    return rollups.usage_by_year(rollups.score_messages_by_year(score(messages)))
