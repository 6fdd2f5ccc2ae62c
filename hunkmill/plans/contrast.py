"""Zero-shot contrast: does the likelihood drop when a text is perturbed?"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hunkmill.operators import corpus, curves, pairs, perturb
from hunkmill.operators.corpus import WordPairModel
from hunkmill.session import landed

KEYS = ["pair_id", "side"]


def fill_index(text_pairs: DataFrame) -> DataFrame:
    """The numbered words of the texts, landed."""
    return landed(perturb.dictionary_index(pairs.distinct_words(text_pairs)), "fill-words")


def pre_perturb(text_pairs: DataFrame, share: float, span: int = 5, seed: int = 0) -> DataFrame:
    """Only the generated side is perturbed, with the number of spans rounded up."""
    sampled = text_pairs.select("pair_id", F.col("sampled").alias("text"))
    index = fill_index(text_pairs)
    changed = perturb.random_fill(
        sampled, index, ["pair_id"], span=span, share=share, round_up=True, seed=seed
    )
    return text_pairs.select("pair_id", "original").join(
        changed.withColumnRenamed("text", "sampled"), "pair_id"
    )


def curvature_scores(
    text_pairs: DataFrame,
    model: WordPairModel,
    counts: Sequence[int] = (1, 10),
    span: int = 2,
    buffer: int = 1,
    share: float = 0.3,
    rounds: int = 1,
    seed: int = 0,
) -> DataFrame:
    """(name, label, score) for every number of copies and both criteria.

    Copies are made once, for the largest number; smaller numbers use the first of them. The words
    to fill in come from the texts themselves.
    """
    sides = pairs.pair_sides(text_pairs)
    copied = pairs.copies(sides.drop("label"), max(counts))
    changed = perturb.perturb_rounds(
        copied, fill_index(text_pairs), [*KEYS, "copy_id"], rounds, seed,
        span=span, buffer=buffer, share=share,
    )
    # The texts themselves are copy 0, so all is scored at once; the copies are costly to make.
    every = sides.select(*KEYS, "text", F.lit(0).alias("copy_id"))
    every = landed(every.unionByName(changed.select(*every.columns)), "perturbed")
    scores = corpus.score_texts(every, model, [*KEYS, "copy_id"])
    scores = landed(scores.select(*KEYS, "copy_id", F.col("likelihood").alias("ll")), "copy-scores")
    stats = pairs.perturbation_stats(scores.where("copy_id > 0"), counts, KEYS)
    label = (F.col("side") == "sampled").cast("int").alias("label")
    scored = pairs.curvature(scores.where("copy_id = 0").select(*KEYS, "ll", label), stats, KEYS)
    name = F.concat_ws("_", F.lit("perturbation"), "n_perturbations", "criterion")
    return scored.select(name.alias("name"), "label", "score")


def experiments(
    text_pairs: DataFrame, model: WordPairModel, counts: Sequence[int] = (1, 10), **how
) -> DataFrame:
    """Areas and loss of every experiment: four baselines, then the perturbation ones."""
    baselines = corpus.baseline_thresholds(pairs.pair_sides(text_pairs), model).withColumn(
        "name", F.concat("criterion", F.lit("_threshold"))
    )
    contrasts = curves.areas(curvature_scores(text_pairs, model, counts, **how), ["name"])
    return baselines.select(contrasts.columns).unionByName(contrasts)
