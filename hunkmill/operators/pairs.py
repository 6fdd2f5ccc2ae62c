"""Text pairs, copies, corpora preparation and perturbation statistics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hunkmill.functions import exact, pytext
from hunkmill.functions.shape import row_array
from hunkmill.operators.sampling import shuffle_head
from hunkmill.session import landed


def unfold_pairs(documents: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """(pair_id, original, sampled) from two lists of equal length."""
    zipped = F.arrays_zip("original", "sampled")
    return documents.select(*kept, F.posexplode(zipped).alias("pair_id", "pair")).select(
        *kept, "pair_id", "pair.original", "pair.sampled"
    )


def pair_sides(pairs: DataFrame, key: str = "pair_id") -> DataFrame:
    """One row per text: (pair_id, side, label, text)."""
    sides = row_array(
        ["side", "label", "text"],
        ["original", 0, F.col("original")], ["sampled", 1, F.col("sampled")],
    )
    return pairs.select(key, F.inline(sides))


def match_sides(originals: DataFrame, sampled: DataFrame, key: str = "pair_id") -> DataFrame:
    """Original and generated texts brought together by key, not by position."""
    return originals.select(key, F.col("text").alias("original")).join(
        sampled.select(key, F.col("text").alias("sampled")), key
    )


def make_pairs(
    generations: DataFrame, question_answer: bool = False, key: str = "pair_id"
) -> DataFrame:
    """Final pairs from originals and supplied generations, both cut to the shorter one.

    Question-answer originals lose their separator, and their generations end before a second
    question.
    """
    original, sampled = F.col("original"), F.col("sampled")
    if question_answer:
        sampled = pytext.cut_at_occurrence(sampled, "Question:", 2)
        original = pytext.separator_to_space(original)
    rows = generations.select(key, original.alias("original"), sampled.alias("sampled"))
    left, right = pytext.trim_to_shorter(F.col("original"), F.col("sampled"))
    return rows.select(key, left.alias("original"), right.alias("sampled"))


def long_enough(generations: DataFrame, min_words: int = 15) -> DataFrame:
    """Adds ``accepted``: generations with fewer words go back to the generator."""
    return generations.withColumn(
        "accepted", (pytext.word_count(F.col("sampled")) >= min_words).cast("int")
    )


def prompts(texts: DataFrame, count: int = 30, question_answer: bool = False) -> DataFrame:
    """What the generator is given: the first tokens, or the question."""
    text = F.col("text")
    prompt = pytext.before_separator(text) if question_answer else pytext.first_tokens(text, count)
    return texts.withColumn("prompt", prompt)


def copies(texts: DataFrame, count: int) -> DataFrame:
    """Each text ``count`` times, told apart by ``copy_id`` from 1."""
    return texts.withColumn("copy_id", F.explode(F.sequence(F.lit(1), F.lit(count))))


def distinct_texts(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """The first row (by key) of each distinct text.

    Only digests and keys are grouped; the texts are shuffled once, in the semi join.
    """
    first = texts.groupBy(F.sha2(F.col(text), 256).alias("_digest")).agg(F.min(key).alias(key))
    return texts.join(first.select(key), key, "left_semi")


def prepare_corpus(
    texts: DataFrame,
    key: str,
    long_only: bool = False,
    max_tokens: int | None = None,
    head: int | None = None,
    seed: int = 0,
    dedup_after_cleaning: bool = False,
) -> DataFrame:
    """Distinct, one-line, optionally long texts in repeatable random order, not too many tokens.

    ``long_only`` keeps texts of more than 250 words, or all when there are none. Texts equal only
    after cleaning stay, unless ``dedup_after_cleaning``.
    """
    cleaned = distinct_texts(texts, key).withColumn("text", pytext.one_space(F.col("text")))
    if dedup_after_cleaning:
        cleaned = distinct_texts(cleaned, key)
    columns = cleaned.columns
    if long_only or head is not None:  # read several times from here on, mostly without the texts
        counted = cleaned.withColumn("_words", pytext.word_count(F.col("text")))
        cleaned = landed(counted, "clean-texts")
    if long_only:
        is_long = F.col("_words") > 250
        some = cleaned.agg(F.coalesce(F.max(is_long.cast("int")), F.lit(0))).scalar()
        cleaned = cleaned.where(is_long | (some == 0))
    if head is not None:
        cleaned = shuffle_head(cleaned, head, [key], seed)
    if max_tokens is not None:
        cleaned = cleaned.where(pytext.token_count(F.col("text")) <= max_tokens)
    return cleaned.select(columns)


def corpus_stats(texts: DataFrame) -> DataFrame:
    return texts.agg(
        F.count(F.lit(1)).alias("samples"),
        F.avg(pytext.word_count(F.col("text"))).alias("mean_words"),
    )


def distinct_words(pairs: DataFrame) -> DataFrame:
    """The words of both sides, once each."""
    both = F.array("original", "sampled")
    return (
        pairs.select(F.explode(both).alias("text"))
        .select(F.explode(pytext.words(F.col("text"))).alias("word"))
        .distinct()
    )


def fill_dictionary(pairs: DataFrame) -> DataFrame:
    """Sorted distinct words of both sides."""
    return distinct_words(pairs).orderBy("word")


def perturbation_stats(scored: DataFrame, counts: Sequence[int], keys: Sequence[str]) -> DataFrame:
    """Mean and spread of the perturbed scores, for every number of copies at once.

    ``scored`` has ``copy_id`` (from 1) and ``ll``. The spread is that of the population; it is 1
    for a single copy and where all copies score the same. Both are exact sums, equal in any order.
    """
    columns = []
    for n in counts:
        chosen = F.when(F.col("copy_id").between(1, n), F.col("ll"))
        columns += [exact.mean(chosen).alias(f"_mean_{n}"), exact.spread(chosen).alias(f"_sd_{n}")]
    wide = scored.groupBy(*keys).agg(*columns)
    per_count = row_array(
        ["n_perturbations", "perturbed_ll", "perturbed_ll_std"],
        *[
            [n, F.col(f"_mean_{n}"),
             F.when(F.coalesce(F.col(f"_sd_{n}"), F.lit(0.0)) == 0, 1.0).otherwise(F.col(f"_sd_{n}"))]
            for n in counts
        ],
    )
    return wide.select(*keys, F.inline(per_count))


def curvature(base: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Both criteria per text: ``d`` (also the log-likelihood ratio) and ``z``."""
    gap = F.col("ll") - F.col("perturbed_ll")
    criteria = row_array(
        ["criterion", "score"], ["d", gap], ["z", gap / F.col("perturbed_ll_std")]
    )
    return base.join(stats, list(keys)).select(
        *keys, "n_perturbations", "label", F.inline(criteria)
    )


def likelihood_ratio(base: DataFrame, stats: DataFrame, keys: Sequence[str]) -> DataFrame:
    return base.join(stats, list(keys)).select(
        *keys, "n_perturbations", (F.col("ll") - F.col("perturbed_ll")).alias("llr")
    )


