"""A word-pair language model counted on the cluster, and texts scored with it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from hunkmill.functions import exact, pytext
from hunkmill.functions.shape import row_array
from hunkmill.operators.curves import areas
from hunkmill.operators.joins import BROADCAST_BYTES, fits, hot_keys, spread_join
from hunkmill.session import landed, new_shared_path

SMOOTHING = 0.1


# Up to this many pairs the model is sent to all tasks (some 100 MB), beyond it is joined by key.


@dataclass(frozen=True)
class WordPairModel:
    """Counts of a reference corpus.

    pairs:      ctx, tok, n, rank      rank 1 is the most frequent follower; ties share a rank
    contexts:   ctx, total, seen, entropy
    vocabulary: one row, ``words``: distinct tokens plus one for all unknown ones
    """

    pairs: DataFrame
    contexts: DataFrame
    vocabulary: DataFrame
    smoothing: float = SMOOTHING

    def save(self, path: str) -> None:
        """Written once, the tables are read by every later job instead of being counted again."""
        self.pairs.write.mode("overwrite").parquet(f"{path}/pairs")
        self.contexts.write.mode("overwrite").parquet(f"{path}/contexts")
        self.vocabulary.withColumn("smoothing", F.lit(self.smoothing)).write.mode(
            "overwrite"
        ).parquet(f"{path}/vocabulary")

    @staticmethod
    def load(spark: SparkSession, path: str) -> WordPairModel:
        vocabulary = spark.read.parquet(f"{path}/vocabulary")
        return WordPairModel(
            spark.read.parquet(f"{path}/pairs"), spark.read.parquet(f"{path}/contexts"),
            vocabulary.select("words"), vocabulary.first()["smoothing"],
        )

    def landed(self, spark: SparkSession) -> WordPairModel:
        """The same model, counted now and read from the shared folder from here on."""
        path = new_shared_path(spark, "word-pairs")
        self.save(path)
        return WordPairModel.load(spark, path)


def word_pairs(
    texts: DataFrame, keys: Sequence[str] = (), text: str = "text", keep_empty: bool = False
) -> DataFrame:
    """One row per token that has one before it: keys, ctx, tok.

    With ``keep_empty`` a text without such a token gives one row of nulls.
    """
    listed = texts.select(*keys, pytext.tokens(F.col(text)).alias("_t"))
    unfold = F.inline_outer if keep_empty else F.inline
    return listed.select(*keys, unfold(_followed()).alias("ctx", "tok"))


def _followed() -> Column:
    """(ctx, tok) of the tokens ``_t`` that have one before them."""
    size = F.greatest(F.size("_t") - 1, F.lit(0))
    return F.arrays_zip(
        F.slice("_t", F.lit(1), size).alias("ctx"), F.slice("_t", F.lit(2), size).alias("tok")
    )


def fit(texts: DataFrame, text: str = "text", smoothing: float = SMOOTHING) -> WordPairModel:
    """Counts from one pass over the texts; everything else follows from the written counts."""
    listed = texts.select(pytext.tokens(F.col(text)).alias("_t"))
    # A text of one token has no pair, but its token belongs to the vocabulary.
    lone = F.array(F.struct(F.col("_t")[0].alias("ctx"), F.lit(None).cast("string").alias("tok")))
    unfolded = listed.select(
        F.inline(F.when(F.size("_t") == 1, lone).otherwise(_followed())).alias("ctx", "tok")
    )
    counted = landed(
        unfolded.groupBy("ctx", "tok").agg(F.count(F.lit(1)).alias("n")), "word-pair-counts"
    )
    counts = counted.where(F.col("tok").isNotNull())
    seen = counted.select(F.explode(F.array("ctx", "tok")).alias("tok"))
    vocabulary = landed(
        seen.where(F.col("tok").isNotNull()).distinct().agg((F.count(F.lit(1)) + 1).alias("words")),
        "vocabulary-size",
    )
    words = F.lit(vocabulary.first()["words"])
    # Ranks come from the numbers of followers with the same count: per context that is a short
    # list even where a context has millions of followers.
    levels = counts.groupBy("ctx", "n").agg(F.count(F.lit(1)).alias("types"))
    above = Window.partitionBy("ctx").orderBy(F.col("n").desc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranks = levels.select(
        "ctx", "n", (F.coalesce(F.sum("types").over(above), F.lit(0)) + 1).alias("rank")
    )
    pairs = spread_join(
        counts, ranks, ["ctx", "n"], "inner", ["tok"], broadcast_bytes=0
    ).select(
        "ctx", "tok", "n", "rank"
    )
    sums = levels.groupBy("ctx").agg(
        F.sum(F.col("n") * F.col("types")).alias("total"),
        F.sum("types").alias("seen"),
        F.sum(
            F.col("types") * (F.col("n") + smoothing) * F.log(F.col("n") + F.lit(smoothing))
        ).alias("_weighted"),
    )
    mass = F.col("total") + smoothing * words
    unseen = (words - F.col("seen")) * smoothing * F.log(F.lit(smoothing))
    # -sum p*ln(p) with p = (n + k) / mass, over seen and unseen followers together.
    entropy = F.log(mass) - (F.col("_weighted") + unseen) / mass
    contexts = sums.select("ctx", "total", "seen", entropy.alias("entropy"))
    return WordPairModel(pairs, contexts, vocabulary, smoothing)


def score_texts(texts: DataFrame, model: WordPairModel, keys: Sequence[str]) -> DataFrame:
    """Per text: scored tokens, mean log-probability, rank, log-rank and entropy.

    Followers never seen after a context share the rank behind the seen ones. Texts of fewer than
    two tokens have null scores. With a small model the tokens are not shuffled at all. Means do not
    depend on the order of the tokens (``functions.exact``), so texts with the same pairs tie.
    """
    facts = word_pairs(texts, keys, keep_empty=True)
    words = model.vocabulary.select("words").scalar()
    k = model.smoothing
    total, n = F.coalesce("total", F.lit(0)), F.coalesce("n", F.lit(0))
    values = {
        "log_p": F.log((n + k) / (total + k * words)),
        "rank": F.coalesce("rank", F.coalesce("seen", F.lit(0)) + 1),
        # Without any count all words are equally likely.
        "entropy": F.coalesce("entropy", F.log(words.cast("double"))),
    }
    values = {name: F.when(F.col("tok").isNotNull(), value) for name, value in values.items()}
    if fits(model.pairs, BROADCAST_BYTES):  # there are fewer contexts than pairs
        per_token = facts.join(F.broadcast(model.pairs), ["ctx", "tok"], "left").join(
            F.broadcast(model.contexts), "ctx", "left"
        ).withColumns(values)
    else:
        per_token = _score_tokens_by_key(facts, model, keys, values)
    return per_token.groupBy(*keys).agg(
        F.count("tok").alias("scored_tokens"),
        exact.mean(F.col("log_p")).alias("likelihood"),
        F.avg("rank").alias("rank"),
        exact.mean(F.log(F.col("rank").cast("double"))).alias("log_rank"),
        exact.mean(F.col("entropy")).alias("entropy"),
    )


def _score_tokens_by_key(
    facts: DataFrame, model: WordPairModel, keys: Sequence[str], values: dict[str, Column]
) -> DataFrame:
    """Every distinct pair is scored once; the tokens then meet that table in a single join, where
    frequent pairs are dealt out."""
    types = facts.groupBy("ctx", "tok").agg(F.count(F.lit(1)).alias("_uses"))
    hot = hot_keys(types, ["ctx", "tok"], "_uses")
    with_pairs = types.select("ctx", "tok").join(model.pairs, ["ctx", "tok"], "left")
    known = spread_join(with_pairs, model.contexts, ["ctx"], "left", ["tok"], broadcast_bytes=0)
    scored = known.withColumns(values).select("ctx", "tok", *values)
    return spread_join(
        facts, scored, ["ctx", "tok"], "left", list(keys), hot=hot, broadcast_bytes=0
    )


def criteria_long(scored: DataFrame, kept: Sequence[str]) -> DataFrame:
    """(criterion, score): machine text is expected to score higher, so ranks change sign."""
    rows = row_array(
        ["criterion", "score"],
        ["likelihood", F.col("likelihood")], ["rank", -F.col("rank")],
        ["log_rank", -F.col("log_rank")], ["entropy", F.col("entropy")],
    )
    return scored.select(*kept, F.inline(rows))


def baseline_thresholds(
    sides: DataFrame, model: WordPairModel, key: str = "pair_id"
) -> DataFrame:
    """ROC and precision-recall areas of each criterion on (pair, side, label, text) rows."""
    keys = [key, "side"]
    scored = score_texts(sides, model, keys).join(sides.select(*keys, "label"), keys)
    return areas(criteria_long(scored, ["label"]), ["criterion"])
