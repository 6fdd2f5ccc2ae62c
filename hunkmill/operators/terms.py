"""The most used words and word pairs of a corpus, exactly, without shuffling the rare ones."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.operators.joins import fits
from hunkmill.session import landed

# Words of two or more word characters.
WORD = r"(?U)\b\w\w+\b"
#: Terms that a task counts at a time.
KEPT = 1 << 20
#: Texts whose terms are gathered at once.
GATHERED = 256


def word_list(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _batch_terms(words: pa.ListArray) -> pa.Array:
    """All words of a batch and all pairs of neighbours in a text."""
    flat = words.flatten()
    if len(flat) < 2:
        return flat
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(words), 0)).to_numpy()
    inside = [True] * (len(flat) - 1)
    for end in set(ends.tolist()):
        if 0 < end < len(flat):
            inside[end - 1] = False
    pairs = pc.binary_join_element_wise(flat[:-1], flat[1:], " ").filter(pa.array(inside))
    return pa.concat_arrays([flat, pairs])


def _summed(parts: list[pa.Table]) -> pa.Table:
    return pa.concat_tables(parts).group_by("term").aggregate([("uses", "sum")]).rename_columns(["term", "uses"])


def _sketch(batches):
    """Counts of a task's terms, too low by ``lost`` at most; that comes as the count of null.

    When there are too many terms, as much is taken off all of them as leaves half, so what is dropped
    was used no more often than is lost. Terms stay in Arrow: a task holds ``KEPT`` and what ``GATHERED``
    rows of a batch add at a time.
    """
    kept, lost = pa.table({"term": pa.array([], pa.string()), "uses": pa.array([], pa.int64())}), 0
    parts, size = [kept], 0

    def settled() -> tuple[pa.Table, int]:
        told = _summed(parts)
        if len(told) <= KEPT:
            return told, 0
        uses = told["uses"].to_numpy()
        off = int(np.partition(uses, len(uses) - 1 - KEPT // 2)[len(uses) - 1 - KEPT // 2])
        told = pa.table({"term": told["term"], "uses": pa.array(uses - off)})
        return told.filter(pc.greater(told["uses"], 0)), off

    for batch in batches:
        for at in range(0, batch.num_rows, GATHERED):
            found = pc.value_counts(_batch_terms(batch["words"].slice(at, GATHERED)))
            parts.append(pa.table({"term": found.field("values").cast(pa.string()), "uses": found.field("counts")}))
            size += len(found)
            if size > KEPT // 2:
                kept, off = settled()
                parts, size, lost = [kept], 0, lost + off
    kept, off = settled()
    yield from kept.to_batches(50_000)
    yield pa.RecordBatch.from_arrays([pa.array([None], pa.string()), pa.array([lost + off], pa.int64())], ["term", "uses"])


def _all_terms(listed: DataFrame) -> DataFrame:
    size = F.greatest(F.size("words") - 1, F.lit(0))
    pairs = F.zip_with(F.slice("words", F.lit(1), size), F.slice("words", F.lit(2), size), lambda a, b: F.concat_ws(" ", a, b))
    return listed.select(F.explode(F.concat("words", pairs)).alias("term"))


def top_terms(texts: DataFrame, n: int, text: str = "text") -> DataFrame:
    """(term, uses) of the ``n`` most used words and word pairs, ties in the order of the terms.

    Each task sends the counts of at most ``KEPT`` terms, with a bound for what it has dropped. If any
    was, the terms that can still be among the first are counted anew; they are few, as the use of
    words falls off steeply. Where the bounds decide nothing, all terms are counted.
    """
    listed = texts.select(word_list(F.col(text)).alias("words"))
    sketched = landed(listed.mapInArrow(_sketch, "term string, uses long").groupBy("term").agg(F.sum("uses").alias("uses")), "term-sketch")
    lost = sketched.where("term IS NULL").agg(F.sum("uses")).first()[0] or 0
    known = sketched.where("term IS NOT NULL")
    first = [F.desc("uses"), F.asc("term")]
    if not lost:
        return known.orderBy(*first).limit(n)
    last = known.orderBy(*first).limit(n).agg(F.min("uses").alias("least"), F.count("*").alias("n")).first()
    exact = _all_terms(listed)
    if last.n == n and last.least > lost:
        candidates = landed(known.where(F.col("uses") + lost >= last.least).select("term"), "term-candidates")
        exact = exact.join(F.broadcast(candidates) if fits(candidates) else candidates, "term", "left_semi")
    return exact.groupBy("term").agg(F.count("*").alias("uses")).orderBy(*first).limit(n)
