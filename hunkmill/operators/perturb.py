"""Masks, fills and random replacements in texts.

Places are drawn per text from the text's own key, so any task can redo its share. A text of T
pieces costs T digests and one short sort; nothing is tried and rejected.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkmill.functions import fixed_values as fv, pytext
from hunkmill.functions.draws import bucket_of, drawn_below, order_key, order_text, unit_draw
from hunkmill.functions.shape import let
from hunkmill.operators.joins import BROADCAST_BYTES
from hunkmill.session import landed


def span_count(
    pieces: Column, span: int, buffer: int, share: float, round_up: bool = False
) -> Column:
    """How many spans to mask: ``share * pieces / (span + 2 * buffer)``, and no more than fit.

    Starts lie in ``0 .. pieces - span - 1`` and at least ``span + buffer`` apart.
    """
    exact = F.lit(share) * pieces / (span + 2 * buffer)
    wanted = (F.ceil(exact) if round_up else F.floor(exact)).cast("int")
    fitting = F.floor((pieces - span - 1) / (span + buffer)).cast("int") + 1
    return F.when(pieces > span, F.least(wanted, fitting)).otherwise(0)


def random_starts(digest: Column, pieces: Column, n: Column, span: int, buffer: int) -> Column:
    """``n`` sorted starts, every valid arrangement equally likely.

    Drawing n distinct slots out of a range shortened by the room the spans need, and stretching
    the sorted slots again, gives starts that keep their distance.
    """
    stretch = span + buffer - 1
    slots = pieces - span - (n - 1) * stretch

    def ordered(prefix: Column) -> Column:
        # Not array_sort, which asks a lambda for every comparison.
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), slots - 1),
                lambda s: F.struct(
                    F.md5(F.concat(prefix, s.cast("string"))).alias("h"), s.alias("s")
                ),
            )
        )

    first = F.slice(let(F.concat(digest, F.lit("|")), ordered), F.lit(1), n)
    chosen = F.sort_array(F.transform(first, lambda x: x["s"]))
    spread = F.transform(chosen, lambda slot, i: (slot + i * stretch).cast("int"))
    return F.when(n > 0, spread).otherwise(F.array().cast("array<int>"))


def splice(pieces: Column, starts: Column, span: int, inserts: Column) -> Column:
    """Text in which the i-th span of pieces is replaced by the i-th insert.

    Linear in the pieces: the text is cut into what lies between the spans, each part followed by
    its insert.
    """

    def build(row: Column) -> Column:
        begins = F.concat(F.array(F.lit(0)), F.transform(row["starts"], lambda s: s + span))
        ends = F.concat(row["starts"], F.array(F.size(row["pieces"])))
        parts = F.transform(
            F.arrays_zip(begins.alias("begin"), ends.alias("end"), row["inserts"].alias("insert")),
            lambda part: F.concat(
                F.slice(row["pieces"], part["begin"] + 1, part["end"] - part["begin"]),
                F.array_compact(F.array(part["insert"])),
            ),
        )
        return F.array_join(F.flatten(parts), " ")

    none = F.array().cast("array<string>")
    row = F.struct(
        pieces.alias("pieces"), starts.alias("starts"), F.coalesce(inserts, none).alias("inserts")
    )
    return let(row, build)


def choose_spans(
    texts: DataFrame,
    keys: Sequence[str],
    span: int = 2,
    buffer: int = 1,
    share: float = 0.3,
    round_up: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Adds ``pieces`` (split at single spaces) and the sorted span ``starts``."""
    return (
        texts.withColumn("pieces", pytext.space_pieces(F.col("text")))
        .withColumn("_digest", order_key(seed, *[F.col(k) for k in keys]))
        .withColumn("_n", span_count(F.size("pieces"), span, buffer, share, round_up))
        .withColumn(
            "starts",
            random_starts(F.col("_digest"), F.size("pieces"), F.col("_n"), span, buffer),
        )
        .drop("_digest", "_n")
    )


def mask_spans(
    texts: DataFrame,
    keys: Sequence[str],
    span: int = 2,
    buffer: int = 1,
    share: float = 0.3,
    round_up: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Adds ``masked`` with numbered marks in place of the spans, and their number."""
    chosen = choose_spans(texts, keys, span, buffer, share, round_up, seed)
    marks = F.transform(
        "starts", lambda _, i: F.concat(F.lit(fv.MASK_PREFIX), i.cast("string"), F.lit(">"))
    )
    return chosen.select(
        *texts.columns,
        splice(F.col("pieces"), F.col("starts"), span, marks).alias("masked"),
        F.size("starts").alias("mask_count"),
    )


def dictionary_index(words: DataFrame) -> DataFrame:
    """Distinct words numbered from 0 without a global sort: (word, idx).

    Words fall into 4,096 even buckets by digest and are numbered inside them. Which number a word
    has does not matter, as words are drawn evenly. They are written once, as cutting them out of all
    texts is what costs.
    """
    distinct = landed(words.select("word").distinct(), "distinct-words")
    placed = distinct.withColumn("_bucket", bucket_of(F.md5("word"), digits=3))
    sizes = placed.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_words"))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(
        "_bucket", F.coalesce(F.sum("_words").over(before), F.lit(0)).alias("_offset")
    )
    inside = Window.partitionBy("_bucket").orderBy("word")
    return placed.join(F.broadcast(offsets), "_bucket").select(  # at most 4,096 rows
        "word", (F.col("_offset") + F.row_number().over(inside) - 1).alias("idx")
    )


def _numbers(keys: Sequence[str], seed: int, total: int, span: int) -> Column:
    """The numbers of the words for all of a text's ``starts``, ``span`` after each other for each."""
    # j steps never come back to the start, so the words of one place are distinct.
    widest = max((total - 1) // (span - 1), 1) if span > 1 else 1

    def drawn(place: Column) -> Column:
        first = F.floor(unit_draw(F.md5(F.concat(place, F.lit("a")))) * total)
        if span == 1:
            return F.array(first)
        step = 1 + F.floor(unit_draw(F.md5(F.concat(place, F.lit("b")))) * widest)
        return let(F.struct(first.alias("first"), step.alias("step")), lambda at: F.array(
            *[(at["first"] + j * at["step"]) % total for j in range(span)]
        ))

    def places(text: Column) -> Column:
        of_place = lambda _, i: let(F.md5(F.concat(text, i.cast("string"))), drawn)
        return F.flatten(F.transform("starts", of_place))

    return let(F.concat(order_text(seed, *[F.col(k) for k in keys]), F.lit("|")), places)


def _words_at_hand(chosen: DataFrame, index: DataFrame, numbers: Column, span: int) -> DataFrame:
    """Adds ``_fills``, the words for each of a text's ``starts``, out of a short dictionary that every
    task has.

    Numbers are drawn by Spark; only they go to Python, where whole batches are looked up at once.
    """
    words = index.orderBy("idx").select("word").toArrow()["word"].combine_chunks()

    @F.arrow_udf("array<string>")
    def looked_up(drawn: pa.Array) -> pa.Array:
        found = words.take(drawn.flatten())
        places = pc.fill_null(pc.list_value_length(drawn), 0).to_numpy() // span
        fills = pa.ListArray.from_arrays(np.arange(0, len(found) + 1, span, dtype=np.int32), found)
        ends = np.concatenate([[0], np.cumsum(places)]).astype(np.int32)
        return pa.ListArray.from_arrays(ends, pc.binary_join(fills, " "))

    return chosen.withColumn("_numbers", numbers).withColumn("_fills", looked_up("_numbers"))


def _words_by_number(
    chosen: DataFrame, columns: Sequence[str], index: DataFrame, numbers: Column, span: int
) -> DataFrame:
    """Texts filled out of a long dictionary.

    Texts and places are written once. Requests of three numbers meet the words by the number drawn,
    which spreads evenly; the words go back to their text, in one shuffle with the texts and sorted, so
    that a text and its words come one after the other.
    """
    kinds = chosen.select(*columns).schema
    texts = landed(chosen.select(*columns, "starts").withColumn("_row", F.monotonically_increasing_id()), "places")
    asked = texts.select("_row", F.posexplode(numbers).alias("_at", "idx"))
    told = asked.join(index.hint("shuffle_hash"), "idx").select("_row", "_at", F.col("word").alias("_word"))
    both = texts.withColumn("_at", F.lit(-1)).unionByName(told, allowMissingColumns=True)

    def spliced(text: str, starts: list[int], words: list[str]) -> str:
        pieces, parts, end = text.split(" "), [], 0
        for i, start in enumerate(starts):
            parts += pieces[end:start]
            parts += words[i * span:(i + 1) * span]
            end = start + span
        return " ".join(parts + pieces[end:])

    def filled(batches):
        # The words of the last text of a batch may go on in the next.
        kept, words = None, []

        def done(rows: pa.Table, words: list[list[str]]) -> list[pa.RecordBatch]:
            """The texts with their words."""
            told = zip(rows["text"].to_pylist(), rows["starts"].to_pylist(), words)
            made = [None if text is None else spliced(text, starts or [], found) for text, starts, found in told]
            place = rows.schema.get_field_index("text")
            return rows.set_column(place, "text", pa.array(made, pa.string())).select(list(columns)).to_batches()

        for batch in batches:
            heads = np.flatnonzero(batch["_at"].to_numpy() < 0).tolist()
            found = batch["_word"].to_pylist()
            words += found[:heads[0] if heads else len(found)]
            if heads:
                texts = pa.Table.from_batches([batch.take(pa.array(heads))])
                own = [found[head + 1:end] for head, end in zip(heads, [*heads[1:], len(found)])]
                if kept is not None:
                    texts, own = pa.concat_tables([kept, texts]), [words, *own]
                yield from done(texts.slice(0, len(own) - 1), own[:-1])
                kept, words = texts.slice(len(own) - 1), own[-1]
        if kept is not None:
            yield from done(kept, [words])

    return both.repartition("_row").sortWithinPartitions("_row", "_at").mapInArrow(filled, kinds)


def held_bytes(index: DataFrame) -> int:
    """Bytes of the words where a task holds them all: their text and where each ends."""
    return index.agg(F.sum(F.octet_length("word").cast("long") + 4)).first()[0] or 0


def _filled(
    chosen: DataFrame, columns: Sequence[str], index: DataFrame, keys: Sequence[str], span: int, seed: int
) -> DataFrame:
    """Texts whose ``starts`` are filled with drawn words.

    A dictionary of up to ``BROADCAST_BYTES`` goes to every task and nothing is shuffled; a longer one is
    joined by number.
    """
    numbers = _numbers(keys, seed, index.count(), span)
    if held_bytes(index) > BROADCAST_BYTES:
        return _words_by_number(chosen, columns, index, numbers, span).select(*[c for c in columns if c != "text"], "text")
    chosen = _words_at_hand(chosen, index, numbers, span)
    # Columns that are named twice are not merged into the lambdas of others, where Python cannot
    # be called.
    fills = F.when(F.size("_fills") * span == F.size("_numbers"), F.col("_fills"))
    return chosen.select(
        *[c for c in columns if c != "text"],
        splice(F.col("pieces"), F.col("starts"), span, fills).alias("text"),
    )


def random_fill(
    texts: DataFrame,
    index: DataFrame,
    keys: Sequence[str],
    span: int = 2,
    buffer: int = 1,
    share: float = 0.3,
    round_up: bool = False,
    seed: int = 0,
) -> DataFrame:
    """Texts with every chosen span replaced by ``span`` distinct random dictionary words.

    ``index`` is a ``dictionary_index``; land it first, it is counted and then read.
    """
    chosen = choose_spans(texts, keys, span, buffer, share, round_up, seed)
    return _filled(chosen, texts.columns, index, keys, span, seed)


def random_replace(
    texts: DataFrame,
    index: DataFrame,
    keys: Sequence[str],
    span: int = 2,
    buffer: int = 1,
    share: float = 0.3,
    seed: int = 0,
) -> DataFrame:
    """Every piece is replaced by a random word with probability share*span/(span+2*buffer)."""
    chance = share * span / (span + 2 * buffer)
    digest = order_key(seed, *[F.col(k) for k in keys])

    def hits(prefix: Column) -> Column:
        return F.filter(
            F.sequence(F.lit(0), F.size("pieces") - 1),
            lambda i: drawn_below(F.md5(F.concat(prefix, i.cast("string"))), chance),
        )

    chosen = texts.withColumn("pieces", pytext.space_pieces(F.col("text"))).withColumn(
        "starts", let(F.concat(digest, F.lit("|")), hits)
    )
    return _filled(chosen, texts.columns, index, keys, 1, seed)


def extract_fills(generated: Column) -> Column:
    """The trimmed texts between the marks of a mask filler's output."""
    bare = generated
    for mark in fv.GENERATOR_MARKS:
        bare = F.replace(bare, F.lit(mark), F.lit(""))
    parts = F.split(pytext.strip(bare), fv.MASK_PATTERN, -1)
    between = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 2, F.lit(0)))
    return F.transform(between, pytext.strip)


def put_fills(masked: Column, fills: Column) -> Column:
    """Masked text with its marks replaced; '' when there are too few fills."""

    def build(row: Column) -> Column:
        def filled(piece: Column) -> Column:
            number = F.regexp_extract(piece, r"^<extra_id_(\d+)>\z", 1).try_cast("int")
            fill = F.when(number < row["n"], F.try_element_at(row["fills"], number + 1))
            return F.when(piece.startswith(fv.MASK_PREFIX), F.coalesce(fill, piece)).otherwise(
                piece
            )

        text = F.array_join(F.transform(pytext.space_pieces(masked), filled), " ")
        return F.when(F.size(row["fills"]) < row["n"], "").otherwise(text)

    return let(F.struct(pytext.mask_count(masked).alias("n"), fills.alias("fills")), build)


def apply_fills(generated: DataFrame) -> DataFrame:
    """(masked, generated) to ``text``; ``accepted`` is 0 where the filler must run again."""
    text = put_fills(F.col("masked"), extract_fills(F.col("generated")))
    return generated.withColumn("text", text).withColumn(
        "accepted", (F.col("text") != "").cast("int")
    )


def perturb_rounds(
    texts: DataFrame, index: DataFrame, keys: Sequence[str], rounds: int = 1, seed: int = 0, **how
) -> DataFrame:
    """``random_fill`` applied ``rounds`` times, each time with fresh draws."""
    for turn in range(rounds):
        texts = random_fill(texts, index, keys, seed=seed + turn, **how)
    return texts
