"""Line dedup by a template tree: lines that follow a template found in many documents are dropped.

A line's tokens are its words between ASCII white space; tokens with a digit are variable. The tree has
a fixed depth: the number of tokens, the first ``LEADING`` tokens, then the most used of the other
constant tokens, until ``AGREE`` of all places are taken. How much a token is used is the number of
documents, summed over the distinct lines of the leaf, that have it at that place; equal ones go by
place. Lines at the same end of the tree agree in these places and vary in the others: they follow one
template. A line with too few constant places is a template of its own. A template recurs if its lines
stand in ``DOCUMENTS`` documents, or in ``LONG_DOCUMENTS`` where lines have ``LONG_TOKENS`` tokens or
more; lines of up to ``LEADING`` tokens have to agree in full.

One rule holds at every size, since a line's place in the tree follows from sums over its leaf: there
are no blocks and no order of lines. The lines of a leaf of up to ``LEAF_PLACES`` places meet in one task,
as text, and are summed and ranked there, so a place is never a row of a shuffle; a larger leaf is counted
by partial sums, and tokens that very many of its lines share are dealt out where the sums are joined.
Distinct lines are counted first; only leaves that recurring lines can come from are looked at further.

Edge cases: a null text stays null and has no lines; lines without a constant token are never dropped;
equal lines of one document count once; all null ids count as one document; repeated ids count as one
document, each row keeps its own lines; rows that repeat id and text lose the same lines; a very long
text or line is handled whole; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.llm.sized import BROADCAST_BYTES, sent_if_small
from hunkmill.llm.word_ids import utf8
from hunkmill.operators.joins import fits, hot_keys, spread_join
from hunkmill.session import landed

LEADING, AGREE = 3, 0.6
DOCUMENTS, LONG_DOCUMENTS, LONG_TOKENS = 3, 2, 20
#: Places (lines by tokens) of a leaf that one task takes at most, and of leaves that it takes together.
LEAF_PLACES, TOGETHER_PLACES = 1 << 16, 1 << 18
VARIABLE = b"<*>"
DIGIT = re.compile(rb"[0-9]")


def masked(line: bytes) -> list[bytes]:
    """The tokens of a line, variable ones replaced; none if all are variable."""
    tokens = line.split()
    if DIGIT.search(line):
        tokens = [VARIABLE if DIGIT.search(t) else t for t in tokens]
        if tokens.count(VARIABLE) == len(tokens):
            return []
    return tokens


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def leaf_of(tokens: list[bytes]) -> int:
    return _signed(xxhash.xxh3_64_intdigest(b" ".join(tokens[:LEADING]), len(tokens)))


def line_of(joined: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(joined))


def places_of(tokens: list[bytes]) -> tuple[int | None, list[int | None]]:
    """How many tokens the tree takes beside the leading ones, and the hashes of all that it can take by
    place; no number for a line with too few constant places."""
    depth = math.ceil(AGREE * len(tokens) - 1e-9)
    if len(tokens) - tokens.count(VARIABLE) < depth:
        return None, []
    take = depth - sum(t != VARIABLE for t in tokens[:LEADING])
    if take <= 0:
        return 0, []
    return take, [None if t == VARIABLE else _signed(xxhash.xxh3_64_intdigest(t, place)) for place, t in enumerate(tokens[LEADING:])]


def _lines(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, leaf, line (hashes) and size of every line, each once per document."""

    def work(batches):
        for batch in batches:
            places, leaves, lines, sizes = [], [], [], []
            for place, raw in enumerate(utf8(batch["text"])):
                seen = set()
                for line in raw.split(b"\n"):
                    if tokens := masked(line):
                        number = line_of(b" ".join(tokens))
                        if number not in seen:
                            seen.add(number)
                            places.append(place)
                            leaves.append(leaf_of(tokens))
                            lines.append(number)
                            sizes.append(len(tokens))
            yield pa.RecordBatch.from_arrays([
                batch["doc"].take(pa.array(places, pa.int64())), pa.array(leaves, pa.int64()), pa.array(lines, pa.int64()), pa.array(sizes, pa.int64()),
            ], ["doc", "leaf", "line", "size"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"doc {kind}, leaf long, line long, size long")


def _shown(docs: DataFrame, text: str) -> DataFrame:
    """(leaf, line, tokens) of the lines, each once per batch."""

    def work(batches):
        for batch in batches:
            found: dict[int, tuple[int, bytes]] = {}
            for raw in utf8(batch["text"]):
                for line in raw.split(b"\n"):
                    if tokens := masked(line):
                        joined = b" ".join(tokens)
                        found[line_of(joined)] = (leaf_of(tokens), joined)
            leaf, shown = zip(*found.values()) if found else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(leaf, pa.int64()), pa.array(list(found), pa.int64()), pa.array(shown, pa.binary())], ["leaf", "line", "tokens"])

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(work, "leaf long, line long, tokens binary")


def _places(shown: DataFrame) -> DataFrame:
    """(leaf, line, take, places) of the distinct lines."""

    def cut(batches):
        for batch in batches:
            told = [places_of(t.as_buffer().to_pybytes().split(b" ")) for t in batch["tokens"]]
            yield pa.RecordBatch.from_arrays([
                batch["leaf"], batch["line"], pa.array([take for take, _ in told], pa.int32()), pa.array([places for _, places in told], pa.list_(pa.int64())),
            ], ["leaf", "line", "take", "places"])

    lines = shown.groupBy("leaf", "line").agg(F.first("tokens").alias("tokens"))
    return lines.mapInArrow(cut, "leaf long, line long, take int, places array<bigint>")


def _end(most: Column) -> Column:
    """Where a line arrives in the tree, by the tokens that the tree takes of it."""
    return F.when(F.col("take").isNull(), F.xxhash64(F.lit(0), "line")).otherwise(F.xxhash64(F.lit(1), "leaf", most))


def most_used(leaves: np.ndarray, uses: np.ndarray, takes: list[int | None], places: list[list[int | None]]) -> list[list[int]]:
    """Per line the tokens that the tree takes of it, most used first, out of all lines of its leaf."""
    sizes = np.fromiter(map(len, places), np.int64, len(places))
    flat = pa.array([token for line in places for token in line], pa.int64())
    constant = np.flatnonzero(flat.is_valid().to_numpy(zero_copy_only=False))
    tokens = flat.fill_null(0).to_numpy()[constant]
    line = np.repeat(np.arange(len(places)), sizes)[constant]
    place = constant - (np.cumsum(sizes) - sizes)[line]
    # How often a leaf's lines use a token at its place; the hash of a token knows the place.
    order = np.lexsort((tokens, leaves[line]))
    new = np.ones(len(order), bool)
    new[1:] = (tokens[order][1:] != tokens[order][:-1]) | (leaves[line][order][1:] != leaves[line][order][:-1])
    used = np.zeros(len(order), np.int64)
    if len(order):
        used[order] = np.add.reduceat(uses[line][order], np.flatnonzero(new))[np.cumsum(new) - 1]
    ranked = np.lexsort((place, -used, line))
    ends = np.cumsum(np.bincount(line, minlength=len(places)))
    begins = [0, *ends.tolist()]
    tokens = tokens[ranked].tolist()
    return [tokens[begin:min(begin + (take or 0), end)] for begin, end, take in zip(begins, ends.tolist(), takes)]


def _whole_leaves(shown: DataFrame, counted: DataFrame) -> DataFrame:
    """(leaf, line, size, n, end) of the lines of leaves that a task can hold: texts and counts of a leaf's
    lines meet in one task, and a line that comes more often is taken once."""

    def told(lines: dict[tuple[int, int], list]) -> pa.RecordBatch:
        keys, found = list(lines), [line for line in lines.values()]
        cut = [places_of(line[0].split(b" ")) for line in found]
        leaf, takes = np.array([key[0] for key in keys], np.int64), [take for take, _ in cut]
        most = most_used(leaf, np.array([line[2] for line in found], np.int64), takes, [places for _, places in cut])
        return pa.RecordBatch.from_arrays([
            pa.array(leaf), pa.array([key[1] for key in keys], pa.int64()), pa.array([line[1] for line in found], pa.int64()),
            pa.array([line[2] for line in found], pa.int64()), pa.array(takes, pa.int32()), pa.array(most, pa.list_(pa.int64())),
        ], ["leaf", "line", "size", "n", "take", "most"])

    def work(batches):
        lines, held, last = {}, 0, None
        for batch in batches:
            columns = (batch[name].to_pylist() for name in ("leaf", "line", "tokens", "size", "n"))
            for leaf, line, tokens, size, n in zip(*columns):
                if leaf != last and held >= TOGETHER_PLACES:
                    yield told(lines)
                    lines, held = {}, 0
                last = leaf
                known = lines.setdefault((leaf, line), [None, None, None])
                if tokens is not None:
                    known[0] = tokens
                else:
                    known[1:] = size, n
                    held += size
        if lines:
            yield told(lines)

    rows = shown.select("leaf", "line", "tokens", F.lit(None).cast("long").alias("size"), F.lit(None).cast("long").alias("n"))
    counts = counted.select("leaf", "line", F.lit(None).cast("binary").alias("tokens"), "size", "n")
    met = rows.unionByName(counts).repartition("leaf").sortWithinPartitions("leaf")
    ends = met.mapInArrow(work, "leaf long, line long, size long, n long, take int, most array<bigint>")
    return ends.withColumn("end", _end(F.col("most"))).drop("take", "most")


def _ends(lines: DataFrame) -> DataFrame:
    """Adds ``end``, where the line arrives in the tree, to rows (leaf, line, take, places, n)."""
    placed = lines.select("leaf", "line", "n", F.posexplode("places").alias("place", "token")).where("token IS NOT NULL")
    keys = ["leaf", "token"]
    # Rows are counted in the same pass, so that finding the tokens to deal out takes no shuffle of its own.
    counted = landed(placed.groupBy(*keys).agg(F.sum("n").alias("uses"), F.count("*").alias("_rows")), "token-uses")
    uses, facts = counted.drop("_rows"), placed.select(*keys, "line", "place")
    if fits(uses):
        told = facts.join(F.broadcast(uses), keys)
    else:
        told = spread_join(facts, uses, keys, spread_by=["line", "place"], hot=hot_keys(counted, keys), broadcast_bytes=0)
    ranked = told.groupBy("line").agg(F.array_sort(F.collect_list(F.struct((-F.col("uses")).alias("uses"), "place", "token"))).alias("ranked"))
    most = F.transform(F.slice(F.coalesce("ranked", F.array().cast("array<struct<uses:bigint,place:int,token:bigint>>")), F.lit(1), F.col("take")), lambda x: x["token"])
    return lines.join(ranked, "line", "left").withColumn("end", _end(most)).drop("ranked", "take", "places")


def _documents() -> Column:
    return F.count_distinct(F.coalesce(F.col("doc").cast("string"), F.lit("")))


def drop_recurring_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", documents: int = DOCUMENTS, long_documents: int = LONG_DOCUMENTS, long_tokens: int = LONG_TOKENS) -> DataFrame:
    """Per row: the key, the text without recurring lines, n_lines and n_dropped."""
    need = F.when(F.col("size") >= long_tokens, long_documents).otherwise(documents)
    lines = landed(_lines(docs, key, text), "lines")
    # Documents per line and per leaf; a leaf below the bound cannot hold a recurring template.
    counted = landed(lines.groupBy("leaf", "line", "size").agg(_documents().alias("n")), "line-counts")
    leaves = counted.groupBy("leaf", "size").agg(F.sum("n").alias("n"), F.count("*").alias("lines")).where(F.col("n") >= need)
    large = F.col("lines") * F.col("size") > LEAF_PLACES
    leaves = landed(leaves.select("leaf", (F.col("lines") == 1).alias("alone"), large.alias("large")), "leaves")
    wanted = landed(counted.join(sent_if_small(leaves, 10), "leaf"), "wanted-lines")
    # A line that is alone in its leaf is its template; the others go down the tree.
    alone = wanted.where("alone").drop("alone", "large").withColumn("end", F.xxhash64(F.lit(0), "line"))
    several = landed(leaves.where("NOT alone").select("leaf", "large"), "shared-leaves")
    shown, some_large = _shown(docs, text).join(sent_if_small(several, 9), "leaf"), several.where("large").count() > 0
    if some_large:  # read twice, cut once
        shown = landed(shown, "shown-lines")
    final = _whole_leaves(shown.where("NOT large"), wanted.where("NOT alone AND NOT large")).unionByName(alone)
    if some_large:
        found = _places(shown.where("large")).join(wanted.where("NOT alone AND large").drop("alone", "large"), ["leaf", "line"])
        final = final.unionByName(_ends(landed(found, "line-places")))
    final = landed(final, "line-ends")
    # Lines of one template may share documents: those that could recur are counted by document.
    able = final.groupBy("end", "size").agg(F.sum("n").alias("n"), F.max("n").alias("most")).where(F.col("n") >= need)
    able = landed(able.withColumn("sure", F.col("most") >= need).select("end", "sure"), "ends")
    told = landed(final.join(sent_if_small(able, 9), "end").select("line", "end", "size", "sure"), "able-lines")
    open_lines = told.where("NOT sure").select("line", "end")
    seen = lines.join(sent_if_small(open_lines, 16), "line")
    more = seen.groupBy("end", "size").agg(_documents().alias("n")).where(F.col("n") >= need).select("end")
    dropped = told.where("sure").select("line").union(open_lines.join(more, "end", "left_semi").select("line"))
    return _without(docs, landed(dropped.distinct(), "dropped-lines"), key, text)


def _cutter(gone_lines: np.ndarray, numbers_of: Callable[[bytes], list[int | None]]) -> Callable:
    """Cuts the lines of the sorted numbers out of batches of (doc, text), and counts."""

    def work(batches):
        for batch in batches:
            raws = list(utf8(batch["text"]))
            lines = pa.array([numbers_of(raw) for raw in raws], pa.list_(pa.int64()))
            sizes = lines.value_lengths().to_numpy()
            ends = np.cumsum(sizes)
            flat = lines.flatten()
            gone = np.zeros(len(flat), bool)
            if len(gone_lines):
                values = flat.fill_null(0).to_numpy()
                places = np.minimum(np.searchsorted(gone_lines, values), len(gone_lines) - 1)
                gone = (gone_lines[places] == values) & flat.is_valid().to_numpy(zero_copy_only=False)
            before = np.concatenate([[0], np.cumsum(gone)])
            lost = before[ends] - before[ends - sizes]
            texts = batch["text"]
            if lost.any():
                kept = [
                    b"\n".join(line for line, out in zip(raw.split(b"\n"), gone[end - size:end].tolist()) if not out) if n else raw
                    for raw, n, end, size in zip(raws, lost.tolist(), ends.tolist(), sizes.tolist())
                ]
                made = pa.array(kept, pa.binary(), mask=texts.is_null().to_numpy(zero_copy_only=False))
                texts = pa.Array.from_buffers(texts.type, len(made), made.buffers()) if pa.types.is_string(texts.type) else made.cast(texts.type)
            yield pa.RecordBatch.from_arrays([batch["doc"], texts, pa.array(sizes, pa.int64()), pa.array(lost, pa.int64())], ["doc", "text", "n_lines", "n_dropped"])

    return work


def _without(docs: DataFrame, dropped: DataFrame, key: str, text: str) -> DataFrame:
    """The texts without the dropped lines.

    Up to ``BROADCAST_BYTES`` of their numbers go to every task, and no text is shuffled. Beyond that the
    line numbers of each row are joined with the dropped ones, and all texts meet what they lose. Rows
    are known by hashes of id and text, so it does not matter how they are dealt.
    """
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("doc"), F.col(text).cast("string").alias("text"))

    def numbers_of(raw: bytes) -> list[int | None]:
        return [line_of(b" ".join(t)) if (t := masked(line)) else None for line in raw.split(b"\n")] if raw else []

    def number(batches):
        for batch in batches:
            hashes = [numbers_of(raw) for raw in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["text"], pa.array(hashes, pa.list_(pa.int64()))], ["doc", "text", "lines"])

    if dropped.count() * 8 <= BROADCAST_BYTES:
        gone_lines = np.sort(dropped.select("line").toArrow()["line"].to_numpy())
        return rows.mapInArrow(_cutter(gone_lines, numbers_of), f"doc {kind}, text string, n_lines long, n_dropped long").withColumnRenamed("doc", key)

    row = F.struct(F.xxhash64("doc", "text").alias("a"), F.xxhash64(F.lit(1), "text", "doc").alias("b"))
    numbered = rows.mapInArrow(number, f"doc {kind}, text string, lines array<bigint>").withColumn("row", row)
    places = numbered.select("row", F.posexplode("lines").alias("at", "line")).join(sent_if_small(dropped, 8), "line", "left_semi")
    gone = places.groupBy("row").agg(F.collect_set("at").alias("gone"))
    joined = rows.withColumn("row", row).join(gone, "row", "left")
    split = F.split("text", "\n")
    kept = F.filter(split, lambda _, i: ~F.array_contains(F.coalesce("gone", F.array().cast("array<int>")), i))
    return joined.select(
        F.col("doc").alias(key), F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
        F.when(F.coalesce(F.length("text"), F.lit(0)) > 0, F.size(split)).otherwise(0).cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
    )
