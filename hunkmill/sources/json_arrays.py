"""Objects of large JSON arrays, read by many tasks.

Spark reads a JSON array file in one task. Here the file is read as text that ends at every closing
brace, which Spark cuts into byte ranges like any text. What a brace means depends on all that comes
before it, so two passes are made:

1. Every range is summed up: whether it has an odd number of quotes, and by how much it deepens, once
   for a range that begins outside of a string and once for one that begins inside. Sums over the
   ranges before it then tell how each range begins.
2. With that every range knows where its objects end. Those that lie wholly in a range are given as
   they are; the parts of those that cross a border, two for each range, are put together.

A piece never begins with an escaped character, as no escape ends in a brace. A task looks at the pieces
of a batch together, as one array of bytes of which only quotes and brackets matter. Files go by the hash
of their name, so that no piece carries a name.

Packed arrays (``writers.json_arrays``) are zstandard files of independent frames of some 256 KB of text,
each followed by a marker. Spark cuts them into byte ranges at the markers; frames are unpacked one at a
time, and their texts, of which none begins inside of an escape, take the place of pieces.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from hunkmill.session import landed

ESCAPED = re.compile(rb"\\.", re.S)
#: What may stand between two objects of an array.
BETWEEN = b" \t\r\n,["
#: Stands after each frame of a packed array: a skippable frame, which zstandard's readers pass over. It is
#: ASCII, as a separator of Spark's text files has to be; no JSON text has its control characters.
MARKER = "P*M\x18\x10\0\0\0-hunkmill-frame-"

#: All bytes but quotes and brackets, and by how much a byte deepens.
PLAIN = bytes(set(range(256)) - set(b'"{}[]'))
DEEPER = np.zeros(256, np.int8)
DEEPER[[*b"{[", *b"}]"]] = [1, 1, -1, -1]


def _pieces(spark: SparkSession, path: str, packed: bool = False) -> DataFrame:
    rows = spark.read.option("lineSep", MARKER if packed else "}").text(path)
    value = F.col("value").cast("binary") if packed else F.col("value")
    return rows.select(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), value.alias("value"))


def _names(spark: SparkSession, path: str) -> dict[int, str]:
    files = spark.read.format("binaryFile").load(path)  # the contents are not read
    name = F.col("_metadata.file_path")
    return {r.hash: r.name for r in files.select(name.alias("name"), F.xxhash64(name).alias("hash")).collect()}


def _unescaped(text: bytes) -> bytes:
    """The text with its escapes made characters that do not count."""
    return ESCAPED.sub(b"__", text) if b"\\" in text else text


def _signs(text: bytes) -> tuple[np.ndarray, np.ndarray, bool]:
    """Of the quotes and brackets of a text without escapes: by how much they deepen, whether the quotes up
    to them are odd, and whether all quotes are."""
    signs = np.frombuffer(text.translate(None, PLAIN), np.uint8)
    odd = np.cumsum(signs == ord('"'), dtype=np.uint8) % 2 == 1  # sums wrap at 256, which is even
    return DEEPER[signs], odd, bool(len(odd) and odd[-1])


def _runs(batches) -> Iterator[tuple[int, int, bytes]]:
    """(file, block, text) of a frame, or of neighbouring pieces of a range, each ended by its brace."""
    for batch in batches:
        if not batch.num_rows:
            continue
        if pa.types.is_binary(batch["value"].type):
            for file, block, frame in zip(batch["file"].to_pylist(), batch["block"].to_pylist(), batch["value"]):
                yield file, block, pa.input_stream(frame.as_buffer(), compression="zstd").read()
            continue
        files, blocks, values = batch["file"].to_numpy(), batch["block"].to_numpy(), batch["value"].to_pylist()
        cuts = [0, *(np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1).tolist(), len(values)]
        for a, b in zip(cuts, cuts[1:]):
            yield int(files[a]), int(blocks[a]), ("}".join(values[a:b]) + "}").encode()


def _summaries(batches) -> Iterator[pa.RecordBatch]:
    """One row for each range of a file."""
    at, state = None, None

    def told() -> pa.RecordBatch:
        return pa.RecordBatch.from_pylist([{"file": at[0], "block": at[1], **state}], SUMMARY)

    for file, block, text in _runs(batches):
        if (file, block) != at:
            if at is not None:
                yield told()
            at = file, block
            state = {"odd": 0, "outside": 0, "inside": 0, "array": int(text.lstrip(b" \t\r\n\xef\xbb\xbf")[:1] == b"[")}
        by, odd, last = _signs(_unescaped(text))
        inside = int(by[odd].sum(dtype=np.int64))
        deeper = int(by.sum(dtype=np.int64)) - inside, inside
        state["outside"] += deeper[state["odd"]]
        state["inside"] += deeper[1 - state["odd"]]
        state["odd"] ^= int(last)
    if at is not None:
        yield told()


SUMMARY = pa.schema([("file", pa.int64()), ("block", pa.int64()), ("odd", pa.int64()), ("outside", pa.int64()), ("inside", pa.int64()), ("array", pa.int64())])
SUMMARY_COLUMNS = "file long, block long, odd long, outside long, inside long, array long"
#: ``place`` is null for whole objects; else the parts of a range stand in this order.
PARTS = pa.schema([("file", pa.string()), ("block", pa.int64()), ("place", pa.int32()), ("ended", pa.bool_()), ("text", pa.string())])
PART_COLUMNS = "file string, block long, place int, ended boolean, text string"


def _starts(pieces: DataFrame) -> DataFrame:
    """(file, block, inside, depth, base): how every range begins, and the depth of the file's objects."""
    ranges = landed(pieces.mapInArrow(_summaries, SUMMARY_COLUMNS), "ranges")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    first = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    begun = ranges.withColumn("begins_inside", F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2)
    deeper = F.when(F.col("begins_inside") == 1, F.col("inside")).otherwise(F.col("outside"))
    return landed(begun.withColumn("deeper", deeper).select(
        "file", "block", "begins_inside", F.coalesce(F.sum("deeper").over(before), F.lit(0)).alias("depth"),
        F.first("array").over(first).alias("base"),
    ), "range-starts")


def _parts(batches, starts: dict[tuple[int, int], tuple[str, int, int, int]]) -> Iterator[pa.RecordBatch]:
    """Whole objects, and the parts of those that cross the borders of a range."""
    at, name, odd, depth, base, whole = None, "", 0, 0, 0, False
    held: list[bytes] = []

    def given(texts: list[bytes], places: list[int | None], ended: bool) -> pa.RecordBatch:
        size = len(texts)
        return pa.RecordBatch.from_arrays([
            pa.array([name] * size, pa.string()), pa.array([at[1]] * size, pa.int64()), pa.array(places, pa.int32()), pa.array([ended] * size, pa.bool_()),
            pa.array([t.decode() for t in texts], pa.string()),
        ], schema=PARTS)

    def closed() -> Iterator[pa.RecordBatch]:
        text = b"".join(held)
        if whole:
            text = text.lstrip(BETWEEN)
        if held and (text.strip(b" \t\r\n,]") or not whole):
            yield given([text], [1], False)

    for file, block, text in _runs(batches):
        if (file, block) != at:
            if at is not None:
                yield from closed()
            at, held = (file, block), []
            name, odd, depth, base = starts[at]
            whole = not odd and depth == base or block == 0
        plain = _unescaped(text)
        by, inside, last = _signs(plain)
        outside = inside == bool(odd)
        deep = depth + np.cumsum(by * outside, dtype=np.int64)
        # Places in the text are looked up for closing braces only: which signs they are, and where.
        braces = np.flatnonzero(np.frombuffer(plain.translate(None, PLAIN), np.uint8) == ord("}"))
        places = np.flatnonzero(np.frombuffer(plain, np.uint8) == ord("}"))
        ends = (places[outside[braces] & (deep[braces] == base)] + 1).tolist()
        if ends:
            found = [text[a:b] for a, b in zip([0, *ends], ends)]
            found[0] = b"".join([*held, found[0]])
            found = [t.lstrip(BETWEEN) if n or whole else t for n, t in enumerate(found)]
            yield given(found, [None if whole else 0, *[None] * (len(found) - 1)], True)
            held, whole, text = [], True, text[ends[-1]:]
        if text:
            held.append(text)
        if len(deep):
            depth = int(deep[-1])
        odd ^= int(last)
    if at is not None:
        yield from closed()


def objects(spark: SparkSession, path: str, schema: T.StructType | None = None, packed: bool = False) -> DataFrame:
    """(file, text): the objects of all JSON arrays at a path, each as its text.

    A file may also hold one object, or several one after the other. Elements that are no objects are
    left out where they stand last, and else become part of the next object's text.

    With a schema (file, document): objects are parsed where they are found, and written as what the schema
    names instead of as text.
    """
    pieces = _pieces(spark, path, packed)
    # One row for each byte range that a task reads.
    names = _names(spark, path)
    starts = {(r.file, r.block): (names[r.file], r.begins_inside, r.depth, r.base) for r in _starts(pieces).collect()}
    parts, given, parsed = pieces.mapInArrow(lambda batches: _parts(batches, starts), PART_COLUMNS), "text", F.col
    if schema is not None:
        given, parsed = "document", lambda text: F.from_json(text, schema)
        whole = F.col("place").isNull()
        parts = parts.select(
            "file", "block", "place", "ended", F.when(~whole, F.col("text")).alias("text"),
            F.when(whole, parsed("text")).alias("document"),
        )
    parts = landed(parts, "json-objects")
    crossing = parts.where("place IS NOT NULL")
    order = Window.partitionBy("file").orderBy("block", "place").rowsBetween(Window.unboundedPreceding, -1)
    numbered = crossing.withColumn("number", F.coalesce(F.count_if("ended").over(order), F.lit(0)))
    joined = numbered.groupBy("file", "number").agg(
        F.array_sort(F.collect_list(F.struct("block", "place", "text", "ended"))).alias("all")
    ).where(F.exists("all", lambda p: p["ended"]))
    put = joined.select("file", F.array_join(F.transform("all", lambda p: p["text"]), "").alias("text"))
    return parts.where("place IS NULL").select("file", given).union(put.select("file", parsed("text")))
