"""SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit where more than half of its shingles' hashes have one. Two fingerprints
are linked if they differ in at most ``RADIUS`` = 2 bits.

Each bit position has a label, a vector of ``RADIUS + 1`` bits. For every such vector but zero there is
a table that keeps the positions whose label has an odd product with it. However two positions are
chosen, some vector has an even product with both labels, so its table keeps neither: fingerprints that
differ there (or in one of them) have the same value in that table. The seven tables therefore lose no
link, for any input; only fingerprints that meet another one in a table go on.

Links are verified without pairs. A fingerprint that met another one stands under itself and under what
it becomes when one position that its tables leave out is flipped. Those that stand under the same key
differ in at most two bits, and a linked pair stands together under two keys. A key can only hold 65
fingerprints, so no group grows with the data; the edges of a group are a star, and a key's copies, less
one's own, count each link twice. Equal fingerprints are one node from the start, with their number.

Edge cases: null and empty texts have no words and the fingerprint zero, which is linked like any other;
fewer than three words are one shingle; very long texts are hashed in stretches of about a megabyte; a
tie (a bit in exactly half the hashes) gives 0; rows that repeat an id keep a row each; a null id counts
for no minimum and gets its class's smallest id, or null; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.llm.graphs import connected
from hunkmill.llm.sized import sent_if_small
from hunkmill.llm.word_ids import utf8
from hunkmill.session import landed

WIDTH, SEED, BITS, RADIUS = 3, 42, 64, 2
#: Bytes of a text that are cut into words at a time.
STRETCH = 1 << 20
SPACE = re.compile(rb"[ \t-\r]")
#: Which bits each byte value has, lowest first.
BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def stretches(text: bytes) -> Iterator[bytes]:
    """The text in parts that end at white space."""
    start = 0
    while start < len(text):
        end = SPACE.search(text, start + STRETCH)
        stop = end.start() if end else len(text)
        yield text[start:stop]
        start = stop


def shingle_hashes(text: bytes) -> Iterator[np.ndarray]:
    """The hashes of all shingles, in parts; none for a text without words."""
    tail: list[bytes] = []
    seen = 0
    for part in stretches(text.lower()):
        words = tail + part.split()
        if len(words) >= WIDTH:
            line = b" ".join(words)
            ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
            starts = [0, *ends[:-WIDTH].tolist()]
            spans = zip(starts, (ends[WIDTH - 1:] - 1).tolist())
            seen += len(starts)
            yield np.array([xxhash.xxh64_intdigest(line[a:b], SEED) for a, b in spans], np.uint64)
        tail = words[-(WIDTH - 1):]
    if not seen and tail:
        yield np.array([xxhash.xxh64_intdigest(b" ".join(tail), SEED)], np.uint64)


def fingerprint(text: bytes) -> int:
    """The 64-bit fingerprint as an unsigned number."""
    counts, total = np.zeros(BITS, np.int64), 0
    for hashes in shingle_hashes(text):
        lanes = hashes.view(np.uint8).reshape(-1, 8) + np.arange(0, 8 * 256, 256)
        counts += (np.bincount(lanes.ravel(), minlength=8 * 256).reshape(8, 256) @ BYTE_BITS).ravel()
        total += len(hashes)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def covering_masks(radius: int = RADIUS, bits: int = BITS) -> list[int]:
    """The positions that each table keeps. Two values that differ in at most ``radius`` positions agree
    on all that some mask keeps."""
    vectors = range(1, 1 << radius + 1)
    labels = [vectors[i % len(vectors)] for i in range(bits)]
    return [sum(1 << i for i, label in enumerate(labels) if (label & v).bit_count() % 2) for v in vectors]


def _long(number: int) -> Column:
    return F.lit(number - (1 << BITS) if number >> BITS - 1 else number).cast("long")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (doc, print): the fingerprint, as a signed long, of every row's whole text."""

    def work(batches):
        for batch in batches:
            found = np.array([fingerprint(t) for t in utf8(batch["text"])], np.uint64)
            yield pa.RecordBatch.from_arrays([batch["doc"], pa.array(found.view(np.int64))], ["doc", "print"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc long, print long")


def _met(nodes: DataFrame) -> DataFrame:
    """(print, copies, left_out): prints that meet another one in a table, with the positions that the
    tables where they do leave out."""
    masks = covering_masks()
    everything = (1 << BITS) - 1
    values = F.array(*[F.struct(F.col("print").bitwiseAND(_long(m)).alias("value"), _long(everything & ~m).alias("left_out")) for m in masks])
    placed = nodes.select("print", "copies", F.posexplode(values).alias("table", "at")).select("print", "copies", "table", "at.*")
    shared = placed.groupBy("table", "value").agg(F.count("*").alias("n")).where("n > 1").select("table", "value")
    met = placed.join(sent_if_small(landed(shared, "shared-values"), 16), ["table", "value"], "left_semi")
    return met.groupBy("print", "copies").agg(F.bit_or("left_out").alias("left_out"))


def _linked(met: DataFrame) -> DataFrame:
    """(print, star, others): for each key with several prints, each of them with the smallest one and
    with the number of copies of the others."""
    flipped = [F.when(F.col("left_out").bitwiseAND(_long(1 << i)) != 0, F.col("print").bitwiseXOR(_long(1 << i))) for i in range(BITS)]
    stood = met.select("print", "copies", F.explode(F.array_compact(F.array("print", *flipped))).alias("under"))
    together = stood.groupBy("under").agg(F.collect_list(F.struct("print", "copies")).alias("members"), F.sum("copies").alias("all"))
    together = together.where(F.size("members") > 1).select(F.array_min("members.print").alias("star"), "all", F.explode("members").alias("one"))
    return together.select("one.print", "star", (F.col("all") - F.col("one.copies")).alias("others"))


def near_duplicates(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, fingerprint, n_links, component_id), one for each row: the fingerprint in hex, the
    number of other rows within the radius, and the smallest id that links reach, its own included."""
    prints = landed(fingerprints(docs, key, text), "fingerprints")
    nodes = landed(prints.groupBy("print").agg(F.count("*").alias("copies"), F.min("doc").alias("least")), "distinct-prints")
    linked = landed(_linked(landed(_met(nodes), "met")), "linked")
    # The hash of a single number is one to one, so the graph's nodes are hashes and stay distinct.
    node = F.xxhash64("print")
    parts = connected(linked.select(node.alias("a"), F.xxhash64("star").alias("b")))
    counted = linked.groupBy("print").agg(F.sum("others").alias("twice"))
    # Only prints that have copies or links need a lookup; all others are alone.
    named = nodes.withColumn("node", node).join(parts, "node", "left").join(counted, "print", "left")
    named = named.where("copies > 1 OR part IS NOT NULL").withColumn("part", F.coalesce("part", "node"))
    smallest = named.groupBy("part").agg(F.min("least").alias("component"))
    links = (F.col("copies") - 1 + F.coalesce("twice", F.lit(0)) / 2).cast("long")
    lookup = landed(named.join(smallest, "part").select("print", links.alias("links"), "component"), "near-duplicates")
    out = prints.join(sent_if_small(lookup, 24), "print", "left")
    return out.select(
        F.col("doc").alias(key), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"),
        F.coalesce("links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component", "doc").alias("component_id"),
    )
