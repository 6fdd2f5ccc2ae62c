"""Ranked lexical search with buckets of impact vectors by length.

A text's score for an item is an inner product: over the item's terms, the term's weight times the
text's impact for it. Both sides are taken with the weights' square roots, so that common terms weigh
little in lengths. The search then follows the lengths:

1. One pass over all texts keeps what counts for the items: a text's length in terms, and how often it
   has the items' terms. Sums over all of it give document frequencies, weights and impacts.
2. Vectors are range-partitioned by length, longest first, and cut into buckets of ``BUCKET_ROWS``.
   The longest bucket of all is searched first; its 50th best score is a floor for the item everywhere.
3. A bucket is left out for an item if the product of the lengths (Cauchy-Schwarz) stays below the floor,
   or if the largest coordinates of the bucket do. Inside, the item's heaviest coordinates are summed
   until the rest cannot reach the floor alone; texts go on whose sum and bound for the rest (largest
   coordinates, or Cauchy-Schwarz on what is left of both lengths) reach it.
4. What is left is scored anew from its whole vector in 64-bit integers. Only these scores are ranked
   and only they raise the floor; bounds in doubles have a margin of ``SLACK``.

A task keeps 50 results for each item, so what moves to the final ranking is bounded for each task.
Items are taken in blocks of about ``BLOCK_TERMS`` terms, each with a pass of its own.

Edge cases: null and empty texts have no term, count for no statistic and are never found; items without
terms find nothing; an item that repeats is ranked once for each of its rows; equal scores are ranked by
ascending id, rows that repeat an id in any order, a null id last; very long texts are cut into terms in
stretches of about a megabyte; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from hunkmill.llm.word_ids import utf8
from hunkmill.session import landed

TOP = 50
#: Texts of a bucket, and bytes of their vectors, at most.
BUCKET_ROWS, BUCKET_BYTES = 4096, 32 << 20
BLOCK_TERMS = 1 << 20
STRETCH = 1 << 20
SLACK = 1e-9
#: Impacts are below this for any count and length.
SCALE, COUNT_SCALE, LENGTH_SCALE, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50
POST = np.dtype([("term", "<u4"), ("count", "<u4")])
LAST = np.iinfo(np.int64).max

#: Letters and digits of ASCII, A-Z lowered, and all bytes of other characters stay; the rest parts terms.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def terms(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text in order, in parts."""
    text = text.translate(KEPT)
    start = 0
    while start < len(text):
        stop = text.find(b" ", start + STRETCH)
        stop = len(text) if stop < 0 else stop
        yield text[start:stop].split()
        start = stop


def weight(documents: int, having: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * having + 1)))


def impacts(counts: np.ndarray, length: np.ndarray, documents: int, all_terms: int) -> np.ndarray:
    """Impacts of terms that occur so often in texts of these lengths."""
    m = 100 - LENGTH_SHARE + (LENGTH_SHARE * length * documents) // all_terms
    return (SCALE * counts) // (COUNT_SCALE * counts + LENGTH_SCALE * m)


class Best:
    """The best results of each item that a task has seen, and the score that a text must reach."""

    def __init__(self, items: int, floors: np.ndarray, top: int):
        self.scores = [np.zeros(0, np.int64) for _ in range(items)]
        self.keys = [np.zeros(0, np.int64) for _ in range(items)]
        self.floors, self.top = floors.copy(), top

    def add(self, item: int, scores: np.ndarray, keys: np.ndarray) -> None:
        scores, keys = np.concatenate([self.scores[item], scores]), np.concatenate([self.keys[item], keys])
        order = np.lexsort((keys, -scores))[:self.top]
        self.scores[item], self.keys[item] = scores[order], keys[order]
        if len(order) == self.top:
            self.floors[item] = max(self.floors[item], scores[order[-1]])


class Bucket:
    """Impact vectors of about equal length, by text and by term."""

    def __init__(self, keys: np.ndarray, lengths: np.ndarray, posts: list[np.ndarray], weights: np.ndarray, documents: int, all_terms: int):
        self.keys = keys
        sizes = np.fromiter(map(len, posts), np.int64, len(posts))
        self.ends = np.cumsum(sizes)
        flat = np.concatenate(posts) if posts else np.zeros(0, POST)
        self.term = flat["term"].astype(np.int64)
        self.impact = impacts(flat["count"].astype(np.int64), np.repeat(lengths, sizes), documents, all_terms)
        self.square = weights[self.term] * self.impact.astype(float) ** 2
        row = np.repeat(np.arange(len(posts)), sizes)
        self.squares = np.bincount(row, self.square, len(posts))
        order = np.argsort(self.term, kind="stable")
        self.row, self.by_term, self.square_by_term = row[order], self.impact[order], self.square[order]
        present, first = np.unique(self.term[order], return_index=True)
        self.first = np.zeros(len(weights) + 1, np.int64)
        self.count = np.zeros(len(weights) + 1, np.int64)
        self.largest = np.zeros(len(weights), np.int64)
        if len(present):
            self.first[present], self.count[present] = first, np.diff([*first, len(order)])
            self.largest[present] = np.maximum.reduceat(self.by_term, first)

    def search(self, wanted: np.ndarray, weights: np.ndarray, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(scores, keys) of at least all texts that reach the floor, for an item with these terms."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        needed = max(floor, 1) * (1 - SLACK)
        own = weights[wanted].astype(float)
        length = math.sqrt(own.sum())
        if not len(self.squares) or length * math.sqrt(self.squares.max()) < needed:
            return none
        most = own * self.largest[wanted]
        order = np.argsort(-most, kind="stable")
        wanted, own, most = wanted[order], own[order], most[order]
        rest = np.append(np.cumsum(most[::-1])[::-1], 0.0)
        if rest[0] < needed:
            return none
        focus = int(np.argmax(rest < needed))
        part, seen = np.zeros(len(self.keys), np.int64), np.zeros(len(self.keys))
        for t in wanted[:focus]:
            at = slice(self.first[t], self.first[t] + self.count[t])
            part[self.row[at]] += weights[t] * self.by_term[at]
            seen[self.row[at]] += self.square_by_term[at]
        left = np.sqrt(own[focus:].sum() * np.maximum(self.squares - seen, 0) * (1 + SLACK))
        some = np.flatnonzero((part > 0) & (part + np.minimum(rest[focus], left) >= needed))
        if not len(some):
            return none
        starts = np.where(some > 0, self.ends[some - 1], 0)
        sizes = self.ends[some] - starts
        at = np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        asked = np.zeros(len(weights), np.int64)
        asked[wanted] = weights[wanted]
        scores = np.add.reduceat(asked[self.term[at]] * self.impact[at], np.concatenate([[0], np.cumsum(sizes)[:-1]]))
        good = (scores > 0) & (scores >= floor)
        return scores[good], self.keys[some[good]]


def _buckets(batches, *what) -> Iterator[Bucket]:
    """Buckets of rows (doc, n, posts) that come in order of length."""
    held: list[pa.RecordBatch] = []
    rows = size = 0

    def cut() -> Bucket:
        table = pa.Table.from_batches(held)
        keys = table["doc"].fill_null(LAST).to_numpy()
        return Bucket(keys, table["n"].to_numpy(), [np.frombuffer(x.as_buffer(), POST) for x in table["posts"]], *what)

    for batch in batches:
        while batch.num_rows:
            sizes = np.cumsum(pc.binary_length(batch["posts"]).to_numpy())
            take = min(BUCKET_ROWS - rows, 1 + int(np.searchsorted(sizes, BUCKET_BYTES - size)), batch.num_rows)
            held.append(batch.slice(0, take))
            rows, size, batch = rows + take, size + int(sizes[take - 1]), batch.slice(take)
            if rows == BUCKET_ROWS or size >= BUCKET_BYTES:
                yield cut()
                held, rows, size = [], 0, 0
    if rows:
        yield cut()


def _item_terms(items: DataFrame, text: str) -> DataFrame:
    """(row, terms): the distinct terms of every item that has some."""

    def work(batches):
        for batch in batches:
            found = [sorted({t for part in terms(raw) for t in part}) for raw in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([batch["row"], pa.array(found, pa.list_(pa.binary()))], ["row", "terms"])

    rows = items.select("row", F.col(text).cast("string").alias("text")).mapInArrow(work, "row long, terms array<binary>")
    return rows.where(F.size("terms") > 0)


def _posts(docs: DataFrame, key: str, text: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """(doc, n, posts) of every text with a term: its terms with repeats, and those of the vocabulary."""

    def work(batches):
        for batch in batches:
            kept, lengths, found = [], [], []
            for place, raw in enumerate(utf8(batch["text"])):
                counts: Counter[bytes] = Counter()
                for part in terms(raw):
                    counts.update(part)
                if counts:
                    own = [(vocabulary[t], n) for t, n in counts.items() if t in vocabulary]
                    kept.append(place)
                    lengths.append(counts.total())
                    found.append(np.array(own, POST).tobytes())
            yield pa.RecordBatch.from_arrays([batch["doc"].take(pa.array(kept, pa.int64())), pa.array(lengths, pa.int64()), pa.array(found, pa.binary())], ["doc", "n", "posts"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, "doc long, n long, posts binary")


def _having(posts: DataFrame, size: int) -> np.ndarray:
    """How many texts have each term of the vocabulary."""

    def work(batches):
        counts = np.zeros(size, np.int64)
        for batch in batches:
            flat = b"".join(x.as_buffer() for x in batch["posts"])
            counts += np.bincount(np.frombuffer(flat, POST)["term"], minlength=size)
        some = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(counts[some])], ["term", "n"])

    out = np.zeros(size, np.int64)
    for row in posts.mapInArrow(work, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():
        out[row.term] = row.n
    return out


def _found_in(docs: DataFrame, key: str, text: str, items: list[tuple[int, list[bytes]]], top: int) -> DataFrame:
    """(row, doc, score): the best results of each task for a block of items."""
    vocabulary = {t: i for i, t in enumerate(sorted({t for _, own in items for t in own}))}
    wanted = [np.array([vocabulary[t] for t in own]) for _, own in items]
    numbers = np.array([row for row, _ in items])
    posts = landed(_posts(docs, key, text, vocabulary), "posts")
    documents, all_terms = posts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.array([weight(documents, int(n)) for n in _having(posts, len(vocabulary))], np.int64)
    what = weights, documents, all_terms

    def measured(batches):
        for batch in batches:
            sizes = np.array([len(x.as_buffer()) // POST.itemsize for x in batch["posts"]], np.int64)
            flat = np.frombuffer(b"".join(x.as_buffer() for x in batch["posts"]), POST)
            impact = impacts(flat["count"].astype(np.int64), np.repeat(batch["n"].to_numpy(), sizes), documents, all_terms)
            squares = np.bincount(np.repeat(np.arange(len(sizes)), sizes), weights[flat["term"]] * impact.astype(float) ** 2, len(sizes))
            yield batch.append_column("square", pa.array(squares))

    vectors = posts.mapInArrow(measured, "doc long, n long, posts binary, square double").where("square > 0")
    vectors = landed(vectors, "vectors")
    rows = min(BUCKET_ROWS, max(top, BUCKET_BYTES // (POST.itemsize * len(vocabulary))))
    longest = vectors.orderBy(F.desc("square"), "doc").limit(rows).select("doc", "n", "posts").toArrow()
    first = Best(len(items), np.zeros(len(items), np.int64), top)
    for bucket in _buckets(longest.to_batches(), *what):
        for i, own in enumerate(wanted):
            first.add(i, *bucket.search(own, weights, 0))
    floors = first.floors

    def search(batches):
        best = Best(len(wanted), floors, top)
        for bucket in _buckets(batches, *what):
            for i, own in enumerate(wanted):
                scores, keys = bucket.search(own, weights, int(best.floors[i]))
                if len(scores):
                    best.add(i, scores, keys)
        for i, (scores, keys) in enumerate(zip(best.scores, best.keys)):
            if len(scores):
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(scores), numbers[i])), pa.array(keys, mask=keys == LAST), pa.array(scores),
                ], ["row", "doc", "score"])

    # By id as well: a third of all texts may have the same length.
    dealt = vectors.repartitionByRange(F.desc("square"), F.asc("doc"), F.xxhash64("posts")).sortWithinPartitions(F.desc("square"))
    return dealt.select("doc", "n", "posts").mapInArrow(search, "row long, doc long, score long")


def search(docs: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", top: int = TOP) -> DataFrame:
    """Rows (item, rank, key, score): the ``top`` documents with the highest scores above 0 of each item."""
    rows = landed(items.select(F.col(item).alias("item"), F.col(item_text).alias("text")).withColumn("row", F.monotonically_increasing_id()), "items")
    asked = landed(_item_terms(rows, "text"), "item-terms")
    blocks = -(-(asked.agg(F.sum(F.size("terms"))).first()[0] or 0) // BLOCK_TERMS)
    found = docs.sparkSession.createDataFrame([], "row long, doc long, score long")
    for block in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == block).orderBy("row").collect()
        if own:
            part = _found_in(docs, key, text, [(r.row, [bytes(t) for t in r.terms]) for r in own], top)
            found = found.union(landed(part, "found"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), F.asc_nulls_last("doc"))))
    ranked = ranked.where(F.col("rank") <= top).join(rows.select("row", "item"), "row")
    return ranked.select(F.col("item").alias(item), "rank", F.col("doc").alias(key), "score")
