"""Quality rules: an isolation forest on rule statistics, calibrated on labelled rows.

The statistics of a text are counted in one pass. A forest is fitted on all labelled rows that pass the
base rule and fall, by a hash of their id, into one half; the other half decides. Random splits separate
odd rows early, so short paths mean anomalies. Every row of the first half is dealt to a tree, and to
more of them while trees would have fewer than ``TREE_ROWS`` rows; bad rows weigh ``BAD_SHARE`` of a
tree at most, and what is left in a leaf counts as its share of ``TREE_ROWS``, so that scores do not
depend on the number of rows. Being odd is not being bad, so the labels also choose the statistics the
forest splits on: one after the other, as long as more bad rows of the other half score above the
threshold. The threshold is the lowest one at which at most ``MOST_FALSE`` of that half's good rows would
go, by running totals over all their scores; between it and the next bad row it lies in the middle. All
rows are then scored with the fitted forest, in the same pass that counts.

Trees are grown by Spark, one group of rows each; the driver sees trees and a row per attempt.

Edge cases: a null or empty text has no words and fails the base rule; without labelled good and bad
rows nothing but the base rule rejects; repeated document ids get a row each; null ids stay null;
labels given twice count as bad if one of them is; extra columns are kept by ``judged``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from hunkmill.llm.dealing import groups
from hunkmill.llm.word_ids import forget, utf8
from hunkmill.operators.ordered import running_totals
from hunkmill.session import landed

TREES, TREE_ROWS = 100, 256
#: Trees of a forest that is only grown to choose statistics.
TRIAL_TREES = 25
#: Weight of bad rows in a tree, at most: little, so that they are isolated early.
BAD_SHARE = 0.04
#: Share of good labelled rows that the threshold may reject.
MOST_FALSE = 0.001
SEED = 20

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks"]


def _among(letters: bytes) -> np.ndarray:
    found = np.zeros(256, bool)
    found[list(letters)] = True
    return found


WHITE, SYMBOLS, UPPER, MARKS = _among(b" \t\n\r\x0b\x0c"), _among(b"#*$%&|<>"), _among(bytes(range(65, 91))), _among(b".,!?;:")


def repeated_words(words: list[bytes], width: int = 5) -> int:
    """Words that lie in a window of ``width`` words found twice or more in the list."""
    numbers = {w: i for i, w in enumerate(dict.fromkeys(words))}
    if len(words) <= width or len(numbers) == len(words):
        return 0
    ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
    codes, spread = ids, len(numbers)
    for step in range(1, width):
        if spread * len(numbers) >= 1 << 62:
            codes = np.unique(codes, return_inverse=True)[1]
            spread = int(codes.max()) + 1
        codes, spread = codes[:-1] * len(numbers) + ids[step:], spread * len(numbers)
    ordered = np.sort(codes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return 0
    starts = np.flatnonzero(np.isin(codes, twice))
    change = np.bincount(starts, minlength=len(words) + 1)[: len(words) + 1] - np.bincount(starts + width, minlength=len(words) + 1)[: len(words) + 1]
    return int((np.cumsum(change)[: len(words)] > 0).sum())


def statistics(text: bytes) -> tuple[int, ...]:
    """The numbers of ``COUNTS`` for a whole UTF-8 text."""
    raw = np.frombuffer(text, np.uint8)
    words = text.split()
    lines = [line for line in text.split(b"\n") if line.strip()]
    letters = (raw & 0xC0) != 0x80
    return (
        len(words), int((letters & ~WHITE[raw]).sum()), int(SYMBOLS[raw].sum()), len(lines) - len(set(lines)),
        repeated_words(words), len(lines), int(UPPER[raw].sum()), int(MARKS[raw].sum()),
    )


def features(counts: np.ndarray) -> np.ndarray:
    """Shares per word, letter or line, drawn towards 0 for short texts, which vary more by chance."""
    n, chars, symbols, dup, repeat, lines, upper, marks = counts.astype(float).T
    return np.stack([symbols / (n + 20), repeat / (n + 20), dup / (lines + 5), upper / (chars + 100), marks / (n + 20), chars / (n + 20)], axis=1)


def _usual_path(rows: int) -> float:
    """Mean path of an unsuccessful search among this many rows."""
    return 0.0 if rows < 2 else 2.0 * (np.log(rows - 1) + 0.5772156649015329) - 2.0 * (rows - 1) / rows


class Tree:
    """Random splits of weighted rows, down to single ones or ``TREE_ROWS`` parts.

    ``nodes`` has a row each of column (-1: a leaf), cut, left and right node, path.
    """

    def __init__(self, rows: np.ndarray, weights: np.ndarray, columns: list[int], seed: list[int]):
        self.rows, self.weights, self.columns = rows, weights, np.array(columns)
        self.random = np.random.default_rng(seed)
        total = weights.sum()
        self.share = min(1.0, TREE_ROWS / total)
        self.depth = int(np.ceil(np.log2(max(2.0, total * self.share))))
        self.grown: list[list[float]] = []
        self._grow(np.arange(len(rows)), 0)
        self.nodes = np.array(self.grown)

    def _grow(self, part: np.ndarray, depth: int) -> int:
        place = len(self.grown)
        values = self.rows[part][:, self.columns]
        low, high = values.min(axis=0), values.max(axis=0)
        open_columns = np.flatnonzero(high > low)
        if depth >= self.depth or len(part) < 2 or not len(open_columns):
            self.grown.append([-1, 0.0, place, place, depth + _usual_path(self.weights[part].sum() * self.share)])
            return place
        at = int(self.random.choice(open_columns))
        cut = self.random.uniform(low[at], high[at])
        self.grown.append([self.columns[at], cut, 0, 0, 0.0])
        left = values[:, at] < cut
        self.grown[place][2] = self._grow(part[left], depth + 1)
        self.grown[place][3] = self._grow(part[~left], depth + 1)
        return place


class Forest:
    """``scores`` near 1 are odd, near 0.5 and below usual."""

    def __init__(self, trees: list[np.ndarray], rows: float):
        self.trees, self.usual = trees, max(_usual_path(min(TREE_ROWS, rows)), 1e-9)

    def scores(self, rows: np.ndarray) -> np.ndarray:
        total, every = np.zeros(len(rows)), np.arange(len(rows))
        for tree in self.trees:
            column, left, right = tree[:, 0].astype(np.int64), tree[:, 2].astype(np.int64), tree[:, 3].astype(np.int64)
            at = np.zeros(len(rows), np.int64)
            while True:
                on = column[at]
                if (on < 0).all():
                    break
                at = np.where(rows[every, on] < tree[at, 1], left[at], right[at])
            total += tree[at, 4]
        return 2.0 ** (-total / len(self.trees) / self.usual)


class Judge:
    """The base rule, and the forest with its threshold (None: no labelled rows to fit on)."""

    def __init__(self, forest: Forest | None, threshold: float):
        self.forest, self.threshold = forest, threshold

    def __call__(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, repeat = counts[:, 0], counts[:, 4]
        failed = (n < 10) | (100 * repeat > 20 * n)
        scores = self.forest.scores(features(counts)) if self.forest and len(counts) else np.zeros(len(counts))
        return failed, scores, ~failed & (scores < self.threshold)


def _counted(batch, text: str) -> np.ndarray:
    return np.array([statistics(t) for t in utf8(batch[text])], np.int64).reshape(-1, len(COUNTS))


def _labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, quality: str) -> DataFrame:
    """(bad, held, place, features) of the labelled rows that pass the base rule, one for each id."""

    def count(batches):
        forget()
        for batch in batches:
            counts = _counted(batch, "text")
            yield pa.RecordBatch.from_arrays([batch["key"], *map(pa.array, counts.T)], ["key", *COUNTS])

    def shown(batches):
        for batch in batches:
            counts = np.stack([batch[c].to_numpy() for c in COUNTS], axis=1)
            passing = ~Judge(None, np.inf)(counts)[0]
            values = features(counts[passing])
            told = batch.filter(pa.array(passing))
            yield pa.RecordBatch.from_arrays([
                told["bad"], told["held"], told["place"], pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), values.shape[1]).cast(pa.list_(pa.float64())),
            ], ["bad", "held", "place", "features"])

    known = labels.where(F.col(key).isNotNull() & F.col(quality).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(quality).cast("long").alias("quality"))
    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).where("key IS NOT NULL")
    counted = rows.mapInArrow(count, f"key {kind}, " + ", ".join(f"{c} long" for c in COUNTS))
    # A labelled id may repeat without end; one row of it is enough.
    one = counted.join(known, "key").groupBy("key").agg(F.max(F.struct("quality", *COUNTS)).alias("row"))
    place = F.xxhash64("key", F.lit(SEED))
    asked = one.select((F.col("row.quality") == 0).alias("bad"), (F.pmod(place, F.lit(2)) == 1).alias("held"), F.shiftright(place, 1).alias("place"), *[f"row.{c}" for c in COUNTS])
    return landed(asked.mapInArrow(shown, "bad boolean, held boolean, place long, features array<double>"), "labelled-features")


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _grown(rows: DataFrame, good: int, bad: int, attempts: list[list[int]], trees: int) -> list[Forest]:
    """A forest for each choice of columns. All rows are used: each is dealt to one tree or, while trees
    would have fewer than ``TREE_ROWS`` rows, to several."""
    copies = min(trees, -(-trees * TREE_ROWS // (good + bad)))
    weight = min(1.0, BAD_SHARE / (1 - BAD_SHARE) * good / bad)

    def work(batches):
        for group in groups(batches, "tree"):
            group = group.combine_chunks()
            tree = group["tree"][0].as_py()
            values = _matrix(group["features"].combine_chunks())
            weights = np.where(group["bad"].to_numpy(), weight, 1.0)
            grown = [Tree(values, weights, columns, [SEED, tree, i]).nodes.tobytes() for i, columns in enumerate(attempts)]
            yield pa.RecordBatch.from_arrays([pa.array([tree] * len(attempts), pa.int32()), pa.array(range(len(attempts)), pa.int32()), pa.array(grown, pa.binary())], ["tree", "attempt", "nodes"])

    copy = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    dealt = rows.select("bad", "place", "features", copy.alias("copy")).select(
        F.pmod(F.pmod("place", F.lit(trees)) + F.col("copy"), F.lit(trees)).cast("int").alias("tree"), "bad", "place", "features",
    )
    # In one order, whatever the tasks were: splits follow from the rows.
    dealt = dealt.repartition(min(trees, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), "tree").sortWithinPartitions("tree", "place", "bad", "features")
    found = sorted(dealt.mapInArrow(work, "tree int, attempt int, nodes binary").collect(), key=lambda r: (r.attempt, r.tree))
    per_tree = (good + bad * weight) * copies / trees
    return [Forest([np.frombuffer(r.nodes).reshape(-1, 5) for r in found if r.attempt == i], per_tree) for i in range(len(attempts))]


def _told(rows: DataFrame, good: int, forests: list[Forest]) -> list[tuple[int, float]]:
    """For each forest how many bad rows score above the threshold, and the threshold."""

    def work(batches):
        for batch in batches:
            values = _matrix(batch["features"])
            scores = np.concatenate([forest.scores(values) for forest in forests])
            attempt = np.repeat(np.arange(len(forests), dtype=np.int32), len(values))
            yield pa.RecordBatch.from_arrays([pa.array(attempt), pa.array(scores), pa.array(np.tile(batch["bad"].to_numpy(zero_copy_only=False), len(forests)))], ["attempt", "score", "bad"])

    scored = rows.select("features", "bad").mapInArrow(work, "attempt int, score double, bad boolean")
    counts = running_totals(scored, "score", {"good": F.count_if(~F.col("bad")), "odd": F.count_if("bad")}, ["attempt"])
    # Scores are counted from above: the first with as many good rows as may go, and one more, is allowed.
    above = F.col("run_good") <= int(MOST_FALSE * good)
    found = counts.groupBy("attempt").agg(
        F.max(F.when(~above, F.col("score"))).alias("allowed"), F.coalesce(F.sum(F.when(above, F.col("odd"))), F.lit(0)).alias("caught"),
        F.min(F.when(above & (F.col("odd") > 0), F.col("score"))).alias("next"),
    ).collect()
    return [(r.caught, float((r.allowed + r.next) / 2 if r.caught else np.nextafter(r.allowed, np.inf))) for r in sorted(found, key=lambda r: r.attempt)]


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", quality: str = "quality") -> Judge:
    """The judge, from all labelled rows."""
    rows = _labelled(docs, labels, key, text, quality)
    sizes = {(r.held, r.bad): r.n for r in rows.groupBy("held", "bad").agg(F.count("*").alias("n")).collect()}
    good, bad, held_good = sizes.get((False, False), 0), sizes.get((False, True), 0), sizes.get((True, False), 0)
    if not good or not bad or not held_good:
        return Judge(None, np.inf)
    first, second = rows.where("NOT held"), rows.where("held")

    def attempt(columns: list[list[int]], trees: int) -> list[tuple[int, Judge]]:
        forests = _grown(first, good, bad, columns, trees)
        return [(caught, Judge(forest, threshold)) for forest, (caught, threshold) in zip(forests, _told(second, held_good, forests))]

    chosen: list[int] = []
    caught, width = 0, features(np.zeros((1, len(COUNTS)))).shape[1]
    while len(chosen) < width:
        left = [c for c in range(width) if c not in chosen]
        best, column = max((n, -c) for (n, _), c in zip(attempt([[*chosen, c] for c in left], TRIAL_TREES), left))
        if best <= caught:
            break
        caught = best
        chosen.append(-column)
    return attempt([chosen], TREES)[0][1] if chosen else Judge(None, np.inf)


def judged(docs: DataFrame, judge: Judge, text: str = "text") -> DataFrame:
    """All rows and columns, with ``verdict``: the counts, base_failed, anomaly and kept."""
    added = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField("base_failed", BooleanType()), StructField("anomaly", DoubleType()), StructField("kept", BooleanType())])

    def work(batches):
        forget()
        for batch in batches:
            counts = _counted(batch, "text")
            failed, scores, kept = judge(counts)
            yield pa.RecordBatch.from_arrays([batch["all"], pa.StructArray.from_arrays([pa.array(c) for c in (*counts.T, failed, scores, kept)], [*COUNTS, "base_failed", "anomaly", "kept"])], ["all", "verdict"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("all"), F.col(text).cast("string").alias("text"))
    schema = StructType([StructField("all", docs.schema), StructField("verdict", added)])
    return rows.mapInArrow(work, schema).select("all.*", "verdict")
