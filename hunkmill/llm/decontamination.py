"""Benchmark decontamination by SimHash of item-sized windows, with DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words (fewer where an item has
fewer). A window has as many words as an item; a text shorter than the item is one window. Every start
counts. A window is similar only if the shingles it shares with the item weigh at least 0.75 of the
item (both sides of the similarity's bound), so starts are tried within an item's length around shared
shingles, and those that share less are left out before a window is cut; no similar one is among them.

The 64-bit SimHash of a window, weighted by how rare a shingle is among the items, is looked up in an
index of the items' fingerprints: 8 blocks of 8 bits, each with all values that differ in at most 2
bits. Fingerprints within ``RADIUS`` = 23 bits agree up to 2 bits in at least one block (8 blocks with
3 differences would be 24), so none is missed. What is found is verified by the exact weighted Jaccard
similarity of the shingles, at least 0.75. At that bound fingerprints differ in 11 bits on average with
a deviation of 3.

Edge cases: null and empty texts match nothing; items without words are left out; items that repeat a
number and a text count once; repeated document ids give the matches of all their rows; a null id is
kept as null; empty tables give an empty table; extra columns are ignored.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.llm.sized import sent_if_small
from hunkmill.session import landed

WIDTH, SIMILARITY = 5, 0.75
BLOCKS, BLOCK_BITS, BLOCK_RADIUS = 8, 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _shingle_rows(words: str, width: int) -> Column:
    """Generator of (at, zipped): the words at each place and the ``width - 1`` after it."""
    shifted = [F.slice(words, F.lit(k + 1), F.greatest(F.size(words) - (width - 1), F.lit(0))).alias(f"w{k}") for k in range(width)]
    return F.posexplode(F.arrays_zip(*shifted))


def _hash(width: int) -> Column:
    return F.xxhash64(*[F.col("zipped")[f"w{k}"] for k in range(width)])


def _shingles(rows: DataFrame, width: int, *keep: str) -> DataFrame:
    """The kept columns with ``at`` and ``shingle`` for each place in ``words``."""
    return rows.select(*keep, _shingle_rows("words", width).alias("at", "zipped")).withColumn("shingle", _hash(width)).drop("zipped")


def _fingerprint(rows: DataFrame, *keys: str) -> DataFrame:
    """SimHash per key of rows (keys, shingle, n, weight): the bits that outweigh their absence."""
    sums = [F.sum(F.when(F.shiftrightunsigned("shingle", b).bitwiseAND(F.lit(1)) == 1, F.col("n") * F.col("weight")).otherwise(-F.col("n") * F.col("weight"))).alias(f"b{b}") for b in range(64)]
    bits = [F.when(F.col(f"b{b}") > 0, F.lit(1 << b if b < 63 else -(1 << 63))).otherwise(F.lit(0)) for b in range(64)]
    fingerprint = bits[0].cast("long")
    for bit in bits[1:]:
        fingerprint = fingerprint.bitwiseOR(bit.cast("long"))
    return rows.groupBy(*keys).agg(F.sum(F.col("n") * F.col("weight")).alias("total"), *sums).select(*keys, "total", fingerprint.alias("fingerprint"))


def _near_values(block: Column) -> Column:
    """The block value and all that differ from it in up to ``BLOCK_RADIUS`` bits."""
    masks = [sum(1 << b for b in bits) for n in range(BLOCK_RADIUS + 1) for bits in combinations(range(BLOCK_BITS), n)]
    return F.transform(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: block.bitwiseXOR(m))


def _blocks(fingerprint: str) -> list[Column]:
    return [F.shiftrightunsigned(fingerprint, BLOCK_BITS * b).bitwiseAND(F.lit((1 << BLOCK_BITS) - 1)) for b in range(BLOCKS)]


def _id(*columns: str) -> Column:
    """128 bits for the values, which may be null."""
    return F.struct(F.xxhash64(*columns).alias("a"), F.xxhash64(F.lit(1), *reversed(columns)).alias("b"))


def _starts(hits: DataFrame) -> DataFrame:
    """Rows (text, item, size, n_words, start, aligned): the window starts at which the shared shingles
    weigh enough for the item. Aligned: one of them stands at the place it has in the item."""
    enough = F.col("weights") >= (SIMILARITY - 1e-6) * F.col("item_total")
    same = hits.groupBy("text", "item", "item_total", "shingle").agg(F.first(F.col("item_n")).alias("item_n"), F.first("weight").alias("weight"), F.count("*").alias("n"))
    pairs = same.groupBy("text", "item", "item_total").agg(F.sum(F.least("n", "item_n") * F.col("weight")).alias("weights"))
    likely = hits.join(pairs.where(enough).select("text", "item"), ["text", "item"], "left_semi")
    first = F.greatest(F.lit(0), F.col("at") - F.col("n_words") + F.col("width"))
    last = F.least(F.col("at"), F.greatest(F.lit(0), F.col("size") - F.col("n_words")))
    tried = likely.withColumn("start", F.explode(F.sequence(first, last)))
    aligned = F.max(F.array_contains("places", F.col("at") - F.col("start"))).alias("aligned")
    sums = tried.groupBy("text", "item", "item_total", "size", "n_words", "start").agg(F.sum("weight").alias("weights"), aligned)
    return sums.where(enough).select("text", "item", "size", "n_words", "start", "aligned")


def find_leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """Rows (key, item, start, n_words, similarity, aligned): all windows of documents that are similar to
    an item; start counts words. Aligned windows share a shingle at the place it has in the item."""
    items = benchmark.select(F.col(item).alias("item"), words_of(F.col(item_text)).alias("words")).withColumn("n_words", F.size("words"))
    items = landed(items.where("n_words > 0").distinct(), "items")
    widths = sorted(r[0] for r in items.select(F.least("n_words", F.lit(WIDTH))).distinct().collect()) or [WIDTH]
    rows = docs.select(F.col(key).alias("doc"), words_of(F.col(text)).alias("words")).withColumn("text", _id("doc", "words"))
    width_of = F.least(F.col("n_words"), F.lit(WIDTH))

    item_shingles = None
    for width in widths:
        part = _shingles(items.where(width_of == width), width, "item", "n_words").withColumn("width", F.lit(width))
        item_shingles = part if item_shingles is None else item_shingles.union(part)
    item_shingles = landed(item_shingles, "item-shingles")
    total = items.count()
    rarity = item_shingles.groupBy("shingle").agg(F.log1p(F.lit(float(total)) / F.count_distinct("item")).alias("weight"))
    rarity = landed(rarity, "item-weights")
    usual = F.log1p(F.lit(float(total)))
    counted_items = landed(item_shingles.groupBy("item", "n_words", "shingle").agg(F.count("*").alias("n")).join(rarity, "shingle"), "item-counts")
    prints = landed(_fingerprint(counted_items, "item", "n_words"), "item-prints")

    known = item_shingles.groupBy("item", "n_words", "width", "shingle").agg(F.count("*").alias("item_n"), F.collect_list("at").alias("places"))
    known = known.join(rarity, "shingle").join(prints.select("item", "n_words", F.col("total").alias("item_total")), ["item", "n_words"])
    known = sent_if_small(landed(known, "item-places"), 80)
    hits = None
    for width in widths:
        found = rows.select("text", F.size("words").alias("size"), _shingle_rows("words", width).alias("at", "zipped")).withColumn("shingle", _hash(width)).drop("zipped")
        found = found.join(known.where(F.col("width") == width), "shingle")
        hits = found if hits is None else hits.union(found)
    starts = landed(_starts(landed(hits, "hits")), "starts")
    leaking = landed(starts.select("text").distinct(), "likely-texts")
    leaking = landed(rows.join(sent_if_small(leaking, 24), "text", "left_semi").dropDuplicates(["text"]), "likely-words")
    windows = starts.join(leaking, "text").withColumn("words", F.slice("words", F.col("start") + 1, F.least("n_words", "size")))
    windows = landed(windows.select("doc", "item", "start", "n_words", "aligned", "words", _id("words").alias("window")), "windows")
    lengths = windows.select("window", "n_words").distinct()

    counted = None
    texts = windows.select("window", "words").dropDuplicates(["window"])
    for width in widths:
        # A window shorter than its item has the width of long items.
        part = _shingles(texts.where(F.least(F.size("words"), F.lit(WIDTH)) == width), width, "window")
        counted = part if counted is None else counted.union(part)
    counted = counted.groupBy("window", "shingle").agg(F.count("*").alias("n"))
    counted = counted.join(sent_if_small(rarity, 24), "shingle", "left").withColumn("weight", F.coalesce("weight", usual))
    counted = landed(counted, "window-counts")

    asked = _fingerprint(counted, "window").join(lengths, "window").select("*", F.posexplode(F.array(*_blocks("fingerprint"))).alias("block", "value"))
    index = prints.select("item", "n_words", F.col("total").alias("item_total"), F.col("fingerprint").alias("item_print"), F.posexplode(F.array(*[_near_values(b) for b in _blocks("fingerprint")])).alias("block", "values"))
    index = landed(index.select("item", "n_words", "item_total", "item_print", "block", F.explode("values").alias("value")), "item-index")
    close = asked.join(sent_if_small(index, 48), ["n_words", "block", "value"])
    close = close.where(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_print"))) <= RADIUS)
    pairs = close.select("window", "item", "n_words", "total", "item_total").distinct()

    shared = pairs.join(counted.select("window", "shingle", "n", "weight"), "window")
    shared = shared.join(sent_if_small(counted_items.select("item", "shingle", F.col("n").alias("item_n")), 28), ["item", "shingle"])
    least = F.sum(F.least("n", "item_n") * F.col("weight"))
    sums = shared.groupBy("window", "item", "total", "item_total").agg(least.alias("shared"))
    similarity = F.round(F.col("shared") / (F.col("total") + F.col("item_total") - F.col("shared")), 9)
    verified = sums.withColumn("similarity", similarity).where(F.col("similarity") >= SIMILARITY).select("window", "item", "similarity")
    out = windows.select("window", "doc", "item", "start", F.size("words").alias("n_words"), "aligned").join(verified, ["window", "item"])
    return out.select(F.col("doc").alias(key), F.col("item").alias(item), F.col("start").cast("long").alias("start"), F.col("n_words").cast("long").alias("n_words"), "similarity", "aligned")
