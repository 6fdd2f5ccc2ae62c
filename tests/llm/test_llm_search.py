"""The Merkle manifest, ranked search and covering SimHash, against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from hunkmill.llm import covering, lexical_search, merkle
from hunkmill.session import importable_by_workers

DOCS = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable_by_workers(spark)


# The Merkle manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row):
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def plain_tree(nodes):
    """All levels, the last with one node."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([sha(*last[i:i + 16]) for i in range(0, len(last), 16)])
    return levels


def plain_path(levels, at):
    for level in levels[:-1]:
        start = at // 16 * 16
        yield level[start:at], level[at + 1:start + 16]
        at //= 16


def plain_manifest(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    order = {s: sorted((r for r in rows if r[1] == s), key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r))) for s in sources}
    trees = {s: plain_tree([plain_leaf(r) for r in order[s]]) for s in sources}
    over = plain_tree([trees[s][-1][0] for s in sources])
    out = []
    for place, s in enumerate(sources):
        for at, row in enumerate(order[s]):
            path = [*plain_path(trees[s], at), *plain_path(over, place)]
            now = plain_leaf(row)
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0 and row[4] is not None:
                now = plain_leaf((*row[:4], re.sub("[A-Z]", lambda m: m[0].lower(), row[4])))
            for before, after in path:
                now = sha(*before, now, *after)
            proof = sha(*[x for before, after in path for x in (*before, *after)])
            out.append((row[0], plain_leaf(row), trees[s][-1][0], over[-1][0], proof, now, now == over[-1][0]))
    return out


def rows_of(n, sources, seed=3):
    dice = random.Random(seed)
    return [(i * 7 % 1009, sources[min(dice.randrange(2 * len(sources)), len(sources) - 1)], "en", i, f"Text {i} ÄB é") for i in range(n)]


@pytest.mark.parametrize("rows", [
    rows_of(700, ["a", None, "é", "b", ""]),
    rows_of(60, [f"s{i}" for i in range(25)]),
    [(1, "a", "en", 2, "Only"), (5, "b", None, None, None), (5, "b", "de", 3, ""), (None, "b", "de", 3, "X"), (5, "b", "de", 3, "")],
    [(i, "one", "en", 1, "T") for i in range(17)],
    [(7, None, None, None, None)],
    [],
])
def test_the_manifest_is_that_of_plain_trees(spark, rows):
    docs = spark.createDataFrame(rows, DOCS).withColumn("digest", F.lit(1)).withColumn("path", F.lit("x"))
    found = merkle.verified_manifest(docs.repartition(5))
    assert found.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert sorted(map(tuple, found.collect()), key=str) == sorted(plain_manifest(rows), key=str)


def test_labels_hold_what_is_below_them(spark):
    leaves = spark.range(600).select((F.col("id") % 2 * 0).alias("tree"), F.col("id").alias("at"), F.col("id").alias("low"), (F.col("id") + 1).alias("high"), F.lit(600).cast("long").alias("n"), F.lit(0).alias("tree_at"), F.sha2(F.col("id").cast("string"), 256).alias("digest"))
    levels = merkle._levels(leaves, "test")
    assert [level.count() for level in levels] == [600, 38, 3, 1]
    for level, width in zip(levels, [1, 16, 256, 4096]):
        labels = sorted((r.low, r.high) for r in level.collect())
        assert labels == [(i, min(i + width, 600)) for i in range(0, 600, width)]


# Ranked search

def plain_terms(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall("[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text or "")]


def plain_search(docs, items, top=50):
    own = [(key, plain_terms(text)) for key, text in docs]
    own = [(key, Counter(found), len(found)) for key, found in own if found]
    documents, length = len(own), sum(n for _, _, n in own)
    having = Counter(t for _, counts, _ in own for t in counts)
    out = []
    for item, text in items:
        scored = []
        for key, counts, n in own:
            m = 100 - 50 + (50 * n * documents) // length
            score = sum(
                math.floor(1000 * math.log((2 * documents + 2) / (2 * having[t] + 1))) * (1000000000 * counts[t] // (1000 * counts[t] + 20 * m))
                for t in set(plain_terms(text)) if counts[t]
            )
            if score > 0:
                scored.append((-score, (key is None, key or 0), key))
        out += [(item, rank, key, -score) for rank, (score, _, key) in enumerate(sorted(scored)[:top], 1)]
    return sorted(out, key=str)


def made_texts(n, seed, words=300, most=80):
    dice = random.Random(seed)
    names = [f"w{i}é" if i % 7 == 0 else f"W{i}" for i in range(words)]
    return [(i, " ,".join(names[int(words * dice.random() ** 3)] for _ in range(dice.randrange(1, most)))) for i in range(n)]


@pytest.mark.parametrize("rows, stretch, top", [(4096, 1 << 20, 50), (23, 16, 7)])
def test_the_best_are_those_of_a_full_search(spark, monkeypatch, rows, stretch, top):
    monkeypatch.setattr(lexical_search, "BUCKET_ROWS", rows)
    monkeypatch.setattr(lexical_search, "STRETCH", stretch)
    docs = made_texts(900, 1) + [(3000 + i, "w1 w2 w3 same text") for i in range(80)] + [(901, None), (902, ""), (903, "-- __"), (None, "w5 w9")]
    items = made_texts(25, 2, most=30) + [(100, "w1 w1 W2 text"), (101, None), (102, "nowhere"), (103, "w5"), (100, "w9")]
    table = spark.createDataFrame(docs, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("score", F.lit("x"))
    found = lexical_search.search(table.repartition(4), spark.createDataFrame(items, "item_id long, text string"), top=top)
    assert found.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items, top)


def test_search_in_blocks_of_items(spark, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_TERMS", 40)
    docs, items = made_texts(120, 3), made_texts(12, 4, most=20)
    found = lexical_search.search(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(map(tuple, found.collect()), key=str) == plain_search(docs, items)


def test_search_of_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, item_id long, text string")
    some = spark.createDataFrame([(1, 1, "word")], "doc_id long, item_id long, text string")
    for docs, items in [(none, some), (some, none), (none, none)]:
        assert lexical_search.search(docs, items).collect() == []


def test_bounds_leave_buckets_and_texts_out():
    """With a floor, texts are left out before they are scored, and none that reaches it is."""
    dice = np.random.default_rng(1)
    weights = np.array([1, 5, 400, 3000, 9000])
    posts = [np.array([(t, dice.integers(1, 9)) for t in range(5) if dice.random() < [0.9, 0.9, 0.5, 0.1, 0.05][t]], lexical_search.POST) for _ in range(2000)]
    lengths = dice.integers(5, 90, 2000)
    bucket = lexical_search.Bucket(np.arange(2000), lengths, posts, weights, 2000, int(lengths.sum()))
    wanted = np.arange(5)
    every, keys = bucket.search(wanted, weights, 0)
    floor = int(np.sort(every)[-20])
    some, found = bucket.search(wanted, weights, floor)
    assert sorted(zip(some, found)) == sorted((s, k) for s, k in zip(every, keys) if s >= floor)
    assert len(bucket.search(wanted, weights, int(every.max()) * 3)[0]) == 0


# Covering SimHash

def plain_print(text):
    words = re.sub("[A-Z]", lambda m: m[0].lower(), text or "").encode().split()
    parts = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_near(rows):
    prints = [plain_print(text) for _, text in rows]
    linked = [[j for j, q in enumerate(prints) if (p ^ q).bit_count() <= 2] for p in prints]
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            new = [j for j in linked[todo.pop()] if j not in seen]
            seen.update(new)
            todo += new
        ids = [rows[j][0] for j in seen if rows[j][0] is not None]
        out.append((key, f"{prints[i]:016x}", len(linked[i]) - 1, min(ids) if ids else None))
    return sorted(out, key=str)


def test_two_positions_are_always_left_out_by_a_table():
    masks = covering.covering_masks()
    assert len(masks) == 7
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


@pytest.mark.parametrize("stretch", [1 << 20, 7])
def test_fingerprints_equal_plain_ones(monkeypatch, stretch):
    monkeypatch.setattr(covering, "STRETCH", stretch)
    for text in ["", " \t\n", "one", "Two WORDS", "a b c", "a  b\x0bc d", "Ünï Ä b c d e f " * 40, "x y " * 300]:
        assert covering.fingerprint(text.encode()) == plain_print(text)


def test_classes_and_links_equal_those_of_all_pairs(spark):
    dice = random.Random(5)
    base = [" ".join(f"w{dice.randrange(2000)}" for _ in range(200)) for _ in range(12)]
    rows = []
    for text in base:
        for _ in range(14):
            words = text.split()
            for _ in range(dice.randrange(4)):
                words[dice.randrange(len(words))] = "changed"
            rows.append((len(rows), " ".join(words)))
    rows += [(500 + i, base[0]) for i in range(30)] + [(600, None), (601, ""), (None, ""), (602, "one word"), (602, "One  word"), (603, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("print", F.lit(1)).withColumn("copies", F.lit("x"))
    found = covering.near_duplicates(docs.repartition(6))
    assert sorted(map(tuple, found.collect()), key=str) == plain_near(rows)
    assert len({r[3] for r in found.collect()}) < len(rows) - 50


def test_near_duplicates_of_planted_fingerprints(spark, monkeypatch):
    """Links of all kinds, also chains, with fingerprints given as numbers."""
    dice = random.Random(9)
    prints = []
    for _ in range(40):
        p = dice.getrandbits(64)
        for _ in range(dice.randrange(1, 9)):
            prints.append(p)
            for _ in range(dice.randrange(4)):
                p ^= 1 << dice.randrange(64)
    rows = list(enumerate(prints))
    given = spark.createDataFrame([(k, p - (1 << 64) if p >> 63 else p) for k, p in rows], "doc long, print long")
    monkeypatch.setattr(covering, "fingerprints", lambda *_: given)
    found = covering.near_duplicates(given)
    monkeypatch.setitem(globals(), "plain_print", lambda text: text)
    assert sorted(map(tuple, found.collect()), key=str) == plain_near(rows)


def test_near_duplicates_of_an_empty_table(spark):
    assert covering.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []
