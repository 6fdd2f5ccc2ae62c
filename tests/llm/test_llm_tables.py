"""The Jaccard join, mixing, line templates, decontamination and the pipeline."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from hunkmill.llm import decontamination, graphs, jaccard, line_templates, mixing
from hunkmill.session import importable_by_workers, landed

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable_by_workers(spark)


# The Jaccard join

def shingle_set(text):
    words = (text or "").encode().lower().split()
    if len(words) < 5:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(tuple(words[i:i + 5]) for i in range(len(words) - 4))


def plain_classes(rows):
    sets = {k: shingle_set(t) for k, t in rows}
    parent = {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    keys = sorted(sets)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {k: (len(sets[k]), root(k)) for k in keys}


def plain_links(rows):
    sets = [shingle_set(t) for _, t in rows]
    linked = lambda a, b: bool(c := len(a & b)) and 100 * c >= 75 * (len(a) + len(b) - c)
    return [sum(linked(a, b) for j, b in enumerate(sets) if j != i) for i, a in enumerate(sets)]


def copies(seed, groups=6, members=12, words=60):
    """Families of near copies, a passage many share, exact copies and short texts."""
    draw = random.Random(seed)
    word = lambda: f"w{draw.randint(0, 5000)}"
    passage = [word() for _ in range(30)]
    texts = []
    for _ in range(groups):
        base = [word() for _ in range(words)]
        for _ in range(members):
            own = list(base)
            for _ in range(draw.randint(0, 3)):
                own[draw.randrange(len(own))] = word()
            texts.append(" ".join(own + (passage if draw.random() < 0.4 else [])))
    texts += [" ".join([word() for _ in range(12)] + passage) for _ in range(12)]
    texts += [texts[0].upper(), texts[0], "a b", "A  b", "a b c", "", None, " \n", "x"]
    draw.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("block", [1024, 5])
def test_classes_equal_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    rows = copies(block)
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"key": F.lit(1), "size": F.lit("clash")})
    found = jaccard.jaccard_classes(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_classes(rows)
    assert {r.doc_id: r.n_links for r in found} == dict(zip([k for k, _ in rows], plain_links(rows)))


def test_classes_of_odd_tables(spark):
    rows = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (5, None), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.n_links) for r in jaccard.jaccard_classes(docs).collect()), key=str)
    assert got == sorted([(1, 2, 1, 2), (1, 2, 1, 2), (None, 2, 1, 2), (5, 0, 5, 0), (None, 0, None, 0), (7, 0, 7, 0)], key=str)
    assert jaccard.jaccard_classes(docs.limit(0)).count() == 0


def test_links_in_a_group_equal_all_pairs():
    draw = np.random.default_rng(4)
    base = draw.integers(1, 1 << 60, 60, dtype=np.uint64)
    tokens = [np.unique(np.concatenate([draw.permutation(base)[: draw.integers(40, 60)], draw.integers(1, 1 << 60, draw.integers(0, 6), dtype=np.uint64)])) for _ in range(60)]
    counts = Counter(t for s in tokens for t in s.tolist())
    sizes = np.array([len(s) for s in tokens])
    lists = [np.array(sorted((t for t in s.tolist() if counts[t] > 1), key=lambda t: (counts[t], t)), np.uint64) for s in tokens]
    keys, times = np.arange(60), draw.integers(1, 5, 60)
    pairs = [(i, j) for i in range(60) for j in range(i) if 100 * (c := len(np.intersect1d(tokens[i], tokens[j]))) >= 75 * (sizes[i] + sizes[j] - c)]
    for side in (None, np.arange(60) % 3 == 0):
        edges, told = jaccard.links(keys, sizes, lists, times, side)
        kept = [(i, j) for i, j in pairs if side is None or side[i] != side[j]]
        assert plain_components(60, edges) == plain_components(60, kept)
        want = np.zeros(60, np.int64)
        for i, j in kept:
            want[i] += times[j]
            want[j] += times[i]
        assert told.tolist() == want.tolist()


def plain_components(count, edges):
    label = list(range(count))
    for a, b in edges:
        x, y = label[a], label[b]
        label = [min(x, y) if v in (x, y) else v for v in label]
    return label


def test_parts_of_a_graph(spark):
    draw = random.Random(5)
    names = [draw.randrange(-(1 << 62), 1 << 62) for _ in range(60)]
    edges = [(i, i + 1) for i in range(30)] + [(40, 41), (41, 42), (50, 50)]
    frame = spark.createDataFrame([(names[a], names[b]) for a, b in edges], "a long, b long")
    got = {r.node: r.part for r in graphs.connected(frame).collect()}
    assert len(got) == 34
    assert len({got[names[i]] for i in range(31)}) == 1 and len({got[names[i]] for i in (40, 41, 42)}) == 1 and len(set(got.values())) == 2
    assert graphs.connected(frame.limit(0)).count() == 0


# Mixing

def test_rates_meet_the_targets(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    docs = docs.withColumns({"rate": F.lit("clash"), "words": F.lit(0)})
    weights = {"clean": 0.9, "toxic": 0.07, "low": 0.03}
    rated, classifier = mixing.with_rates(docs, mixing.label_domains(labels), weights)
    rows = rated.collect()
    assert len(rows) == docs.count() and min(r.rate for r in rows) >= 0
    total = sum(r.n_tokens for r in rows)
    for place, domain in enumerate(classifier.domains):
        assert sum(r.n_tokens * r.posterior[place] * r.rate for r in rows) == pytest.approx(weights[domain] * total, rel=1e-3)
    assert all(sum(r.posterior) == pytest.approx(1) for r in rows)


def test_the_classifier_is_right_on_rows_it_has_not_seen(spark):
    folder = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text")
    domains = mixing.label_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    seen, held = domains.where("doc_id % 3 > 0"), {r.doc_id: r.domain for r in domains.where("doc_id % 3 = 0").collect()}
    classifier = mixing.fit(docs, seen)
    rows = mixing.with_posteriors(docs, classifier).where("row.doc_id % 3 = 0").collect()
    right = [classifier.domains[int(np.argmax(r.posterior))] == held[r.row.doc_id] for r in rows if r.row.doc_id in held]
    assert np.mean(right) > 0.93


def test_toxic_documents_of_every_language_are_told(spark):
    folder = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "lang", "text")
    domains = mixing.label_domains(spark.read.parquet(f"{folder}/labels.parquet"))
    classifier = mixing.fit(docs, domains.where("doc_id % 3 > 0"))
    toxic, clean = (classifier.domains.index(d) for d in ("toxic", "clean"))
    held = docs.join(domains.where("doc_id % 3 = 0"), "doc_id")
    rows = mixing.with_posteriors(held, classifier)
    found = {r.lang: r for r in rows.groupBy("row.lang").agg(
        F.avg(F.when(F.col("row.domain") == "toxic", (F.col("posterior")[toxic] > 0.5).cast("int"))).alias("toxic"),
        F.avg(F.when(F.col("row.domain") == "clean", (F.col("posterior")[clean] > 0.5).cast("int"))).alias("clean"),
    ).collect()}
    assert len(found) == 4
    for row in found.values():
        assert row.toxic >= 0.5 and row.clean >= 0.98, found


def test_targets_that_cannot_be_met_are_told(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    _, classifier = mixing.with_rates(docs, mixing.label_domains(labels), {"clean": 0.9, "toxic": 0.07, "low": 0.03})
    assert classifier.met and classifier.reached == pytest.approx(classifier.targets, rel=1e-2)
    one = spark.createDataFrame([(1, "some words here", "x"), (2, "other words", "y")], "doc_id long, text string, domain string")
    _, classifier = mixing.with_rates(one.limit(0), one.select("doc_id", "domain"), {"x": 1.0})
    assert classifier.domains == []


def test_mixing_of_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "")], "doc_id long, text string")
    none = spark.createDataFrame([(None, "x"), (1, None)], "doc_id long, domain string")
    rated, classifier = mixing.with_rates(docs, none, {"x": 1.0})
    assert classifier.domains == [] and [r.rate for r in rated.collect()] == [1.0] * 4
    some = spark.createDataFrame([(1, "x"), (2, "y"), (1, "x")], "doc_id long, domain string")
    assert mixing.with_rates(docs, some, {"x": 1.0, "y": 0.0})[0].count() == 4
    assert mixing.with_rates(docs.limit(0), some, {"x": 1.0})[0].count() == 0


def test_small_systems_are_solved():
    assert mixing._solved([[2.0, 1.0], [1.0, 3.0]], [3.0, 5.0]) == pytest.approx([0.8, 1.4])
    assert mixing._solved([[1.0, 0.0], [0.0, 0.0]], [2.0, 0.0]) == pytest.approx([2.0, 0.0])


# Line templates

def plain_lines(rows):
    """(n_lines, places of dropped lines) by row, by the same rules in one process."""
    masked = lambda line: tuple(None if re.search(b"[0-9]", t) else t for t in line.encode().split())
    docs_of, leaf = {}, lambda t: (len(t), t[: line_templates.LEADING])
    for key, text in rows:
        for line in (text or "").split("\n"):
            if any(tokens := masked(line)):
                docs_of.setdefault(tokens, set()).add(key)
    uses = Counter()
    for tokens, docs in docs_of.items():
        for place, token in enumerate(tokens):
            uses[leaf(tokens), place, token] += len(docs)

    def end(tokens):
        depth = math.ceil(line_templates.AGREE * len(tokens) - 1e-9)
        head = sum(t is not None for t in tokens[: line_templates.LEADING])
        rest = [p for p in range(line_templates.LEADING, len(tokens)) if tokens[p] is not None]
        if head + len(rest) < depth:
            return tokens
        rest = sorted(rest, key=lambda p: (-uses[leaf(tokens), p, tokens[p]], p))[: max(0, depth - head)]
        return leaf(tokens), frozenset((p, tokens[p]) for p in rest)

    found = {}
    for tokens, docs in docs_of.items():
        found.setdefault(end(tokens), set()).update(docs)
    need = lambda t: line_templates.LONG_DOCUMENTS if len(t) >= line_templates.LONG_TOKENS else line_templates.DOCUMENTS
    drop = {t for t in docs_of if len(found[end(t)]) >= need(t)}
    return [(len(lines := text.split("\n") if text else []), [i for i, line in enumerate(lines) if masked(line) in drop]) for _, text in rows]


def check_lines(docs, rows):
    want = Counter()
    for (key, text), (count, gone) in zip(rows, plain_lines(rows)):
        kept = None if text is None else "\n".join(line for i, line in enumerate(text.split("\n")) if i not in gone)
        want[key, kept, count, len(gone)] += 1
    got = Counter((r.doc_id, r.text, r.n_lines, r.n_dropped) for r in line_templates.drop_recurring_lines(docs).collect())
    assert got == want
    return sum(len(gone) for _, gone in plain_lines(rows))


def test_recurring_templates_are_dropped_and_others_kept(spark):
    notices = [f"Copyright {1990 + i} held by the author number {i}" for i in range(5)]
    rows = [(i, "\n".join([f"{chr(97 + i)} line of its own, unlike others", notices[i % 5], f"word {chr(97 + i)}", "Cookies are used on this page"])) for i in range(8)]
    rows += [(8, "Cookies are used on that page\n\nalone here in this text"), (None, None), (9, ""), (10, "alone here in this text")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"line": F.lit(1), "leaf": F.lit("clash"), "size": F.lit("clash")})
    got = {r.doc_id: r for r in line_templates.drop_recurring_lines(docs).collect()}
    for i in range(8):
        assert got[i].text.split("\n") == [rows[i][1].split("\n")[0], f"word {chr(97 + i)}"] and (got[i].n_lines, got[i].n_dropped) == (4, 2)
    assert got[8].text == "\nalone here in this text" and got[8].n_dropped == 1
    assert (got[None].text, got[None].n_lines, got[9].text, got[10].text) == (None, 0, "", "alone here in this text")
    assert line_templates.drop_recurring_lines(docs.limit(0)).count() == 0


def test_short_and_long_lines(spark):
    long = " ".join(f"w{chr(97 + i)}" for i in range(60))
    rows = [(i, "All rights reserved.\n12 345\nOf.") for i in range(3)] + [(3, f"{long}\nOf the"), (4, f"{long} more\n{long}"), (5, "Of the\n\n \n12 345"), (5, "Of the"), (5, "Of the")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id, r.text[:8], r.n_dropped) for r in line_templates.drop_recurring_lines(docs).collect())
    assert got == [(0, "12 345", 2), (1, "12 345", 2), (2, "12 345", 2), (3, "Of the", 1), (4, "wa wb wc", 1), (5, "Of the", 0), (5, "Of the", 0), (5, "Of the\n\n", 0)]
    check_lines(docs, rows)


@pytest.mark.parametrize("broadcast", [32 << 20, -1])
def test_a_hot_leaf_follows_the_same_rule(spark, monkeypatch, broadcast):
    monkeypatch.setattr(line_templates.spread_join, "__defaults__", ("inner", (), None, max(broadcast, 0)))
    draw = random.Random(13)
    word = lambda n: "v" + "".join(draw.choice("abcdefghij") for _ in range(n))
    makes = [
        lambda: f"at the end user {word(3)} left the room {draw.randint(1, 99)} times",
        lambda: f"at the end host {word(1)} sent {word(2)} no more than {word(1)}",
        lambda: "at the end " + " ".join(word(2) for _ in range(7)),
        lambda: "at the end " + " ".join(str(draw.randint(1, 9)) for _ in range(7)),
        lambda: " ".join(word(1) for _ in range(draw.randint(0, 6))),
        lambda: "so then we saw " + " ".join(word(1) for _ in range(20)),
    ]
    rows = [(draw.choice([None, *range(1500)]), "\n".join(draw.choice(makes)() for _ in range(draw.randint(0, 6)))) for _ in range(2500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert check_lines(docs, rows) > 2000


@pytest.mark.parametrize("places", [0, 60, None])
def test_leaves_of_any_size_follow_the_same_rule(spark, monkeypatch, places):
    """Leaves that a task can hold meet there as text; no place of theirs is a row to shuffle."""
    summed = []
    ends = line_templates._ends
    monkeypatch.setattr(line_templates, "_ends", lambda lines: summed.append(lines.count()) or ends(lines))
    monkeypatch.setattr(line_templates, "TOGETHER_PLACES", 500)
    if places is not None:
        monkeypatch.setattr(line_templates, "LEAF_PLACES", places)
    draw = random.Random(29)
    word = lambda n: "".join(draw.choice("abc") for _ in range(n))
    makes = [
        lambda: f"at the {word(1)} user {word(2)} left the {word(1)} {draw.randint(1, 9)} times",
        lambda: " ".join(draw.choice([word(1), str(draw.randint(1, 2))]) for _ in range(draw.randint(0, 7))),
        lambda: "so then we saw " + " ".join(word(1) for _ in range(20)),
    ]
    rows = [(draw.choice([None, *range(90)]), "\n".join(draw.choice(makes)() for _ in range(draw.randint(0, 6)))) for _ in range(150)]
    rows += [(draw.randint(0, 90), rows[n][1]) for n in range(20)]
    assert check_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), rows) > 100
    assert (len(summed), sum(summed) > 0) == ((0, False) if places is None else (1, True))


def test_lines_of_a_real_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text")
    check_lines(docs, [(r.doc_id, r.text) for r in docs.collect()])


# Decontamination

def plain_leaks(docs, items):
    cut = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    items = {k: cut(t) for k, t in items}
    grams = {k: Counter(tuple(w[i:i + min(5, len(w))]) for i in range(len(w) - min(5, len(w)) + 1)) for k, w in items.items() if w}
    spread = Counter(g for c in grams.values() for g in c)
    weight = lambda g: math.log1p(len(grams) / spread[g]) if g in spread else math.log1p(len(grams))
    found = set()
    for key, text in docs:
        words = cut(text)
        for item, want in grams.items():
            size = len(items[item])
            for start in range(len(words) - size + 1):
                window = words[start:start + size]
                width = min(5, size)
                have = Counter(tuple(window[i:i + width]) for i in range(size - width + 1))
                shared = sum(min(n, want[g]) * weight(g) for g, n in have.items() if g in want)
                whole = sum(n * weight(g) for g, n in have.items()) + sum(n * weight(g) for g, n in want.items()) - shared
                if shared / whole >= 0.75 - 1e-12:
                    found.add((key, item, start))
    return found


def test_leaks_are_those_of_all_windows(spark):
    draw = random.Random(7)
    word = lambda: draw.choice("abcdefghij") + str(draw.randint(0, 40))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([3, 5, 12, 30, 30, 40])]
    items += [(6, None), (7, ""), (8, items[3][1]), (3, items[3][1])]
    docs = []
    for i in range(40):
        words = [word() for _ in range(draw.randint(0, 60))]
        if i % 3 == 0:
            leak = items[draw.choice([0, 1, 2, 3, 4, 5])][1].split()
            if len(leak) > 20 and i % 2:
                leak[draw.randrange(2)] = "changed"
            words[5:5] = leak
        docs.append((i, ", ".join(words).upper()))
    docs += [(40, None), (41, ""), (None, items[3][1])]
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"item_id": F.lit(1), "words": F.lit("clash"), "shingle": F.lit(0)})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("n_words", F.lit("clash"))
    got = {(r.doc_id, r.item_id, r.start) for r in decontamination.find_leaks(frame, bench).collect()}
    want = plain_leaks(docs, dict(items).items())
    assert got <= want
    # Every leaking document and item is found; windows beside the aligned one need not be.
    assert {w[:2] for w in got} == {w[:2] for w in want}
    assert decontamination.find_leaks(frame.limit(0), bench).count() == 0
    assert decontamination.find_leaks(frame, bench.limit(0)).count() == 0


def test_leaks_are_found_at_all_places(spark):
    draw = random.Random(8)
    word = lambda: draw.choice("klmnopqrst") + str(draw.randint(0, 400))
    fill = lambda: [word() for _ in range(30)]
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([20, 24, 40, 3, 9])]
    docs, want_items = [], {}

    def add(words, item):
        want_items[len(docs)] = item
        docs.append((len(docs), " ".join(words)))

    for i in (0, 1, 2):
        w = items[i][1].split()
        half = len(w) // 2
        add(w[1:] + fill(), i)                       # begins without the first word
        add(fill() + w[:-1], i)                      # ends without the last word
        add(w[:2] + w[3:] + fill(), i)               # begins without the third word
        add(w[1:], i)                                # shorter than the item
        add(fill() + w[half:] + w[:half] + fill(), i)  # halves exchanged
        add(fill() + w + w[1:], i)                   # a second time at the end
    cut = [(k, t.split()) for k, t in docs]
    long = {(k, i, s) for k, i, s in plain_leaks(docs, items)}
    frame, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    leaks = decontamination.find_leaks(frame, bench).cache()
    got = {(r.doc_id, r.item_id, r.start) for r in leaks.collect()}
    short = {(k, i, 0) for k, w in cut for i, t in items if len(w) < len(t.split())}
    assert got - short == long
    found = {g[:2] for g in got}
    assert found >= {(k, i) for k, i in want_items.items() if k % 6 not in (2, 4)} | {(14, 2), (16, 2)}


# The pipeline

def test_the_pipeline_keeps_clean_documents_and_one_of_each_class(spark):
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {}
    present = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, present, SMALL)
        assert out.columns == docs.columns
        path = f"{corpus_pipeline.landed.__globals__['new_shared_path'](spark, name)}"
        out.write.parquet(path)
        present = spark.read.parquet(path)
        kept[name] = {r.doc_id for r in present.select("doc_id").collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    first = kept["quality_rules"]
    classes = plain_classes([(k, texts[k]) for k in first])
    assert kept["near_duplicates"] == {k for k in first if classes[k][1] == k}
    items = [r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    assert kept["without_benchmark"] == {k for k in kept["near_duplicates"] if not any(t in texts[k] for t in items)}
    clean = {r.doc_id for r in labels.where("quality = 1 AND toxic = 0").collect()} & kept["without_benchmark"]
    assert len(clean & kept["mixed"]) >= 0.97 * len(clean)
    final = corpus_pipeline.token_output(spark, present, SMALL).collect()
    assert {r.doc_id for r in final} == kept["mixed"] and all(r.n_tokens > 0 for r in final)


def test_near_duplicates_go_by_row(spark):
    a, b = " ".join(f"a{i}" for i in range(40)), " ".join(f"b{i}" for i in range(40))
    rows = [(1, a), (5, a), (5, b), (7, a + " more"), (None, b), (8, None), (8, ""), (9, "few words"), (10, "few words")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("component_id", F.lit("clash"))
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (5, b), (8, None), (8, ""), (9, "few words")], key=str)


def test_the_pipeline_stages_take_empty_tables(spark):
    empty = spark.read.parquet(f"{SMALL}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_steps_of_near_duplicates_hold_little(spark):
    from hunkmill.llm import dealing, word_ids

    # What is gathered is sorted and held several times, by every worker of an executor.
    assert dealing.GATHERED * jaccard.RANKED.itemsize <= 24 << 20
    word_ids.once(list, "left by another step")
    word_ids.forget()
    assert not word_ids._loaded


@pytest.mark.parametrize("limit", [None, -1])
def test_texts_without_lines_are_alike_on_both_ways(spark, monkeypatch, limit):
    """A short list of dropped lines goes to every task, so no text is shuffled; a long one is joined."""
    if limit is not None:
        monkeypatch.setattr(line_templates, "BROADCAST_BYTES", limit)
    texts = ["drop me now\nkeep this\n", "drop me now", "keep this", "", None, "\n\n", "a 1\ndrop me now\nété drop\n", "drop me now\nkeep this\n"]
    docs = spark.createDataFrame([*enumerate(texts), (None, "drop me now\nx")], "doc_id long, text string").repartition(2)
    dropped = landed(spark.createDataFrame([(line_templates.line_of(b"drop me now"),), (0,)], "line long"), "dropped")
    result = line_templates._without(docs, dropped, "doc_id", "text")
    assert ("MapInArrow" in result._jdf.queryExecution().toString()) and ("Join" in result._jdf.queryExecution().toString()) == (limit is not None)
    got = {r.doc_id: (r.text, r.n_lines, r.n_dropped) for r in result.collect()}
    cut = {0: ("keep this\n", 3, 1), 1: ("", 1, 1), 2: ("keep this", 1, 0), 3: ("", 0, 0), 4: (None, 0, 0), 5: ("\n\n", 3, 0)}
    assert got == cut | {6: ("a 1\nété drop\n", 4, 1), 7: ("keep this\n", 3, 1), None: ("x", 2, 1)}


def test_places_of_many_tokens_end_alike(spark, monkeypatch):
    """A long list of tokens is dealt out by the counts that are at hand; ends are the same."""
    rows = [(line % 3, line, 2, [1, 7 + line % 2, None, line % 5], 1 + line % 4) for line in range(300)]
    lines = spark.createDataFrame(rows, "leaf long, line long, take int, places array<bigint>, n long")
    ends = {}
    for small in (True, False):
        monkeypatch.setattr(line_templates, "fits", lambda _, small=small: small)
        ends[small] = {r.line: r.end for r in line_templates._ends(lines).collect()}
    assert ends[True] == ends[False] and len(ends[True]) == 300
