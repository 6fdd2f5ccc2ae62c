import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hunkmill.functions import draws
from hunkmill.operators import corpus, pairs, perturb

REFERENCE = ["the cat sat on the mat.", "the cat ran; the dog sat", "a dog!"]
SCORED = ["the cat sat on the dog", "zebra zebra the mat", "word", ""]


def tokens(text):
    return re.findall(r"\w+|[^\w\s]", text.lower())


def expected(text, k=corpus.SMOOTHING):
    seen = [t for r in REFERENCE for t in tokens(r)]
    words = len(set(seen)) + 1
    counts = Counter(p for r in REFERENCE for p in zip(tokens(r), tokens(r)[1:]))
    out = []
    for ctx, tok in zip(tokens(text), tokens(text)[1:]):
        after = {b: n for (a, b), n in counts.items() if a == ctx}
        mass = sum(after.values()) + k * words
        p = [(n + k) / mass for n in after.values()] + [k / mass] * (words - len(after))
        n = after.get(tok, 0)
        rank = 1 + sum(m > n for m in after.values())
        out.append((math.log((n + k) / mass), rank, math.log(rank),
                    -sum(x * math.log(x) for x in p)))
    return [sum(column) / len(out) for column in zip(*out)] if out else [None] * 4


@pytest.mark.parametrize("limit", [corpus.BROADCAST_BYTES, -1])
def test_scores(spark, monkeypatch, limit):
    """Both ways to join the model, the broadcast one and the one by key."""
    monkeypatch.setattr(corpus, "BROADCAST_BYTES", limit)
    reference = spark.createDataFrame([(x,) for x in REFERENCE], "text string")
    texts = spark.createDataFrame(list(enumerate(SCORED)), "id int, text string")
    got = corpus.score_texts(texts, corpus.fit(reference).landed(spark), ["id"]).collect()
    assert len(got) == len(SCORED)
    for row in got:
        want = expected(SCORED[row.id])
        values = [row.likelihood, row.rank, row.log_rank, row.entropy]
        assert values == (want if want[0] is None else pytest.approx(want, abs=1e-9))
        assert row.scored_tokens == max(len(tokens(SCORED[row.id])) - 1, 0)


@pytest.fixture(scope="module")
def texts(spark):
    rows = [(n, " ".join(f"w{n}_{i}" for i in range(n))) for n in (1, 2, 3, 5, 17, 60, 300)]
    return rows, spark.createDataFrame(rows, "id int, text string")


@pytest.mark.parametrize("span,buffer,share,up", [(2, 1, 0.3, False), (5, 1, 0.1, True),
                                                  (1, 0, 0.9, False), (2, 2, 1.0, True)])
def test_masks(texts, span, buffer, share, up):
    rows, frame = texts
    got = {r.id: r for r in perturb.mask_spans(
        frame, ["id"], span, buffer, share, up).collect()}
    for n, text in rows:
        exact = share * n / (span + 2 * buffer)
        fitting = (n - span - 1) // (span + buffer) + 1 if n > span else 0
        count = min(math.ceil(exact) if up else int(exact), fitting)
        masked = got[n].masked.split(" ")
        marks = [i for i, piece in enumerate(masked) if piece.startswith("<extra_id_")]
        assert got[n].mask_count == len(marks) == count
        assert [masked[i] for i in marks] == [f"<extra_id_{i}>" for i in range(count)]
        assert len(masked) == n - count * (span - 1)
        assert [w for w in text.split(" ") if w in set(masked)] == [
            w for w in masked if not w.startswith("<extra_id_")]
        assert all(b - a > buffer for a, b in zip(marks, marks[1:]))


def test_mask_places_are_even(spark):
    frame = spark.range(4000).select("id", F.lit("a b c d e f g h i j k l").alias("text"))
    starts = perturb.choose_spans(frame, ["id"], 1, 0, 0.25).select(F.explode("starts").alias("s"))
    counts = {r.s: r["count"] for r in starts.groupBy("s").count().collect()}
    assert sum(counts.values()) == 12000 and set(counts) == set(range(11))
    assert max(counts.values()) - min(counts.values()) < 250


@pytest.mark.parametrize("limit", [1 << 20, -1])
def test_random_fill(spark, texts, monkeypatch, limit):
    monkeypatch.setattr(perturb, "BROADCAST_BYTES", limit)
    rows, frame = texts
    words = spark.createDataFrame([(f"fill{i}",) for i in range(50)], "word string")
    index = perturb.dictionary_index(words)
    assert sorted(r.idx for r in index.collect()) == list(range(50))
    got = {r.id: r.text.split(" ") for r in perturb.random_fill(frame, index, ["id"]).collect()}
    masks = {r.id: r for r in perturb.mask_spans(frame, ["id"]).collect()}
    for n, text in rows:
        assert len(got[n]) == n
        at = [i for i, w in enumerate(got[n]) if w.startswith("fill")]
        assert len(at) == 2 * masks[n].mask_count
        assert all(got[n][i] != got[n][i + 1] for i in at[::2])
        assert [w for w in got[n] if not w.startswith("fill")] == [
            w for w in masks[n].masked.split(" ") if not w.startswith("<extra")]
    replaced = perturb.random_replace(frame, index, ["id"]).collect()
    share = sum(w.startswith("fill") for r in replaced for w in r.text.split(" ")) / sum(
        n for n, _ in rows)
    assert 0.08 < share < 0.22 and all(len(r.text.split(" ")) == r.id for r in replaced)


def test_long_dictionary_fills_alike(spark, monkeypatch):
    """Texts whose keys are null or repeat, empty and null texts, and texts cut over several batches."""
    rows = [(1, "x " * 40, 7), (1, "y " * 30, None), (None, "z " * 50, 9), (2, "", 1), (3, None, 2), (4, "v " * 5000, 3)]
    frame = spark.createDataFrame(rows, "id long, text string, more long").repartition(3)
    index = perturb.dictionary_index(spark.createDataFrame([(f"fill{i}",) for i in range(50)], "word string"))
    for how in (perturb.random_fill, perturb.random_replace):
        monkeypatch.setattr(perturb, "BROADCAST_BYTES", 1 << 20)
        at_hand = how(frame, index, ["id"])
        monkeypatch.setattr(perturb, "BROADCAST_BYTES", -1)
        joined = how(frame, index, ["id"])
        assert joined.columns == at_hand.columns
        assert sorted(map(repr, joined.collect())) == sorted(map(repr, at_hand.collect()))


def test_short_words_are_held_by_every_task(spark, monkeypatch):
    """What counts is the text of the words, not what rows would take."""
    words = spark.createDataFrame([(f"{i:04d}",) for i in range(1000)], "word string")
    index = perturb.dictionary_index(words)
    monkeypatch.setattr(perturb, "BROADCAST_BYTES", 8000)
    monkeypatch.setattr(perturb, "_words_by_number", None)
    texts = spark.createDataFrame([(1, "a b c d e f g h i j k l")], "id long, text string")
    filled = perturb.random_fill(texts, index, ["id"], share=1.0).first().text.split(" ")
    assert sum(w.isdigit() for w in filled) == 6


def test_draws_as_text(spark):
    digests = [f"{n:08x}" + "0" * 24 for n in (0, 1, 0x26666665, 0x26666666, 0x26666667, 0x7fffffff, 0x80000000, 0xffffffff)]
    for chance in (0.0, 0.15, 0.5, 1.0, 1 / 3):
        frame = spark.createDataFrame([(d,) for d in digests], "d string")
        told = frame.select((draws.unit_draw(F.col("d")) < chance).alias("a"), draws.drawn_below(F.col("d"), chance).alias("b"))
        assert all(r.a == r.b for r in told.collect())


def test_fills(spark):
    rows = [
        ("a <extra_id_0> b <extra_id_1>", "<pad><extra_id_0> X <extra_id_1> Y z<extra_id_2></s>",
         "a X b Y z"),
        ("a <extra_id_0> b <extra_id_1>", "<pad><extra_id_0> X <extra_id_1> Y", ""),
        ("no marks", "<extra_id_0>", "no marks"),
        ("t <extra_id_0>\nx <extra_id_0>", "<extra_id_0> only <extra_id_1>", ""),
    ]
    frame = spark.createDataFrame(rows, "masked string, generated string, want string")
    for row in perturb.apply_fills(frame).collect():
        assert row.text == row.want and row.accepted == int(row.want != "")


def test_distinct_and_prepared_texts(spark):
    rows = [(1, "a b"), (2, "a  b"), (3, "a b"), (4, "c " * 300), (5, "d")]
    frame = spark.createDataFrame(rows, "id long, text string")
    assert sorted(r.id for r in pairs.distinct_texts(frame, "id").collect()) == [1, 2, 4, 5]
    kept = pairs.prepare_corpus(frame, "id", dedup_after_cleaning=True, max_tokens=10)
    assert sorted((r.id, r.text) for r in kept.collect()) == [(1, "a b"), (5, "d")]
    assert [r.id for r in pairs.prepare_corpus(frame, "id", long_only=True).collect()] == [4]
    short = frame.where("id <> 4")
    assert pairs.prepare_corpus(short, "id", long_only=True).count() == 3


def test_question_pairs(spark):
    frame = spark.createDataFrame(
        [(1, "Question: q Answer:<<<SEP>>>one two three", "Question: q Answer: x Question: y")],
        "pair_id int, original string, sampled string")
    row = pairs.make_pairs(frame, question_answer=True).first()
    assert row.sampled == "Question: q Answer: x " and row.original == "Question: q Answer: one two"
