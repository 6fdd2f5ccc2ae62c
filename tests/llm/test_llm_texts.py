"""Chat formatting, quality rules, personal data, token files and counts, archives."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from hunkmill.llm import chat, personal_data, prefix_counts, quality, token_files, warc, word_ids
from hunkmill.session import importable_by_workers

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", None, " \n\t ", "a", "<|endoftext|> x", "é́ İ Σς <|im_end|>", "word " * 3000, "x" * 5000, "same text here", "same text here"]


@pytest.fixture(scope="module", autouse=True)
def workers(spark):
    importable_by_workers(spark)


def odd_documents(spark):
    rows = [(i if i != 3 else None, t, "key", 1) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, key string, n_words int")


def library(text):
    from tokenizers import Tokenizer

    return word_ids.once(Tokenizer.from_file, TOKENIZER).encode(text, add_special_tokens=False).ids


# Chat formatting

def test_assembled_bytes_are_those_of_plain_formatting():
    texts = ["a<|im_end|>", "<\\|x", "", "é\n<|", "<\\\\|<||"] * 7
    roles = ["user", "assistant", "sys\ntem", "a\\nb", "<|im_start|>"] * 7
    buffer, ends, spans = chat.assemble(pa.array(roles), pa.array(texts))
    data = bytes(buffer)
    assert [(r.decode(), t.decode()) for r, t in chat.parse(data)] == list(zip(roles, texts))
    assert data.count(chat.START) == len(texts) and data.count(chat.END) == len(texts)
    assert [chat.unescaped(data[a:b]).decode() for a, b in spans] == texts
    assert ends[-1] == len(data)


def test_conversations_come_back_in_order_also_in_many_parts(spark, monkeypatch):
    random.seed(1)
    rows = [(c, t, random.choice(["user", "assistant", None]), random.choice(ODD)) for c in (1, 2, None) for t in range(30)]
    rows += [(4, None, "assistant", "first"), (4, 0, "user", None), (4, 0, "user", None)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("task", F.lit("clash"))
    got = {r.conv_id: r for r in chat.digests(chat.format_conversations(frame)).collect()}
    assert set(got) == {1, 2, 4, None}
    for conversation, row in got.items():
        turns = sorted((r for r in rows if r[0] == conversation), key=lambda r: (r[1] is not None, r[1]))
        plain = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        learned = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        assert row.n_turns == len(turns) and row.turns_sha256 == hashlib.sha256(plain.encode()).hexdigest()
        assert row.loss_chars == len(learned) and row.loss_sha256 == hashlib.sha256(learned.encode()).hexdigest()
    assert chat.digests(chat.format_conversations(frame.limit(0))).count() == 0


# Quality rules

def plain_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics_equal_plain_counts():
    random.seed(2)
    for _ in range(300):
        text = "".join(random.choice(["a ", "b ", "é ", "#x ", "\n", "\r\x0b", "a b a b "]) for _ in range(random.randint(0, 40)))
        assert quality.statistics(text.encode())[:5] == plain_statistics(text)


def test_the_forest_rejects_junk_and_keeps_clean_rows(spark):
    random.seed(3)
    word = lambda: "".join(random.choice("abcdefg") for _ in range(random.randint(2, 8)))
    texts = [" ".join(word() + ("%%%" if i % 6 == 0 else "") for _ in range(random.randint(15, 80))) for i in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("kept", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(0, 400)], "doc_id long, quality int, toxic int")
    rows = quality.judged(docs, quality.fit(docs, labels)).collect()
    kept = {r.doc_id for r in rows if r.verdict.kept}
    assert {r.kept for r in rows} == {"clash"}
    assert kept == {i for i in range(600) if i % 6}
    nothing = quality.fit(docs, labels.limit(0))
    assert nothing.forest is None and all(r.verdict.kept for r in quality.judged(docs, nothing).collect())


def test_the_forest_is_fitted_on_all_labelled_rows(spark):
    docs = spark.range(24_000).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("a b c d e f g h i j k"), F.when(F.col("id") % 7 == 0, "%%%% %%%%")).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 7 != 0).cast("int").alias("quality"))
    rows = quality._labelled(docs, labels.union(labels), "doc_id", "text", "quality")
    assert rows.count() == 24_000 and rows.where("bad").count() == 3_429
    first = rows.where("NOT held")
    good, bad = first.where("NOT bad").count(), first.where("bad").count()
    forest, = quality._grown(first, good, bad, [[0, 4]], 5)
    # Each row is in one tree, as there are enough: the leaves of all trees hold all weight.
    assert len(forest.trees) == 5 and all((t[:, 0] < 0).sum() >= 2 for t in forest.trees)
    second = rows.where("held").toPandas()
    (caught, threshold), = quality._told(rows.where("held"), int((~second["bad"]).sum()), [forest])
    scores, odd = forest.scores(np.stack(second["features"].to_numpy())), second["bad"].to_numpy()
    clean = np.sort(scores[~odd])
    allowed = clean[len(clean) - 1 - int(quality.MOST_FALSE * len(clean))]
    assert caught == (scores[odd] > allowed).sum() > 0 and threshold == (allowed + scores[odd & (scores > allowed)].min()) / 2


def test_odd_documents_are_judged(spark):
    rows = quality.judged(odd_documents(spark), quality.Judge(None, np.inf)).collect()
    assert len(rows) == len(ODD)
    assert not any(r.verdict.kept for r in rows)
    assert quality.judged(odd_documents(spark).limit(0), quality.Judge(None, np.inf)).count() == 0


# Personal data

PLAIN = dict(zip(personal_data.KINDS, [
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]",
]))


def test_plain_spans_are_those_of_the_patterns():
    random.seed(4)
    for _ in range(5000):
        text = "".join(random.choice("ab.@@-+ 0123456789()..  1_") for _ in range(random.randint(0, 40)))
        want = []
        for kind, pattern in PLAIN.items():
            for match in re.finditer(pattern, text):
                digits = re.sub("[^0-9]", "", match.group())
                fine = {
                    "email": True, "ip": all(int(p) <= 255 for p in match.group().split(".")) if kind == "ip" else True,
                    "card": 12 <= len(digits) <= 19 and personal_data.passes_luhn(digits), "phone": 9 <= len(digits) <= 15,
                }
                if fine[kind]:
                    want.append((match.start(), kind, match.end()))
        assert sorted(personal_data.plain_spans(text)) == sorted(want)


@pytest.mark.parametrize(("text", "kind", "found"), [
    ("mail jane (at) example [dot] com now", "email", "jane (at) example [dot] com"),
    ("x jаne@exаmple.com y", "email", "jаne@exаmple.com"),
    ("ａ＠ｂ．ｃｏｍ", "email", "ａ＠ｂ．ｃｏｍ"),
    ("call plus one four one five five five five two six seven one please", "phone", "plus one four one five five five five two six seven one"),
    ("ip one nine two dot one six eight dot zero dot one end", "ip", "one nine two dot one six eight dot zero dot one"),
])
def test_disguises_are_found_at_their_place(text, kind, found):
    plain, added = personal_data.find(text)
    assert not plain and [(k, text[s:e]) for s, k, e in added] == [(kind, found)]


@pytest.mark.parametrize(("text", "kind"), [
    ("192 dot 168 dot 1 dot 10", "ip"), ("192[dot]168[dot]1[dot]10", "ip"), ("192[.]168[.]1[.]10", "ip"),
    ("192 dot one six eight [dot] 1 dot 10", "ip"), ("192 point 168 (.) one.10", "ip"),
    ("jane[@]example[.]com", "email"), ("jane[at]example[.]com", "email"), ("jane { @ } example dot com", "email"),
    ("jane@example[.]com", "email"), ("jane@example dot com", "email"),
    ("+1 415 five five 5 one two 3 four", "phone"), ("4111 1111 one one 11 111 one", "card"),
])
def test_signs_and_digits_are_rewritten_wherever_they_stand(text, kind):
    around = f"see {text}, now"
    plain, added = personal_data.find(around)
    assert not plain and [(k, around[s:e]) for s, k, e in added] == [(kind, text)]


@pytest.mark.parametrize("text", ["score 3 dot 5", "one 2 three 45", "a [.] b", "in 2010 one 1990", "it [@] 5 dot"])
def test_signs_and_digits_alone_are_no_spans(text):
    assert personal_data.find(text) == ([], [])


@pytest.mark.parametrize(("text", "kind", "part"), [
    ("jоhn@example.com", "email", "hn@example.com"),
    ("jo\u200bhn@example.com", "email", "hn@example.com"),
    ("john@mail.example.cоm", "email", "john@mail.example.c"),
    ("+1 415 555 12 three four five", "phone", "+1 415 555 12"),
])
def test_a_plain_part_does_not_hide_the_whole(text, kind, part):
    plain, added = personal_data.find(f"see {text} now")
    assert [(k, f"see {text} now"[s:e]) for s, k, e in plain] == [(kind, part)]
    assert [(k, f"see {text} now"[s:e]) for s, k, e in added] == [(kind, text)]


@pytest.mark.parametrize("text", ["look at example.com", "meet at at at the. dot", "one two three", "", "<at> (dot) [at]", " " * 3000 + "(at)"])
def test_clean_texts_have_no_spans(text):
    assert personal_data.find(text) == ([], [])


def test_personal_data_of_odd_documents(spark):
    rows = personal_data.find_personal_data(odd_documents(spark)).collect()
    assert len(rows) == len(ODD) and {r.spans for r in rows} == {""}
    assert {r.base_sha256 for r in rows} == {hashlib.sha256(b"").hexdigest()}


# Token files

def test_files_hold_the_library_ids_and_are_read_in_part(tmp_path, monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_TOKENS", 50)
    monkeypatch.setattr(token_files, "LONG_TOKENS", 120)
    encoder = word_ids.WordIds(TOKENIZER)
    writer = token_files.Writer(str(tmp_path / "a.zst"), encoder.kind)
    texts = [t or "" for t in ODD] + ["a b c"] * 40
    for number, text in enumerate(texts):
        writer.add(number if number else None, encoder.encode(text.encode()))
    writer.close()
    reader = token_files.Reader(str(tmp_path / "a.zst"))
    assert [reader.document(i).tolist() for i in range(len(texts))] == [library(t) for t in texts]
    last = token_files.Reader(str(tmp_path / "a.zst"))
    last.document(len(texts) - 1)
    assert last.frames_read == 1 and reader.index["known"].tolist() == [0] + [1] * (len(texts) - 1)
    raw = bytearray((tmp_path / "a.zst").read_bytes())
    raw[10] ^= 1
    (tmp_path / "b.zst").write_bytes(raw)
    with pytest.raises(Exception):
        token_files.Reader(str(tmp_path / "b.zst")).document(3)


def test_token_query_over_odd_documents(spark):
    docs = odd_documents(spark)
    rows = token_files.read_tokens(token_files.write_tokens(docs, TOKENIZER, 1)).collect()
    assert len(rows) == len(ODD)
    ordered = sorted(rows, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == [None, 0, 1, 2, 4, 5, 6, 7, 8, 9]
    at = 0
    for row in ordered:
        ids = [*library(ODD[3 if row.doc_id is None else row.doc_id] or ""), 1]
        assert (row.start, row.n_tokens, row.ids_crc32) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert token_files.read_tokens(token_files.write_tokens(docs.limit(0), TOKENIZER, 1)).count() == 0


def test_words_are_encoded_alike_when_the_memo_overflows(monkeypatch):
    monkeypatch.setattr(word_ids, "KEPT_MEMORY", 700)
    encoder = word_ids.WordIds(TOKENIZER)
    for text in ["a b c d e f a", "<|ENDOFTEXT|> A", "x" * 100 + " A a", "a\x1cb c\xa0d"]:
        assert np.frombuffer(encoder.encode(text.encode()), encoder.kind).tolist() == library(text)


# Prefix counts

def test_counts_of_all_prefixes_equal_the_library():
    counter = prefix_counts.PrefixCounter(TOKENIZER)
    random.seed(6)
    letters = list("abcthei'sdlmrv AB01.,!<|>") + ["<|endoftext|>", "é", "é", "İ", "́", "각", "日", "゙", "か", "\x1c", "\xa0", "👍", "\n"]
    for _ in range(400):
        text = "".join(random.choice(letters) for _ in range(random.randint(0, 14)))
        packed = prefix_counts.pack(counter.deltas(text.encode()))
        want = [len(library(text[:k])) for k in range(len(text) + 1)]
        assert prefix_counts.prefix_table(packed).tolist() == want
        assert prefix_counts.longest_prefix(packed, 3) == max(k for k, n in enumerate(want) if n <= 3)
        assert prefix_counts.count_at(packed, len(text)) == want[-1]


def test_words_of_many_texts_are_counted_together(monkeypatch):
    monkeypatch.setattr(prefix_counts, "WORDS_MEMORY", 60_000)
    monkeypatch.setattr(prefix_counts, "PIECES_TOGETHER", 300)
    counter, plain = prefix_counts.PrefixCounter(TOKENIZER), prefix_counts.PrefixCounter(TOKENIZER)
    random.seed(7)
    letters = list("aabcdeeehilnorstt") + ["th", "ing", "é", "ß", "ẞ", "Ⱥ", "T", "I", "7", "***", "日", "本", ".", "$"]
    texts = [" ".join("".join(random.choices(letters, k=random.randint(1, 40))) for _ in range(30)) for _ in range(12)]

    def refused(piece):
        raise AssertionError(f"went one by one: {piece}")

    monkeypatch.setattr(counter, "_piece", refused)
    for some in (texts[:6], texts[3:], texts):
        for text, deltas in zip(some, counter.deltas_of([t.encode() for t in some])):
            words = [plain.counts(word) for word in text.split()]
            assert prefix_counts.prefix_table(prefix_counts.pack(deltas))[-1] == len(library(text))
            assert [c for word in words for c in np.diff(word).tolist()] == deltas[[letter != " " for letter in text]].tolist()
    assert counter.held <= 60_000 + sum(2 * len(t.encode()) + 31 * 190 for t in texts)


def test_long_pieces_and_odd_letters_are_counted_like_the_library():
    counter = prefix_counts.PrefixCounter(TOKENIZER)
    texts = ["ΣΑΣ ας \xa0x don't", "日本語" * 60 + " ab" + "th" * 90 + "." * 200, "a" * 65 + "'s e\u0301t\u0301 İx", "", " \n", "\u0958" * 21 + " x<|endoftext|>y <|X", "x" * 64 + " " + "y" * 128 + " " + "z" * 129]
    for text, deltas in zip(texts, counter.deltas_of([t.encode() for t in texts])):
        assert prefix_counts.prefix_table(prefix_counts.pack(deltas)).tolist() == [len(library(text[:k])) for k in range(len(text) + 1)]


def test_count_query_over_odd_documents(spark):
    rows = prefix_counts.within_budget(prefix_counts.count_prefixes(odd_documents(spark), TOKENIZER), 100).collect()
    got = sorted((r.n_bytes, r.n_tokens, r.over_limit) for r in rows)
    assert got == sorted((len((t or "").encode()), len(library(t or "")), len(library(t or "")) > 100) for t in ODD)


# Archives

def test_archives_come_back_in_chunks(spark, monkeypatch):
    big = "x é" * 900_000
    rows = [(1, None, big), (2, "u\r\nv", big), (None, "u", None), (5, "u", "a" * 10), (6, "u", "a" * 10), (7, "u", "b" * 1000), (7, "u", "b" * 1000), (3, "u", "b" * 1000), (None, "u", "b" * 1000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"digest": F.lit("clash"), "payload": F.lit(0)})
    records = warc.with_record_types(pages)
    got = warc.read_archives(warc.write_archives(records)).collect()
    whole = [r for r in got if r.last]
    assert len(whole) == len(rows)
    assert sorted((r.key or -1, r.record_type, r.refers_to) for r in whole) == sorted([
        (1, "revisit", 2), (2, "response", None), (-1, "response", None), (5, "response", None), (6, "response", None),
        (7, "response", None), (7, "response", None), (3, "revisit", 7), (-1, "revisit", 7),
    ], key=lambda r: (r[0], r[1], r[2]))
    chunks = sorted((r for r in got if r.key == 2), key=lambda r: r.chunk)
    done = b""
    assert len(chunks) == 4
    for row in chunks:
        done += bytes(row.data)
        assert row.bytes_so_far == len(done) and row.digest_so_far == hashlib.sha1(done).hexdigest()
    assert done.decode() == big
    revisit = next(r for r in whole if r.key == 1)
    assert (revisit.bytes_so_far, revisit.digest_so_far) == (len(done), hashlib.sha1(done).hexdigest())
    assert warc.read_archives(warc.write_archives(records.limit(0))).count() == 0
