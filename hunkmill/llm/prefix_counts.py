"""Exact token counts of every prefix of a text, by dynamic programming over its words.

A byte pair encoding is known by its neighbours: tokens t1 .. tk are the encoding of their text if
and only if each pair (ti, ti+1) is the encoding of its own text. So the last token of every prefix
follows from the last tokens of shorter prefixes: it is the one vocabulary entry ending there that
agrees with the last token before it. One pass gives the count at every prefix, for a word that goes
on and, with the end-of-word mark, for a word that ends there.

The words of some megabytes of texts are taken together: all distinct new pieces go through the programme
at once, byte place by byte place, over arrays (``_pieces``). Pieces of over ``LONG_PIECE`` bytes and words
that normalising, lower-casing, an apostrophe or a special string could change go one by one (``counts``).

Stored per text: the change of the count at each code point, as compressed 2-byte integers (4-byte
where those do not suffice). ``count_at`` and ``longest_prefix`` answer from that alone.

Edge cases: null texts count as empty; keys may be null or repeat (one row out per row in); an empty
table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from array import array
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame, functions as F

from hunkmill.llm.word_ids import ENTRY, KEPT_BYTES, Memo, byte_letters, once, utf8

PAIRS_KEPT = 200_000
#: Slots, as a power of two, in which pairs of tokens keep whether they agree; a newer pair takes the slot.
PAIR_BITS = 21
#: Bytes kept of words and of odd pieces; workers are reused, so all is bounded together.
WORDS_MEMORY, LETTERS_MEMORY = 56 << 20, 8 << 20
#: Bytes of texts whose words are learnt together, and of pieces that go through the arrays together.
TEXTS_TOGETHER, PIECES_TOGETHER = 4 << 20, 1 << 20
#: Longer pieces go one by one.
LONG_PIECE = 128
#: ASCII that needs a closer look than lower-casing: control characters and the apostrophe.
CLOSER = re.compile(rb"[^!-&(-~]|<\|")
WHITE = np.zeros(256, bool)
WHITE[list(b" \t\n\r\x0b\x0c")] = True


class PrefixCounter:
    """Counts for a tokenizers file: byte-level pairs with an end-of-word mark, lower-cased NFC text."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.end = model["end_of_word_suffix"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        #: How an entry came about: its two parts and the rank of their merge.
        self.parts: dict[str, tuple[str, str, int]] = {}
        for (left, right), rank in self.ranks.items():
            self.parts.setdefault(left + right, (left, right, rank))
        self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in spec["added_tokens"]))
        self.special_marks = tuple(t["content"] for t in spec["added_tokens"])
        self.letters = byte_letters()
        self.agree: dict[tuple[str, str], bool] = {}
        special = {t["content"] for t in spec["added_tokens"]}
        entries = [t for t in model["vocab"] if t not in special]
        self.longest = max(len(t.removesuffix(self.end)) for t in entries)
        self.known: dict[str, bool] = {}
        self.edges: dict[tuple[str, int], list[tuple[str, float]]] = {}
        #: Ends of pieces that are not plain ASCII words, as changes.
        self.pieces_ended = Memo(lambda piece: _steps(self._piece(piece)), LETTERS_MEMORY)
        #: Changes of words: one byte per code point in ``words``, four in ``long_words``.
        self.words: dict[bytes, bytes] = {}
        self.long_words: dict[bytes, bytes] = {}
        self.held = 0
        #: Which entries encodings can hold: 1 inside a word, 2 at its end, 3 both.
        self.usable: dict[str, int] = {}
        for entry in entries:
            if self._reached(entry):
                text = entry.removesuffix(self.end)
                self.usable[text] = self.usable.get(text, 0) | (2 if entry != text else 1)
        self._grow()

    def _grow(self) -> None:
        """The usable entries as a trie of bytes; nodes that go on are numbered first, the root is 0."""
        byte = {letter: number for number, letter in enumerate(self.letters)}
        own = {bytes(byte[letter] for letter in text): text for text in self.usable}
        nodes = {b""}.union(*({name[:size] for size in range(1, len(name) + 1)} for name in own))
        going_on = {name[:-1] for name in nodes if name}
        number = {name: at for at, name in enumerate(sorted(nodes, key=lambda name: (name not in going_on, len(name), name)))}
        self.inner = len(going_on)
        self.goes = np.zeros((self.inner, 256), np.int32)
        self.kinds = np.zeros(len(nodes), np.uint8)
        self.names = [""] * len(nodes)
        for name, at in number.items():
            if name:
                self.goes[number[name[:-1]], name[-1]] = at
            if name in own:
                self.kinds[at], self.names[at] = self.usable[own[name]], own[name]
        self.pairs = np.full(1 << PAIR_BITS, -1, np.int64)

    def _fit(self, before: np.ndarray, node: np.ndarray, kind: int) -> np.ndarray:
        """Whether entries may follow the tokens before them; nothing before (0) fits all."""
        keys = before * np.int64(2 * len(self.names)) + (node * np.int64(2) + (kind - 1))
        slots = (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - PAIR_BITS)).view(np.int64)
        kept = self.pairs[slots]
        fits = (kept & 1).astype(bool)
        fits[before == 0] = True
        new = np.flatnonzero((kept >> 1 != keys) & (before != 0))
        if len(new):
            distinct, places, back = np.unique(keys[new], return_index=True, return_inverse=True)
            places, mark = new[places], "" if kind == 1 else self.end
            told = np.fromiter((self._apart(self.names[a], self.names[b] + mark) for a, b in zip(before[places].tolist(), node[places].tolist())), bool, len(distinct))
            self.pairs[slots[places]] = distinct * 2 + told
            fits[new] = told[back]
        return fits

    def _pieces(self, pieces: list[bytes]) -> np.ndarray:
        """Counts at each byte of each piece, if the piece ended there, one after another.

        All pieces take a step together: from every place whose last token is known, along the trie, to
        the places where an entry ends that fits. Earlier starts come first, as in ``_piece``.
        """
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes) - sizes
        order = np.argsort(-sizes, kind="stable")
        size, raw = int(sizes.max(initial=0)), np.frombuffer(b"".join(pieces), np.uint8)
        #: Pieces of at least so many bytes; they come first in the order.
        reach = np.searchsorted(-sizes[order], -np.arange(size + 2), side="right").tolist()
        at = begins[order]
        letters = [raw[at[:reach[place + 1]] + place] for place in range(size)]
        last = [np.zeros(n, np.int32) for n in reach]
        count = [np.zeros(n, np.int32) for n in reach]
        ended = [np.zeros(n, np.int32) for n in reach]
        for start in range(size):
            who = np.arange(reach[start + 1])
            node = np.zeros(len(who), np.int32)
            for end in range(start + 1, min(start + self.longest, size) + 1):
                if len(who) and who[-1] >= reach[end]:
                    who = who[:np.searchsorted(who, reach[end])]
                    node = node[:len(who)]
                node = self.goes[node, letters[end - 1][who]]
                alive = np.flatnonzero(node)
                who, node = who[alive], node[alive]
                if not len(who):
                    break
                kinds = self.kinds[node]
                inside = np.flatnonzero(((kinds & 1) != 0) & (who < reach[end + 1]) & (last[end][who] == 0))
                closing = np.flatnonzero(((kinds & 2) != 0) & (ended[end][who] == 0))
                for kind, some in ((1, inside), (2, closing)):
                    whose, entry = who[some], node[some]
                    if start:
                        fits = self._fit(last[start][whose], entry, kind)
                        whose, entry = whose[fits], entry[fits]
                    if kind == 1:
                        last[end][whose] = entry
                        count[end][whose] = count[start][whose] + 1
                    else:
                        ended[end][whose] = count[start][whose] + 1
                inner = node < self.inner
                who, node = who[inner], node[inner]
        out = np.zeros(len(raw), np.int32)
        for place in range(size):
            out[at[:reach[place + 1]] + place] = ended[place + 1]
        return out

    def _changes(self, pieces: list[bytes]) -> np.ndarray:
        """Changes of the count at each byte of each piece, one after another."""
        parts, some, held = [np.zeros(0, np.int32)], [], 0
        for piece in [*pieces, None]:
            if some and (piece is None or len(piece) > LONG_PIECE or held >= PIECES_TOGETHER):
                parts.append(self._pieces(some))
                some, held = [], 0
            if piece is None:
                break
            if len(piece) > LONG_PIECE:
                parts.append(np.array(self._piece("".join([self.letters[b] for b in piece])), np.int32))
            else:
                some.append(piece)
                held += len(piece)
        counts = np.concatenate(parts)
        changes = np.diff(counts, prepend=np.int32(0))
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        begins = np.cumsum(sizes) - sizes
        changes[begins] = counts[begins]
        return changes

    def _edge(self, token: str, side: int) -> list[tuple[str, float]]:
        """The entries that stood at this side of a token while it was built, first to last, each with
        the rank of the merge that used it up (side 1: right edge, 0: left edge)."""
        edge = self.edges.get((token, side))
        if edge is None:
            edge, used = [(token, float("inf"))], token
            while used in self.parts:
                rank = self.parts[used][2]
                used = self.parts[used][side]
                edge.append((used, rank))
            edge.reverse()
            self.edges[token, side] = edge
        return edge

    def _apart(self, left: str, right: str) -> bool:
        """Whether no merge joins two neighbouring tokens while they are built.

        Merges run by rank and, within a rank, from the left: a merge across comes first if its rank is
        below that which uses up the left neighbour and not above that which uses up the right one.
        """
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while True:
            (x, x_used), (y, y_used) = a[i], b[j]
            across = self.ranks.get((x, y))
            if across is not None and across < x_used and across <= y_used:
                return False
            if x_used <= y_used:
                i += 1
            else:
                j += 1
            if i == len(a) or j == len(b):
                return True

    def _reached(self, mark: str) -> bool:
        """Whether the encoding of an entry's own text is that entry."""
        known = self.known.get(mark)
        if known is None:
            if mark not in self.parts:
                known = len(mark.removesuffix(self.end)) == 1
            else:
                left, right, rank = self.parts[mark]
                known = self._reached(left) and self._reached(right) and self._apart_before(left, right)
            self.known[mark] = known
        return known

    def _apart_before(self, left: str, right: str) -> bool:
        """Whether the two parts of an entry are built before anything joins them."""
        a, b, i, j = self._edge(left, 1), self._edge(right, 0), 0, 0
        while i < len(a) - 1 or j < len(b) - 1:
            (x, x_used), (y, y_used) = a[i], b[j]
            across = self.ranks.get((x, y))
            if across is not None and across < x_used and across <= y_used:
                return False
            if x_used <= y_used:
                i += 1
            else:
                j += 1
        return True

    def piece(self, text: str) -> list[int]:
        """Counts at the end of each byte of a piece, if the piece ended there."""
        return list(accumulate(memoryview(self.pieces_ended[text]).cast("i")))

    def _piece(self, text: str) -> list[int]:
        size, longest, usable, agree, end_mark = len(text), self.longest, self.usable.get, self.agree, self.end
        if len(agree) >= PAIRS_KEPT:
            agree.clear()
        last, count, ended = [""] * (size + 1), [0] * (size + 1), []
        for end in range(1, size + 1):
            open_kinds = 3 if end < size else 2
            for start in range(end - longest if end > longest else 0, end):
                token = text[start:end]
                kinds = usable(token)
                if not kinds or not kinds & open_kinds:
                    continue
                before = last[start]
                for kind in (1, 2):
                    if kinds & open_kinds & kind:
                        mark = token if kind == 1 else token + end_mark
                        if before:
                            fits = agree.get((before, mark))
                            if fits is None:
                                fits = agree[before, mark] = self._apart(before, mark)
                            if not fits:
                                continue
                        open_kinds ^= kind
                        if kind == 1:
                            last[end], count[end] = token, count[start] + 1
                        else:
                            ended.append(count[start] + 1)
                if not open_kinds:
                    break
        return ended

    def _plain(self, text: str) -> list[int]:
        """Counts at each code point of NFC text without special strings, 0 first."""
        if text.isascii() and text.isprintable() and " " not in text and "'" not in text:
            counts, done = [0], 0
            for piece in self.pieces.findall(text.lower()):
                counts += [done + c for c in self.piece(piece)]
                done = counts[-1]
            return counts
        lowered, places = [], []
        for at, letter in enumerate(text):
            low = letter.lower()
            lowered.append(low)
            places += [at] * len(low)
        low_text, counts, done = "".join(lowered), [0] * (len(text) + 1), 0
        upto = 0
        for match in self.pieces.finditer(low_text):
            piece = match.group()
            for at in range(upto, match.start()):
                counts[places[at] + 1] = done
            if piece[0] == "'" and len(piece) > 1 and piece[1].isalpha():
                inside = [sum(self.piece(self._bytes(p))[-1] for p in self.pieces.findall(piece[:k])) for k in range(1, len(piece))]
                inside.append(self.piece(self._bytes(piece))[-1])
            else:
                mapped, ends = [], []
                for letter in piece:
                    mapped.append(self._bytes(letter))
                    ends.append((ends[-1] if ends else 0) + len(mapped[-1]))
                by_byte = self.piece("".join(mapped))
                inside = [by_byte[e - 1] for e in ends]
            for offset, value in enumerate(inside):
                counts[places[match.start() + offset] + 1] = done + value
            done += inside[-1]
            upto = match.end()
        for at in range(upto, len(low_text)):
            counts[places[at] + 1] = done
        return counts

    def _bytes(self, text: str) -> str:
        if text.isascii() and text.isprintable() and " " not in text:
            return text
        return "".join(self.letters[b] for b in text.encode("utf-8"))

    def _ordinary(self, text: str) -> list[int]:
        """Counts at each code point of text without special strings, 0 first."""
        if text.isascii() or unicodedata.is_normalized("NFC", text):
            return self._plain(text)
        starts = [i for i, c in enumerate(text) if i == 0 or _starts(c)] + [len(text)]
        groups = [text[a:b] for a, b in zip(starts, starts[1:])]
        normal = [unicodedata.normalize("NFC", g) for g in groups]
        whole, counts, done = self._plain("".join(normal)), [0], ""
        for group, norm in zip(groups, normal):
            if len(group) > 1:
                # Inside a group the prefix is normalised by itself; only the last pieces change.
                tail_from = max((m.start() for m in self.pieces.finditer(done)), default=0)
                if "\u0130" in done:  # the one letter that lower-casing makes two pieces of
                    tail_from = 0
                base = whole[tail_from]
                for k in range(1, len(group)):
                    counts.append(base + self._plain(done[tail_from:] + unicodedata.normalize("NFC", group[:k]))[-1])
            done += norm
            counts.append(whole[len(done)])
        return counts

    def counts(self, word: str) -> list[int]:
        """Counts at each code point of a part without ASCII white space, 0 first."""
        if not any(mark in word for mark in self.special_marks):
            return self._ordinary(word)
        total, plain_from, counts, base = 0, 0, [0], 0
        for match in self.special.finditer(word):
            before = word[plain_from:match.start()]
            open_end = self._ordinary(before + match.group()[:-1])
            closed = self._ordinary(before)[-1]
            counts += [base + c for c in open_end[1:]]
            base += closed + 1
            counts.append(base)
            plain_from = match.end()
        counts += [base + c for c in self._ordinary(word[plain_from:])[1:]]
        return counts

    def _lowered(self, word: bytes) -> str | None:
        """A word that is cut into pieces as it stands once it is lower-cased, letter by letter; else None."""
        if word.isascii():
            return None if CLOSER.search(word) else word.lower().decode()
        text = word.decode("utf-8", "replace")
        low = text.lower()
        # A capital sigma depends on the letters around it, the dotted capital I becomes two.
        if "'" in text or "<|" in text or "\u03a3" in text or len(low) != len(text) or not text.isprintable() or not unicodedata.is_normalized("NFC", text):
            return None
        return low

    def _learn(self, words: set[bytes]) -> None:
        """Sees to it that the changes of all these words are at hand."""
        new = [word for word in words if word not in self.words]
        cost = sum(ENTRY + 2 * len(word) for word in new)
        if self.held + cost > WORDS_MEMORY and self.words:
            self.words.clear()
            new, self.held = list(words), 0
            cost = sum(ENTRY + 2 * len(word) for word in new)
        self.held += cost
        self.long_words.clear()
        plain, lows = [], []
        for word in new:
            low = self._lowered(word)
            if low is None:
                self._keep(word, np.diff(np.array(self.counts(word.decode("utf-8", "replace")), np.int32)))
            else:
                plain.append(word)
                lows.append(low)
        pieces = self.pieces.findall(" ".join(lows))
        numbers = {piece: number for number, piece in enumerate(dict.fromkeys(pieces))}
        distinct = [piece.encode() for piece in numbers]
        changes = self._changes(distinct)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))
        begins = np.cumsum(sizes) - sizes
        which = np.fromiter(map(numbers.__getitem__, pieces), np.int64, len(pieces))
        own = sizes[which]
        ends = np.cumsum(own)
        by_byte = changes[np.repeat(begins[which] - (ends - own), own) + np.arange(own.sum())]
        raw = np.frombuffer("".join(pieces).encode(), np.uint8)
        by_letter = np.add.reduceat(by_byte, np.flatnonzero((raw & 0xC0) != 0x80)) if len(raw) else by_byte
        if len(by_letter) != sum(map(len, lows)):
            raise ValueError("pieces leave letters of words out")
        narrow, done = by_letter.astype(np.int8).tobytes(), 0
        for word, low in zip(plain, lows):
            upto = done + len(low)
            if len(word) <= KEPT_BYTES:  # so few bytes make fewer than 128 tokens
                self.words[word] = narrow[done:upto]
            else:
                self._keep(word, by_letter[done:upto])
            done = upto

    def _keep(self, word: bytes, changes: np.ndarray) -> None:
        if len(word) <= KEPT_BYTES and np.abs(changes).max(initial=0) < 128:
            self.words[word] = changes.astype(np.int8).tobytes()
        else:
            self.long_words[word] = changes.astype("<i4").tobytes()

    def deltas_of(self, texts: list[bytes]) -> list[np.ndarray]:
        """Change of the count at each code point of whole texts, which are taken together."""
        self._learn(set().union(*(text.split() for text in texts)))
        return [self._assembled(text) for text in texts]

    def deltas(self, text: bytes) -> np.ndarray:
        """Change of the count at each code point of a whole text."""
        return self.deltas_of([text])[0]

    def _assembled(self, text: bytes) -> np.ndarray:
        raw, words = np.frombuffer(text, np.uint8), text.split()
        letters = (raw & 0xC0) != 0x80
        inside = ~WHITE[raw[letters]]
        out = np.zeros(len(inside), np.int32)
        if self.long_words and not self.long_words.keys().isdisjoint(words):
            out[inside] = np.concatenate([np.frombuffer(self.words[w], np.int8) if w in self.words else np.frombuffer(self.long_words[w], "<i4") for w in words])
        else:
            out[inside] = np.frombuffer(b"".join(map(self.words.__getitem__, words)), np.int8)
        return out


def _steps(counts: list[int]) -> bytes:
    """Changes from count to count, beginning at 0."""
    return array("i", map(int.__sub__, counts, [0, *counts[:-1]])).tobytes()


_joining: set[str] = set()


def _starts(letter: str) -> bool:
    """Whether no normalisation reaches back across this letter."""
    if not _joining:
        for code in range(0x110000):
            parts = unicodedata.decomposition(chr(code)).split()
            if len(parts) == 2 and not parts[0].startswith("<"):
                _joining.add(chr(int(parts[1], 16)))
        _joining.update(map(chr, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]))
    return unicodedata.combining(letter) == 0 and letter not in _joining


def pack(deltas: np.ndarray) -> bytes:
    width = 2 if not len(deltas) or np.abs(deltas).max() < 1 << 15 else 4
    return struct.pack("<QB", len(deltas), width) + zstandard.compress(deltas.astype(f"<i{width}").tobytes(), 1)


def prefix_table(packed: bytes) -> np.ndarray:
    """Token counts of the prefixes of 0, 1, 2 .. code points."""
    size, width = struct.unpack("<QB", packed[:9])
    raw = zstandard.decompress(packed[9:], max_output_size=max(1, size * width))
    return np.concatenate([[0], np.cumsum(np.frombuffer(raw, f"<i{width}"), dtype=np.int64)])


def count_at(packed: bytes, characters: int) -> int:
    return int(prefix_table(packed)[characters])


def longest_prefix(packed: bytes, budget: int) -> int:
    """Code points of the longest prefix that has at most ``budget`` tokens."""
    return int(np.flatnonzero(prefix_table(packed) <= budget)[-1])


def _together(texts: Iterable[bytes]) -> Iterator[list[bytes]]:
    """Texts in runs of about ``TEXTS_TOGETHER`` bytes."""
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= TEXTS_TOGETHER:
            yield held
            held, size = [], 0
    if held:
        yield held


def count_prefixes(docs: DataFrame, tokenizer: str, key: str = "doc_id", text: str = "text", budget: int | None = None) -> DataFrame:
    """Per row: key, n_bytes, n_tokens and ``prefixes``, the packed counts of all prefixes.

    With a ``budget`` also over_limit and the code points of the longest prefix within it, read from
    the packed counts while they are at hand.
    """

    def work(batches):
        counter = once(PrefixCounter, tokenizer)
        for batch in batches:
            sizes, tokens, packed, within = [], [], [], []
            for texts in _together(utf8(batch["text"])):
                for raw, deltas in zip(texts, counter.deltas_of(texts)):
                    sizes.append(len(raw))
                    tokens.append(int(deltas.sum()))
                    packed.append(pack(deltas))
                    if budget is not None:
                        within.append(longest_prefix(packed[-1], budget))
            columns = [batch["key"], pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array(packed, pa.binary())]
            names = [key, "n_bytes", "n_tokens", "prefixes"]
            if budget is not None:
                columns += [pa.array([n > budget for n in tokens], pa.bool_()), pa.array(within, pa.int64())]
                names += ["over_limit", "prefix_chars"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    schema = f"`{key}` {kind}, n_bytes long, n_tokens long, prefixes binary"
    return rows.mapInArrow(work, schema + (", over_limit boolean, prefix_chars long" if budget is not None else ""))


def within_budget(rows: DataFrame, budget: int) -> DataFrame:
    """Adds over_limit and the code points and tokens of the longest prefix within the budget."""

    @F.pandas_udf("long")
    def prefix(packed):
        return packed.map(lambda p: longest_prefix(p, budget))

    return rows.withColumns({"over_limit": F.col("n_tokens") > budget, "prefix_chars": prefix("prefixes")})
