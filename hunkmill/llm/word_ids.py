"""Token ids of texts through the tokenizers library, one call for each distinct word.

The vocabulary drops white space and its pre-tokenizer never crosses it, so the ids of a text are
those of its parts between ASCII white space. Other white space stays inside a part and is left to
the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array
from collections.abc import Callable, Iterable

import numpy as np
import regex

#: Bytes that a worker keeps of words, about, and the longest word that is kept.
KEPT_MEMORY = 96 << 20
KEPT_BYTES = 64
#: What an entry takes beside its bytes.
ENTRY = 190


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable bytes for themselves,
    the others in order from code point 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Memo(dict):
    """What ``make`` gives for a word; emptied when full, so its memory is bounded."""

    def __init__(self, make: Callable[[bytes], bytes], limit: int = KEPT_MEMORY):
        super().__init__()
        self.make, self.limit, self.held = make, limit, 0

    def __missing__(self, word: bytes) -> bytes:
        value = self.make(word)
        if len(word) <= KEPT_BYTES:
            self.keep(word, value)
        return value

    def keep(self, word: bytes, value: bytes) -> None:
        self.held += ENTRY + len(word) + len(value)
        if self.held > self.limit:
            self.clear()
            self.held = ENTRY + len(word) + len(value)
        self[word] = value


class WordIds:
    """Encodes texts with a tokenizers file, without added special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        #: Bytes of an id in files.
        self.kind = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.kind.itemsize == 2 else "I"
        self.model = self.library.model
        self.memo: dict[bytes, bytes] = {}
        self.held = 0
        self.pieces, self.letters = self._parting(path)

    def _parting(self, path: str) -> tuple[regex.Pattern | None, list[str]]:
        """How the library cuts a word into pieces, if it does so by one pattern on lower-cased NFC text
        and then maps bytes to letters; None for any other kind of file."""
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        normal = [step["type"] for step in (spec["normalizer"] or {}).get("normalizers", [])]
        cut = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [step["type"] for step in cut] != ["Split", "ByteLevel"]:
            return None, []
        if not cut[0]["invert"] or cut[0]["behavior"] != "Removed" or cut[1]["add_prefix_space"] or cut[1].get("use_regex"):
            return None, []
        return regex.compile(cut[0]["pattern"]["Regex"]), byte_letters()

    def _ids(self, text: str) -> list[int] | None:
        """The ids of a word straight from the vocabulary's merges; None where the library must see it:
        special strings, and text that normalising could change."""
        if self.pieces is None or "<" in text or not text.isascii() and (text != text.lower() or not unicodedata.is_normalized("NFC", text)):
            return None
        found, tokenize, letters = [], self.model.tokenize, self.letters
        for piece in self.pieces.findall(text):
            found += [token.id for token in tokenize(piece if piece.isascii() and piece.isprintable() else "".join([letters[b] for b in piece.encode()]))]
        return found

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        found, left = {}, []
        for word in words:
            ids = self._ids(word.decode("utf-8", "replace")) if word == word.lower() else None
            if ids is None:
                left.append(word)
            else:
                found[word] = array(self.code, ids).tobytes()
        texts = [word.decode("utf-8", "replace") for word in left]
        for word, one in zip(left, self.library.encode_batch_fast(texts, add_special_tokens=False) if left else ()):
            found[word] = array(self.code, one.ids).tobytes()
        return found

    def encode(self, text: bytes) -> bytes:
        """The ids; words that are new to this worker go through the library together."""
        if b"<|" not in text:  # the vocabulary is lower case; only its special strings tell cases apart
            text = text.lower()
        words = text.split()
        new = set(words).difference(self.memo)
        found = self._learn(list(new)) if new else {}
        short = {word: ids for word, ids in found.items() if len(word) <= KEPT_BYTES}
        self.held += sum(ENTRY + len(word) + len(ids) for word, ids in short.items())
        if len(short) == len(found) and self.held <= KEPT_MEMORY:
            self.memo.update(short)
            return b"".join(map(self.memo.__getitem__, words))
        out = b"".join(found[w] if w in found else self.memo[w] for w in words)
        if self.held > KEPT_MEMORY:
            self.memo, self.held = {}, 0
        else:
            self.memo.update(short)
        return out


_loaded: dict[tuple, object] = {}


def once(make: Callable, *args):
    """``make(*args)``, built once per Python worker."""
    key = (make, *args)
    if key not in _loaded:
        _loaded[key] = make(*args)
    return _loaded[key]


def forget() -> None:
    """Drops what earlier steps have built in this worker, for steps that need the memory themselves."""
    _loaded.clear()


def utf8(column) -> Iterable[bytes]:
    """The UTF-8 bytes of an Arrow text column; null is empty."""
    import pyarrow as pa

    binary = column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())
    return (value.as_buffer().to_pybytes() if value.is_valid else b"" for value in binary)
