"""Personal data in texts, also where it is disguised, with the places in the source text.

Plain identifiers are found as written. Transducers then rewrite disguises: letters that look like
ASCII ones, spelled digits (also mixed with figures), and words and brackets for @ and dot. Each rewritten character keeps the range of
source characters it came from, so what is found in the rewritten text is mapped back. Such a span
is added only if it holds something rewritten and no plain span of its kind covers it wholly; a plain
span that is only a part of it stays beside it.

Edge cases: null counts as an empty text; ids may be null or repeat (a row out per row in); an empty
table gives an empty table; extra columns are left out.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

Span = tuple[int, str, int]
KINDS = ["email", "ip", "card", "phone"]

# Letters of other scripts that look like ASCII letters, each with that letter.
LOOKALIKES = dict(zip(
    "АВЕКМНОРСТУХасеорхуіјѕԁԛԝһΑΒΕΖΗΙΚΜΝΟΡΤΥΧονρɑɡıⅼ",
    "ABEKMHOPCTYXaceopxyijsdqwhABEZHIKMNOPTYXovpagil",
    strict=True,
))
# Characters without width.
WIDTHLESS = "­​‌‍⁠﻿"
# Spelled digits.
DIGITS = dict(zip("zero one two three four five six seven eight nine".split(), "0123456789", strict=True))

LOCAL = r"[A-Za-z0-9._%+-]"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL_END = re.compile(LOCAL + r"++")
# Possessive and begun at the first digit of a run: the same matches as the plain patterns, without
# going back over long runs.
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
NUMBER = "|".join(DIGITS)
SPELLED = re.compile(rf"(?<![A-Za-z])(?:{NUMBER})(?![A-Za-z])", re.I)
# Spelled digits and numbers that stand alone, of which a run may be mixed.
DIGIT_PART = re.compile(SPELLED.pattern + r"|(?<![A-Za-z0-9])[0-9]++(?![A-Za-z])", re.I)
BRACKET_WORD = re.compile(r"[\[({<]\s{0,3}(at|dot|@|\.)\s{0,3}[\])}>]", re.I)
SIGN_WORDS = {"@": "at", ".": "dot"}
BARE_AT = re.compile(r"(?<=[A-Za-z0-9_%+-])\s{1,3}at(?=\s{1,3}[A-Za-z0-9])", re.I)
BARE_DOT = re.compile(r"(?<=[A-Za-z0-9])\s{1,3}dot\s{1,3}(?=[A-Za-z0-9])", re.I)
DIGIT_DOT = re.compile(r"(?<=[0-9])\s{1,3}(?:dot|point)\s{1,3}(?=[0-9])", re.I)
LABEL = re.compile(r"[A-Za-z0-9-]++")


def passes_luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def plain_spans(text: str) -> list[Span]:
    """(start, kind, end) of identifiers as written; leftmost and apart within a kind."""
    spans: list[Span] = []
    if "@" in text:
        free = 0
        for match in DOMAIN.finditer(text):
            start = match.start()
            while start > free and _local(text[start - 1]):
                start -= 1
            if start < match.start():
                spans.append((start, "email", match.end()))
                free = match.end()
    for match in IP.finditer(text):
        if all(len(part.lstrip("0")) <= 3 and int(part[-4:]) <= 255 for part in match.group().split(".")):
            spans.append((match.start(), "ip", match.end()))
    for match in CARD.finditer(text):
        digits = match.group().replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and passes_luhn(digits):
            spans.append((match.start(), "card", match.end()))
    if "+" in text:
        for match in PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in match.group()) <= 15:
                spans.append((match.start(), "phone", match.end()))
    return spans


def _local(letter: str) -> bool:
    return letter.isascii() and (letter.isalnum() or letter in "._%+-")


class Rewritten:
    """A text and, for each of its characters, the source range and whether it was rewritten."""

    def __init__(self, text: str):
        self.text = text
        self.starts = list(range(len(text)))
        self.ends = list(range(1, len(text) + 1))
        self.new = [False] * len(text)

    def replace(self, edits: list[tuple[int, int, str]]) -> None:
        """Replaces ranges of the present text, given in order and apart."""
        text, starts, ends, new, done = [], [], [], [], 0
        for low, high, by in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[done:low])
            starts += self.starts[done:low]
            ends += self.ends[done:low]
            new += self.new[done:low]
            done = high
            if by:
                text.append(by)
                starts += [self.starts[low]] * len(by)
                ends += [self.ends[high - 1]] * len(by)
                new += [True] * len(by)
        self.text, self.starts, self.ends, self.new = "".join(text), starts, ends, new


def _folded(letter: str) -> str | None:
    """The ASCII letter it stands for, "" if it has no width, None if it stays."""
    if letter in LOOKALIKES:
        return LOOKALIKES[letter]
    if letter in WIDTHLESS:
        return ""
    code = ord(letter)
    if 0xFF01 <= code <= 0xFF5E or 0x1D400 <= code <= 0x1D7FF or 0x2460 <= code <= 0x24FF or letter in "　․﹒﹫":
        plain = unicodedata.normalize("NFKC", letter)
        return plain if plain.isascii() and len(plain) == 1 else None
    return None


def fold_letters(text: Rewritten) -> None:
    if not text.text.isascii():
        folds = ((i, _folded(c)) for i, c in enumerate(text.text) if c > "\x7f")
        text.replace([(i, i + 1, by) for i, by in folds if by is not None])


def spell_digits(text: Rewritten) -> None:
    """Runs of three or more digits with spelled ones among them become digits; "plus", "dot" and "dash"
    beside them signs. What stands between two numbers in figures stays but for such words."""
    if not SPELLED.search(text.text):
        return
    parts = list(DIGIT_PART.finditer(text.text))
    edits: list[tuple[int, int, str]] = []
    at = 0
    while at < len(parts):
        run = [parts[at]]
        while at + len(run) < len(parts) and _between(text.text, run[-1].end(), parts[at + len(run)].start()) is not None:
            run.append(parts[at + len(run)])
        values = [DIGITS.get(part.group().lower()) for part in run]
        if any(values) and sum(1 if value else len(part.group()) for value, part in zip(values, run)) >= 3:
            plus = re.search(r"(?<![A-Za-z])plus\s{1,2}$", text.text[max(0, run[0].start() - 7):run[0].start()], re.I)
            if plus:
                low = max(0, run[0].start() - 7)
                edits.append((low + plus.start(), run[0].start(), "+"))
            for k, (part, value) in enumerate(zip(run, values)):
                if k:
                    low, sign = run[k - 1].end(), _between(text.text, run[k - 1].end(), part.start())
                    if value or values[k - 1] or sign and text.text[low:part.start()] != sign:
                        edits.append((low, part.start(), sign))
                if value:
                    edits.append((part.start(), part.end(), value))
        at += len(run)
    if edits:
        text.replace(edits)


def _between(text: str, start: int, end: int) -> str | None:
    """What stands for the gap between two digits; None if they do not belong together."""
    if end - start > 9:
        return None
    gap = text[start:end].strip().lower()
    bracketed = BRACKET_WORD.fullmatch(gap)
    if bracketed:
        gap = SIGN_WORDS.get(bracketed.group(1), bracketed.group(1))
    return {"": "", ",": "", "-": "-", "dash": "-", "dot": ".", "point": ".", ".": "."}.get(gap) if end > start else None


def spell_signs(text: Rewritten) -> None:
    """Words for @ and dot, where an address follows: bracketed, or bare with a dot in words as well or
    after a name with a digit or sign in it; worded dots also behind a plain @, between digits, and in
    brackets between any labels."""
    source = text.text
    bracketed = {m.start(): (m.end(), SIGN_WORDS.get(m.group(1), m.group(1).lower())) for m in BRACKET_WORD.finditer(source)}
    bare_dots = {m.start(): m.end() for m in BARE_DOT.finditer(source)}
    signs = [(s, e, True) for s, (e, word) in bracketed.items() if word == "at"]
    signs += [(m.start(), m.end(), False) for m in BARE_AT.finditer(source)]
    if bare_dots or bracketed:
        signs += [(m.start(), m.end(), True) for m in re.finditer(r"(?<=[A-Za-z0-9._%+-])@(?=[A-Za-z0-9-])", source)]
    edits: list[tuple[int, int, str]] = []
    free = 0
    for start, end, strong in sorted(signs):
        low, high = start, end
        while low > max(free, start - 3) and source[low - 1].isspace():
            low -= 1
        while high < min(len(source), end + 3) and source[high].isspace():
            high += 1
        if low <= free or not _local(source[low - 1]):
            continue
        found, at, dots, worded = [(low, high, "@")], high, 0, False
        while label := LABEL.match(source, at):
            at = label.end()
            dot = _dot(source, at, bracketed, bare_dots)
            if dot is None or not LABEL.match(source, dot):
                break
            if dot > at + 1:
                found.append((at, dot, "."))
                worded = True
            at, dots = dot, dots + 1
        handle = source[max(free, low - 64):low]
        handle = handle[len(handle) - _run(handle):]
        if dots and (strong or worded or any(c.isdigit() or c in "._+" for c in handle[:-1])):
            edits += found
            free = at
    edits += [(m.start(), m.end(), ".") for m in DIGIT_DOT.finditer(source)]
    for start, (_, word) in bracketed.items():
        low = start
        while low > max(0, start - 3) and source[low - 1].isspace():
            low -= 1
        high = _dot(source, start, bracketed, bare_dots) if word == "dot" else None
        if high and low and LABEL.match(source, low - 1) and LABEL.match(source, high):
            edits.append((low, high, "."))
    apart: list[tuple[int, int, str]] = []
    for edit in sorted(edits):
        if not apart or edit[0] >= apart[-1][1]:
            apart.append(edit)
    if apart:
        text.replace(apart)


def _run(text: str) -> int:
    size = 0
    while size < len(text) and _local(text[-1 - size]):
        size += 1
    return size


def _dot(source: str, at: int, bracketed: dict, bare: dict) -> int | None:
    """Where the dot at this place ends, written or in words."""
    if source.startswith(".", at):
        return at + 1
    if at in bare:
        return bare[at]
    low = at
    while low < min(len(source), at + 3) and source[low].isspace():
        low += 1
    if low in bracketed and bracketed[low][1] == "dot":
        high = bracketed[low][0]
        while high < min(len(source), bracketed[low][0] + 3) and source[high].isspace():
            high += 1
        return high
    return None


def disguised_spans(text: str, plain: list[Span]) -> list[Span]:
    """Spans found only after rewriting, at their places in the source."""
    rewritten = Rewritten(text)
    for step in (fold_letters, spell_digits, spell_signs):
        step(rewritten)
    if not any(rewritten.new) and len(rewritten.text) == len(text):
        return []
    added = []
    for start, kind, end in plain_spans(rewritten.text):
        low, high = rewritten.starts[start], rewritten.ends[end - 1]
        changed = any(rewritten.new[start:end]) or high - low != end - start
        if changed and not any(k == kind and s <= low and high <= e for s, k, e in plain):
            added.append((low, kind, high))
    return added


def _may_be_disguised(text: str) -> bool:
    return (
        not text.isascii() and any(_folded(c) is not None for c in set(text) if c > "\x7f")
        or BRACKET_WORD.search(text) is not None or SPELLED.search(text) is not None or BARE_AT.search(text) is not None
        or DIGIT_DOT.search(text) is not None or "@" in text and BARE_DOT.search(text) is not None
    )


def find(text: str) -> tuple[list[Span], list[Span]]:
    """The plain spans, and those that the rewriting adds; by start, then kind as listed."""
    plain = plain_spans(text)
    added = disguised_spans(text, plain) if _may_be_disguised(text) else []
    order = lambda span: (span[0], KINDS.index(span[1]))
    return sorted(plain, key=order), sorted(added, key=order)


def written(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, kind, end in sorted(spans, key=lambda s: (s[0], KINDS.index(s[1]))))


def find_personal_data(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, the number of plain spans of each kind, the number added, the digest of the
    plain spans, and all spans as kind:start:end in code points, the end exclusive."""

    def work(batches):
        for batch in batches:
            rows = [find(t or "") for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([
                batch["key"], *(pa.array([sum(s[1] == kind for s in plain) for plain, _ in rows], pa.int64()) for kind in KINDS),
                pa.array([len(added) for _, added in rows], pa.int64()),
                pa.array([hashlib.sha256(written(plain).encode()).hexdigest() for plain, _ in rows], pa.string()),
                pa.array([written(plain + added) for plain, added in rows], pa.string()),
            ], [key, *(f"n_{kind}" for kind in KINDS), "n_added", "base_sha256", "spans"])

    kind = docs.schema[key].dataType.simpleString()
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    return rows.mapInArrow(work, f"`{key}` {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", n_added long, base_sha256 string, spans string")
