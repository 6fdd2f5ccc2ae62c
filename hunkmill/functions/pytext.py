"""Text expressions that follow Python's Unicode-aware ``strip``/``split``/``splitlines``."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hunkmill.functions import fixed_values as fv

# Characters str.split() treats as white space, and those str.splitlines() ends a line at.
SPACE = r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"
SPACE_CODES = [
    *range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029,
    0x202F, 0x205F, 0x3000,
]
SPACE_CHARACTERS = "".join(map(chr, SPACE_CODES))
RARE_LINE_ENDS = [chr(n) for n in (13, 11, 12, 28, 29, 30, 0x85, 0x2028, 0x2029)]

# Word tokens of the built-in language model: runs of letters/digits/underscore, or one other sign.
TOKEN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(SPACE_CHARACTERS))


def words(text: Column) -> Column:
    """White-space separated words, no empty ones."""
    return F.filter(F.split(text, f"[{SPACE}]+"), lambda word: word != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def one_space(text: Column) -> Column:
    """Every white-space run becomes one space; none at the ends."""
    return F.array_join(words(text), " ")


def unix_lines(text: Column) -> Column:
    """Every line end Python knows becomes a newline.

    Most texts have none but the newline, and plain byte searches find that out about ten times
    faster than the regular expression would.
    """
    rare = [F.contains(text, F.lit(end)) for end in RARE_LINE_ENDS]
    some = reduce(lambda a, b: a | b, rare)
    return F.when(some, F.regexp_replace(text, LINE_END, "\n")).otherwise(text)


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def space_pieces(text: Column) -> Column:
    """Pieces between single spaces; empty pieces stay."""
    return F.split(text, " ", -1)


def trim_to_shorter(left: Column, right: Column) -> tuple[Column, Column]:
    """Both texts cut to the piece count of the shorter one."""
    left_pieces, right_pieces = space_pieces(left), space_pieces(right)
    keep = F.least(F.size(left_pieces), F.size(right_pieces))
    return (
        F.array_join(F.slice(left_pieces, F.lit(1), keep), " "),
        F.array_join(F.slice(right_pieces, F.lit(1), keep), " "),
    )


def cut_at_occurrence(text: Column, part: str, occurrence: int) -> Column:
    """Text before the k-th ``part``, or all of it when there are fewer.

    Occurrences are counted without overlap, so ``part`` must not overlap itself.
    """
    if occurrence < 1:
        raise ValueError("occurrence starts at 1")
    if any(part.startswith(part[-size:]) for size in range(1, len(part))):
        raise ValueError("part must not overlap itself")
    return F.substring_index(text, part, occurrence)


def drop_last_word(text: Column) -> Column:
    pieces = space_pieces(text)
    return F.array_join(F.slice(pieces, F.lit(1), F.size(pieces) - 1), " ")


def first_tokens(text: Column, count: int) -> Column:
    """The prompt prefix: the first ``count`` tokens, in the text's own spelling."""
    found = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    return F.array_join(F.slice(found, 1, count), " ")


def clean_prompt(text: Column) -> Column:
    return reduce(lambda t, tag: F.replace(t, F.lit(tag), F.lit("")), fv.PROMPT_TAGS, text)


def clean_story(text: Column) -> Column:
    replaced = reduce(
        lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), fv.STORY_REPLACEMENTS, text
    )
    return strip(replaced)


def has_rejected_word(text: Column) -> Column:
    return reduce(
        lambda a, b: a | b, [F.contains(text, F.lit(word)) for word in fv.REJECTED_STORY_WORDS]
    )


def question_answer(question: Column, answer: Column) -> Column:
    return F.concat(F.lit("Question: "), question, F.lit(" Answer:" + fv.SEPARATOR), answer)


def before_separator(text: Column) -> Column:
    return F.substring_index(text, fv.SEPARATOR, 1)


def separator_to_space(text: Column) -> Column:
    return F.replace(text, F.lit(fv.SEPARATOR), F.lit(" "))


def escape_newlines(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("\\n"))


def mask_count(text: Column) -> Column:
    """Words that start like a mask mark."""
    return F.regexp_count(text, F.lit(f"(?:^|(?<=[{SPACE}]))" + fv.MASK_PREFIX))
