"""Unified-diff text as column expressions: no Python rows, no shuffle.

The hunk rule is applied to the whole patch with multi-line regular expressions, so it stays one
code-generated projection followed by one ``explode``.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from hunkmill.functions import fixed_values as fv
from hunkmill.functions.pytext import SPACE, unix_lines

# Cannot occur inside a line: it is itself a line end, and line ends are newlines by then.
BREAK = "\x1e"
# (?md): ^ and $ at every newline, and at nothing else.
LINES = "(?md)"


def added_snippets(patch: Column) -> Column:
    """Array of the code-like snippets of a patch.

    A snippet is a maximal run of added lines. ``+++`` lines are skipped and do not end a run; every
    other line does.
    """
    text = unix_lines(patch)
    text = F.regexp_replace(text, LINES + r"^\+\+\+.*(?:\n|\z)", "")
    text = F.regexp_replace(text, LINES + r"^(?!\+).*$", BREAK)
    text = F.regexp_replace(text, LINES + r"^\+", "")
    runs = F.split(F.btrim(text, F.lit("\n" + BREAK)), f"\n*{BREAK}[\n{BREAK}]*")
    return F.filter(runs, lambda run: run.rlike(fv.CODE_LIKE))


def line_count(snippet: Column) -> Column:
    """Lines with something other than white space."""
    return F.size(F.filter(F.split(snippet, "\n"), lambda line: line.rlike(f"[^{SPACE}]")))


def char_count(snippet: Column) -> Column:
    return F.length(snippet)


def file_sections(diff: Column) -> Column:
    """Array of per-file sections; text before the first header is not one of them."""
    sections = F.split(unix_lines(diff), LINES + r"^(?=diff --git )")
    starts = F.filter(sections, lambda section: section.startswith("diff --git "))
    return F.transform(starts, lambda section: F.regexp_replace(section, r"\n\z", ""))


def section_filename(section: Column) -> Column:
    """New name of the file: the last ``+++ b/`` line, else the header's ``b/`` word.

    Null when the header names no ``b/`` file in its fourth word, whatever follows.
    """
    gap = r"[\t \x1f\xa0\x{1680}\x{2000}-\x{200a}\x{202f}\x{205f}\x{3000}]+"
    word = rf"[^{SPACE}]"
    header = rf"\Adiff{gap}--git{gap}{word}+{gap}b/({word}*)"
    marks = F.regexp_extract_all(section, F.lit(LINES + r"^\+\+\+ b/(.*)$"), F.lit(1))
    name = F.when(F.size(marks) > 0, F.try_element_at(marks, F.lit(-1))).otherwise(
        F.regexp_extract(section, header, 1)
    )
    return F.when(section.rlike(header), F.nullif(name, F.lit("")))
