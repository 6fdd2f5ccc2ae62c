"""What a file name says about a file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hunkmill.functions import fixed_values as fv


def _has_any(text: Column, marks: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(mark)) for mark in marks])


def _forward_lower(filename: Column) -> Column:
    return F.replace(F.lower(filename), F.lit("\\"), F.lit("/"))


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*\z", 1)


def suffix(path: Column) -> Column:
    """Last dot and what follows, unless the dot is the first or last character of the name."""
    return F.regexp_extract(F.lower(base_name(path)), r"(?s)^.+(\.[^.]+)\z", 1)


def language(filename: Column, repo_language: Column | None = None) -> Column:
    """By suffix, else the repository's language, else ``Unknown``."""
    known = F.create_map(*[F.lit(x) for pair in fv.LANGUAGE_OF_EXTENSION.items() for x in pair])
    fallbacks = [] if repo_language is None else [F.nullif(repo_language, F.lit(""))]
    return F.coalesce(known[suffix(filename)], *fallbacks, F.lit("Unknown"))


def category(filename: Column) -> Column:
    """lockfile, docs, test, config or source; the first rule that fits wins."""
    path = _forward_lower(filename)
    ending = suffix(path)
    return (
        F.when(base_name(path).isin(fv.LOCKFILE_NAMES), "lockfile")
        .when(_has_any(path, fv.DOC_MARKERS) | ending.isin(fv.DOC_EXTENSIONS), "docs")
        .when(_has_any(path, fv.TEST_MARKERS), "test")
        .when(_has_any(path, fv.CONFIG_MARKERS) | ending.isin(fv.CONFIG_EXTENSIONS), "config")
        .otherwise("source")
    )


def is_generated(filename: Column) -> Column:
    return _has_any(_forward_lower(filename), fv.GENERATED_MARKERS)


def is_excluded(filename: Column) -> Column:
    return base_name(_forward_lower(filename)).isin(fv.LOCKFILE_NAMES) | is_generated(filename)
