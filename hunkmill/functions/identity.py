"""Repository URLs and author identities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hunkmill.functions import fixed_values as fv
from hunkmill.functions.pytext import strip

API_HOST = "https://api.github.com/repos/"
WEB_HOST = "https://github.com/"


def repo_url(url: Column) -> Column:
    """Web address of a repository: API addresses mapped, one ``.git`` suffix dropped, '' is null."""
    web = F.replace(strip(F.nullif(url, F.lit(""))), F.lit(API_HOST), F.lit(WEB_HOST))
    return F.regexp_replace(web, r"\.git\z", "")


def repo_full_name(url: Column) -> Column:
    """What follows the first host mark of the normalised address, null without one."""
    web = repo_url(url)
    return F.when(
        F.contains(web, F.lit("github.com/")), F.regexp_extract(web, r"(?s)github\.com/(.*)\z", 1)
    )


def is_bot(*names: Column) -> Column:
    """Any bot or agent mark in any of the names; nulls and empty names do not count."""
    together = F.lower(F.concat_ws(" ", *names))
    return reduce(
        lambda a, b: a | b, [F.contains(together, F.lit(mark)) for mark in fv.BOT_MARKERS]
    )
