"""Repeatable random order: an MD5 of a seed and the row's key.

Independent of partitioning, retries and engines, unlike ``rand`` and ``randomSplit``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, functions as F

SPAN = 4294967296.0


def order_key(seed: int, *key: Column) -> Column:
    """Text whose order is a repeatable shuffle of the keys (keys: integers or text).

    Different keys are digested from different texts: nulls are written as a sign of their own, and
    separators inside a key are escaped. Whole numbers are written plainly.
    """
    return F.md5(order_text(seed, *key))


def order_text(seed: int, *key: Column) -> Column:
    """What ``order_key`` digests."""
    return F.concat_ws("|", F.lit(str(seed)), *[_plain(k.cast("string")) for k in key])


def _plain(part: Column) -> Column:
    escaped = F.replace(F.replace(part, F.lit("\\"), F.lit("\\\\")), F.lit("|"), F.lit("\\p"))
    return F.coalesce(escaped, F.lit("\\n"))


def unit_draw(digest: Column) -> Column:
    """[0, 1) from the first eight hex digits of a digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / SPAN


def drawn_below(digest: Column, chance: float) -> Column:
    """Whether ``unit_draw`` is below ``chance``, by comparing hex digits as text instead of numbers."""
    bound = math.ceil(chance * SPAN)
    if bound >= SPAN:
        return digest.isNotNull()
    return digest < F.lit(f"{max(bound, 0):08x}")


def bucket_of(digest: Column, digits: int = 4) -> Column:
    """0 .. 16^digits - 1 from the leading hex digits, in the order of the digest."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("int")
