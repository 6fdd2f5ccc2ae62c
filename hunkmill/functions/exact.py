"""Sums of doubles that come out the same in any order.

Each value is counted in steps of ``2^-30``, which are whole numbers, and whole numbers add up alike
however the rows are dealt. Means of the same values are therefore equal to the last bit, so rows that
tie stay tied, and scores can be ranked as they are. A value is off by half a step at most.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

BITS = 30
STEPS = float(1 << BITS)


def in_steps(value: Column) -> Column:
    """The value as a whole number of steps."""
    return F.floor(value * STEPS + 0.5).cast("long")


def mean(value: Column) -> Column:
    """The mean of a group's values; null without any. The sum holds 10^18 steps."""
    return F.sum(in_steps(value)) / F.count(value) / STEPS


def spread(value: Column) -> Column:
    """The population's standard deviation of a group's values; 0 where it is below one step."""
    steps = in_steps(value)
    n, total = F.count(value), F.sum(steps).cast("decimal(19,0)")
    squares = F.sum(steps.cast("decimal(19,0)") * steps.cast("decimal(19,0)"))
    # n^2 times the variance, a whole number.
    scaled = n.cast("decimal(19,0)") * squares - total * total
    return F.when(n == 0, F.lit(None)).when(scaled < n * n, 0.0).otherwise(F.sqrt(scaled.cast("double")) / n / STEPS)


def mean_sql(value: str) -> str:
    return f"(sum(CAST(floor(({value}) * {STEPS!r}::DOUBLE + 0.5) AS BIGINT))::DOUBLE / count({value}) / {STEPS!r}::DOUBLE)"


def spread_sql(value: str) -> str:
    steps = f"CAST(floor(({value}) * {STEPS!r}::DOUBLE + 0.5) AS HUGEINT)"
    scaled = f"(count({value}) * sum({steps} * {steps}) - sum({steps}) * sum({steps}))"
    return f"(CASE WHEN {scaled} < count({value}) * count({value}) THEN 0.0 ELSE sqrt({scaled}::DOUBLE) / count({value}) / {STEPS!r}::DOUBLE END)"
