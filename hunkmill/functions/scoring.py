"""Buckets, bands, calendar columns and ratios."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from hunkmill.functions import fixed_values as fv


def length_bucket(lines: Column) -> Column:
    result = None
    for name, below in fv.LENGTH_BUCKETS:
        if below is None:
            return result.otherwise(name)
        result = F.when(lines < below, name) if result is None else result.when(lines < below, name)
    return result


def bands(threshold: float) -> dict[str, float]:
    """Cut-offs around a calibrated threshold."""
    return {
        "low": max(0.0, threshold - fv.BAND_OFFSET),
        "medium": threshold,
        "high": min(fv.BAND_CEILING, threshold + fv.BAND_OFFSET),
    }


def ratio(part: Column, whole: Column) -> Column:
    """Zero where there is nothing to divide by."""
    return F.coalesce(F.try_divide(part.cast("double"), whole.cast("double")), F.lit(0.0))


def calendar_month(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM")


def utc_moment(text: Column) -> Column:
    """ISO text as a timestamp; text that is none becomes null."""
    return F.try_to_timestamp(text)


def plain_number(text: Column) -> Column:
    """Number out of text that may carry square brackets; anything else counts as 0."""
    bare = F.regexp_replace(text.cast("string"), r"[\[\]]", "")
    return F.coalesce(bare.try_cast("double"), F.lit(0.0))


def year_scaled(probability: Column, year: Column) -> Column:
    result = None
    for first, last, factor in fv.YEAR_FACTORS:
        tests = [year >= first] if first is not None else []
        tests += [year <= last] if last is not None else []
        fits = reduce(lambda a, b: a & b, tests)
        scaled = F.least(probability * factor, F.lit(1.0)) if factor > 1 else probability * factor
        result = F.when(fits, scaled) if result is None else result.when(fits, scaled)
    return result.otherwise(probability)


def ai_flag(probability: Column) -> Column:
    return (probability > fv.AI_FLAG_ABOVE).cast("int")


def period(year: Column, last_pre_year: int = fv.LAST_PRE_YEAR) -> Column:
    return F.when(year <= last_pre_year, fv.PRE_PERIOD).otherwise(fv.POST_PERIOD)


def not_nan(value: Column) -> Column:
    """NaN as null, so that aggregates skip it."""
    return F.when(~F.isnan(value), value)
