"""Running totals over a global order, without one task that sees all rows."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkmill.session import landed

MAX_SLICES = 4096


def slice_edges(rows: DataFrame, value: str) -> list[float]:
    """Approximate quantiles of ``value``: a bounded list, whatever the data size.

    Slices hold about equally many of the rows given (distinct values), so values that crowd in a narrow range are still split.
    """
    slices = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slices = min(max(slices, 8), MAX_SLICES)
    shares = [i / slices for i in range(1, slices)]
    found = rows.agg(F.percentile_approx(value, shares, 10000)).first()[0] or []
    inner = sorted({edge for edge in found if math.isfinite(edge)})
    return [-math.inf, *inner, math.inf]


def running_totals(
    rows: DataFrame,
    value: str,
    measures: dict[str, Column],
    by: Sequence[str] = (),
    descending: bool = True,
) -> DataFrame:
    """One row per distinct ``value`` with ``run_*`` (up to and with it) and ``all_*`` sums.

    Rows are first aggregated per distinct value, so ties collapse before the shuffle. The values
    are then cut into slices by quantile; sums run inside each slice, and the totals of the slices
    before it are added from a table with one row per slice.
    """
    present = rows.where(F.col(value).isNotNull() & ~F.isnan(value))
    # Written, as the edges and the sums both read it: the rows themselves are read once.
    distinct = landed(
        present.groupBy(*by, value).agg(*[m.alias(name) for name, m in measures.items()]), "values"
    )
    edges = slice_edges(distinct, value)
    if len(edges) > 2:
        cut = Bucketizer(splits=edges, inputCol=value, outputCol="_slice")
        sliced = cut.transform(distinct).withColumn("_slice", F.col("_slice").cast("int"))
    else:
        sliced = distinct.withColumn("_slice", F.lit(0))

    def toward(column: str) -> Column:
        return F.col(column).desc() if descending else F.col(column).asc()

    names = list(measures)
    group = Window.partitionBy(*by)
    earlier = group.orderBy(toward("_slice")).rowsBetween(Window.unboundedPreceding, -1)
    next_slice = group.orderBy(toward("_slice"))
    head = F.max_by if descending else F.min_by
    per_slice = sliced.groupBy(*by, "_slice").agg(
        *[F.sum(name).alias(f"_sum_{name}") for name in names],
        *[head(name, value).alias(f"_head_{name}") for name in names],
    )
    offsets = per_slice.select(
        *by, "_slice",
        *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_off_{n}") for n in names],
        *[F.sum(f"_sum_{n}").over(group).alias(f"all_{n}") for n in names],
        *[F.lead(f"_head_{n}").over(next_slice).alias(f"_next_{n}") for n in names],
    )
    if not by:
        offsets = F.broadcast(offsets)  # one row per slice, at most MAX_SLICES
    inside = Window.partitionBy(*by, "_slice").orderBy(toward(value))
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return sliced.join(offsets, [*by, "_slice"]).select(
        *by, value, *names,
        *[(F.col(f"_off_{n}") + F.sum(n).over(running)).alias(f"run_{n}") for n in names],
        *[F.col(f"all_{n}") for n in names],
        *[F.coalesce(F.lead(n).over(inside), F.col(f"_next_{n}")).alias(f"next_{n}") for n in names],
    )


def exact_quantiles(rows: DataFrame, value: str, shares: dict[str, float]) -> DataFrame:
    """One row of exact quantiles, linear between neighbours, plus ``n``, ``low`` and ``high``."""
    counted = running_totals(
        rows, value, {"rows": F.count(F.lit(1))}, descending=False
    ).withColumn("_from", F.col("run_rows") - F.col("rows"))

    def at(place: Column) -> Column:
        inside = (F.col("_from") <= place) & (place < F.col("run_rows"))
        return F.max(F.when(inside, F.col(value)))

    columns = []
    for name, share in shares.items():
        place = (F.col("all_rows") - 1) * F.lit(share)
        low, high = at(F.floor(place)), at(F.ceil(place))
        part = F.max(place - F.floor(place))
        columns.append((low + (high - low) * part).alias(name))
    return counted.agg(
        F.max("all_rows").alias("n"), F.min(value).alias("low"), F.max(value).alias("high"), *columns
    )
