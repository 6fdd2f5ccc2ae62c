"""Uniform samples without replacement, the same on every run and every cluster."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkmill.functions.draws import bucket_of, order_key, unit_draw
from hunkmill.operators.joins import fits
from hunkmill.session import landed

STRATA = ("label", "language", "file_category", "length_bucket")

# Up to this cap Spark limits each group before it shuffles (window group limit).
GROUP_LIMIT = 1000
SALTS = 64


def _with_order(rows: DataFrame, key: Sequence[str], seed: int) -> DataFrame:
    return rows.withColumn("_order", order_key(seed, *[F.col(k) for k in key]))


def capped_sample(
    rows: DataFrame, strata: Sequence[str], cap: int, key: Sequence[str], seed: int = 42
) -> DataFrame:
    """At most ``cap`` rows of each stratum; rows with a null stratum are left out.

    Two steps, because a few strata over very many tasks would otherwise meet in a few reducers:
    first ``cap`` rows per (stratum, slot), where the slot comes from the input task so that every
    task sends at most ``cap`` rows per stratum, then ``cap`` rows per stratum out of the slots.
    The slots do not change which rows win.
    """
    present = rows.dropna(subset=list(strata))
    if cap > GROUP_LIMIT:
        return smallest_n(present, cap, key, seed, by=strata)
    order = ["_order", F.xxhash64(*rows.columns)]
    slotted = _with_order(present, key, seed).withColumn(
        "_slot", F.pmod(F.spark_partition_id(), F.lit(SALTS))
    )
    per_slot = Window.partitionBy(*strata, "_slot").orderBy(*order)
    per_stratum = Window.partitionBy(*strata).orderBy(*order)
    return (
        slotted.withColumn("_rank", F.row_number().over(per_slot))
        .where(F.col("_rank") <= cap)
        .withColumn("_rank", F.row_number().over(per_stratum))
        .where(F.col("_rank") <= cap)
        .drop("_order", "_slot", "_rank")
    )


def _cutoffs(
    rows: DataFrame,
    wanted: Callable[[Column], Column],
    key: Sequence[str],
    seed: int,
    by: Sequence[str],
) -> DataFrame:
    """The digest of the last row to take, per group: columns ``by``, ``_cut``, ``_ties`` (how many rows
    with that digest are taken) and ``_tied`` (how many there are).

    Groups taken whole have no row. The rows are read once, for ``by`` and ``key``: what is written is
    a count for each digest. Digests fall into 65,536 even buckets, whose counts show in which of them
    the last row lies; only that bucket is ordered, a repeated key being one digest of it. ``wanted``
    gives the number of rows from the size of the group.
    """
    keyed = _with_order(rows.select(*by, *[k for k in key if k not in by]), key, seed)
    counted = landed(keyed.groupBy(*by, "_order").agg(F.count(F.lit(1)).alias("_rows")), "digests")
    counted = counted.withColumn("_bucket", bucket_of(F.col("_order")))
    counts = counted.groupBy(*by, "_bucket").agg(F.sum("_rows").alias("_rows"))
    group = Window.partitionBy(*by)
    before = group.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    places = counts.select(
        *by, "_bucket", "_rows",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_before"),
        wanted(F.sum("_rows").over(group)).alias("_wanted"),
    )
    # One row per group.
    edges = landed(places.where(
        (F.col("_before") < F.col("_wanted"))
        & (F.col("_before") + F.col("_rows") >= F.col("_wanted"))
        | (F.col("_wanted") <= 0) & (F.col("_before") == 0)
    ).drop("_rows"), "edges")
    in_edge = Window.partitionBy(*by, "_bucket").orderBy("_order").rowsBetween(
        Window.unboundedPreceding, -1
    )
    edge = F.broadcast(edges) if fits(edges) else edges
    last = _null_safe(counted, edge.where("_wanted > 0"), [*by, "_bucket"], "inner").withColumn(
        "_until", F.col("_before") + F.coalesce(F.sum("_rows").over(in_edge), F.lit(0))
    )
    last = last.where(
        (F.col("_until") < F.col("_wanted")) & (F.col("_until") + F.col("_rows") >= F.col("_wanted"))
    ).select(
        *by, F.col("_order").alias("_cut"), (F.col("_wanted") - F.col("_until")).alias("_ties"),
        F.col("_rows").alias("_tied"),
    )
    none = edges.where("_wanted <= 0").select(
        *by, F.lit("").alias("_cut"), F.lit(0).alias("_ties"), F.lit(0).alias("_tied")
    )
    return landed(last.unionByName(none), "cut-offs")


def _null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    other = right.withColumnsRenamed({k: f"_right_{k}" for k in keys})
    same = F.lit(True)
    for k in keys:
        same = same & left[k].eqNullSafe(other[f"_right_{k}"])
    return left.join(other, same, how).drop(*[f"_right_{k}" for k in keys])


def _taken(rows: DataFrame, cuts: DataFrame, key: Sequence[str], seed: int, by: Sequence[str]) -> DataFrame:
    """All rows with ``_taken``: digests below the cut-off, and of those equal to it exactly so many.

    The rows are read once more, and small cut-offs are broadcast, so they are only filtered. Where all
    rows of a last digest are taken, and that is always so while keys do not repeat, nothing is ordered.
    Else the rows that share that digest share the key; which of them are taken follows from all their
    columns.
    """
    columns = rows.columns
    if by:
        joined = _null_safe(rows, F.broadcast(cuts) if fits(cuts) else cuts, by, "left")
    else:
        found = cuts.first()
        joined = rows.withColumns({"_cut": F.lit(found["_cut"] if found else None).cast("string"), "_ties": F.lit(found["_ties"] if found else None).cast("long")})
    joined = joined.withColumn("_order", order_key(seed, *[F.col(k) for k in key]))
    if cuts.where("_ties < _tied").isEmpty():
        return joined.withColumn("_taken", F.coalesce(F.col("_order") <= F.col("_cut"), F.lit(True))).select(*columns, "_taken")
    tied = F.coalesce(F.col("_order") == F.col("_cut"), F.lit(False))
    clear = joined.where(~tied).withColumn("_taken", F.coalesce(F.col("_order") < F.col("_cut"), F.lit(True)))
    last = Window.partitionBy(*by, "_order").orderBy(F.xxhash64(*columns))
    ties = joined.where(tied).withColumn("_taken", F.row_number().over(last) <= F.col("_ties"))
    return clear.select(*columns, "_taken").unionByName(ties.select(*columns, "_taken"))


def smallest_n(
    rows: DataFrame,
    n: int | Column,
    key: Sequence[str],
    seed: int = 42,
    by: Sequence[str] = (),
) -> DataFrame:
    """Exactly ``n`` random rows (of each ``by`` group), for any ``n``, without a global sort.

    The rows themselves are only filtered: against one value without ``by``, else against one value
    per group. Rows may share a key; then as many of them are taken as are wanted.
    """
    wanted = F.lit(n) if isinstance(n, int) else n
    cuts = _cutoffs(rows, lambda _: wanted, key, seed, by)
    return _taken(rows, cuts, key, seed, by).where("_taken").drop("_taken")


def sample_by_strata(
    hunks: DataFrame, key: Sequence[str], cap: int = 400, seed: int = 42
) -> DataFrame:
    return capped_sample(hunks, STRATA, cap, key, seed)


def capped_stratified(
    hunks: DataFrame,
    key: Sequence[str],
    max_rows: int = 6000,
    floor: int = 20,
    seed: int = 42,
    strata: Sequence[str] = STRATA,
) -> DataFrame:
    """All rows when there are at most ``max_rows``; else an even cap per stratum, then ``max_rows``.

    The cap is ``max(max_rows // strata, floor)``. Everything hangs on two counts, read first as one
    row.
    """
    sizes = hunks.groupBy(*strata).agg(F.count(F.lit(1)).alias("_rows"))
    complete = F.lit(True)
    for column in strata:
        complete = complete & F.col(column).isNotNull()
    found = sizes.agg(F.sum("_rows").alias("rows"), F.count_if(complete).alias("strata")).first()
    if (found["rows"] or 0) <= max_rows:
        return hunks
    capped = capped_sample(hunks, strata, max(max_rows // max(found["strata"], 1), floor), key, seed)
    order = order_key(seed, *[F.col(k) for k in key])
    return capped.orderBy(order, F.xxhash64(*hunks.columns)).limit(max_rows)


def sample_per_language(
    pulls: DataFrame,
    languages: Sequence[str],
    per_language: int = 40,
    key: Sequence[str] = ("id",),
    seed: int = 42,
) -> DataFrame:
    """Pull requests of the wanted repository languages, at most ``per_language`` each."""
    wanted = pulls.where(F.col("language").isin(list(languages))).fillna(0, subset=["stars"])
    return capped_sample(wanted, ["language"], per_language, key, seed)


def sample_commits_per_month(
    commits: DataFrame,
    per_month: int = 60,
    seed: int = 42,
    strata: Sequence[str] = ("repo", "calendar_month"),
    key: Sequence[str] = ("commit_hash",),
) -> DataFrame:
    return capped_sample(commits, strata, per_month, key, seed)


def sample_per_year(
    messages: DataFrame, key: Sequence[str], per_year: int = 400, seed: int = 42
) -> DataFrame:
    return capped_sample(messages, ["year"], per_year, key, seed)


def balance_classes(
    human: DataFrame,
    machine: DataFrame,
    key: Sequence[str],
    seed: int = 42,
    require_enough: bool = False,
) -> DataFrame:
    """Machine rows (label 1) and as many random human rows (label 0).

    With fewer human than machine rows all of them stay, or, with ``require_enough``, the job fails.
    """
    wanted = machine.count()
    if require_enough and human.limit(wanted).count() < wanted:
        raise ValueError("fewer human than machine texts")
    picked = smallest_n(human, wanted, key, seed)
    return picked.withColumn("label", F.lit(0)).unionByName(machine.withColumn("label", F.lit(1)))


def split_by_draw(
    rows: DataFrame, key: Sequence[str], test_share: float = 0.2, seed: int = 42
) -> DataFrame:
    """Adds ``is_test``: a row-local draw, no shuffle; the share is met on average."""
    digest = order_key(seed, *[F.col(k) for k in key])
    return rows.withColumn("is_test", (unit_draw(digest) < test_share).cast("int"))


def split_exact(
    rows: DataFrame,
    key: Sequence[str],
    test_share: float = 0.2,
    seed: int = 42,
    by: Sequence[str] = ("label",),
) -> DataFrame:
    """Adds ``is_test`` with exactly ``ceil(share * n)`` test rows in each group."""
    cuts = _cutoffs(rows, lambda size: F.ceil(size * F.lit(test_share)), key, seed, by)
    # Without a cut the whole group is taken.
    return _taken(rows, cuts, key, seed, by).withColumn("is_test", F.col("_taken").cast("int")).drop("_taken")


def shuffle_head(
    rows: DataFrame, n: int, key: Sequence[str], seed: int = 0, batch: int | None = None
) -> DataFrame:
    """The first ``n`` rows of a repeatable shuffle; with ``batch`` only whole batches are kept."""
    if batch:
        kept = rows.limit(n).count()
        return smallest_n(rows, kept - kept % batch, key, seed)
    return smallest_n(rows, n, key, seed)
