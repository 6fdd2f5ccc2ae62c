"""Equi-joins that survive a key holding a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from hunkmill.session import landed

# A table of no more bytes than this is sent to all tasks instead of shuffled.
BROADCAST_BYTES = 32 << 20


def measured_bytes(rows: DataFrame) -> int:
    """Bytes of a table's values: 16 per column, and the length of texts."""
    size = F.lit(16 * len(rows.columns))
    for name, kind in rows.dtypes:
        if kind in ("string", "binary"):
            size = size + F.coalesce(F.octet_length(F.col(f"`{name}`")), F.lit(0))
    return rows.agg(F.sum(size.cast("long"))).first()[0] or 0


def fits(rows: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether a table may be broadcast."""
    return measured_bytes(rows) <= limit


def hot_keys(counts: DataFrame, keys: Sequence[str], rows: str = "_rows") -> DataFrame:
    """Out of rows per key, the keys with more rows than a task's even share, and ``_salts``, the
    number of shares they make. There are fewer of them than tasks, which bounds what is broadcast."""
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counts.agg(F.sum(rows)).first()[0] or 0
    share = F.col(rows) * tasks / F.lit(float(max(total, 1)))
    return counts.where(share > 1).select(*keys, F.ceil(share).cast("int").alias("_salts"))


def spread_join(
    facts: DataFrame,
    dimension: DataFrame,
    keys: Sequence[str],
    how: str = "inner",
    spread_by: Sequence[str] = (),
    hot: DataFrame | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``facts`` joined to ``dimension``, whatever share of the rows one key holds.

    The dimension is written once and measured (``broadcast_bytes`` 0 skips that); within the limit it
    is broadcast, and the facts stay where they are. Beyond that the rows of a hot key are dealt over
    as many tasks as it has even shares of the rows. Only the dimension rows of hot keys are repeated.
    Null keys of ``facts`` are dealt out too
    (they match nothing, but would all meet in one task). ``spread_by`` names the columns that tell
    rows of one key apart; ``how`` is one of inner, left, left_semi, left_anti. Pass ``hot`` (of
    ``hot_keys``) when the keys are counted already, else the keys of ``facts`` are counted first.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"unsupported join type: {how}")
    if broadcast_bytes:
        dimension = landed(dimension, "dimension")
        if fits(dimension, broadcast_bytes):
            return facts.join(F.broadcast(dimension), list(keys), how)
    if hot is None:
        hot = hot_keys(facts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")), keys)
    spread = list(spread_by) or [c for c in facts.columns if c not in keys]
    deal = F.pmod(F.xxhash64(*spread), F.col("_salts")).cast("int")
    left_hot = F.broadcast(hot.withColumnsRenamed({key: f"_hot_{key}" for key in keys}))
    match = F.lit(True)
    for key in keys:
        match = match & facts[key].eqNullSafe(left_hot[f"_hot_{key}"])
    dealt = facts.join(left_hot, match, "left").select(
        *[facts[c] for c in facts.columns],
        F.coalesce(deal, F.lit(0)).alias("_salt"),
    )
    repeated = dimension.join(F.broadcast(hot), list(keys), "left").select(
        *dimension.columns,
        F.explode(
            F.coalesce(F.sequence(F.lit(0), F.col("_salts") - 1), F.array(F.lit(0)))
        ).alias("_salt"),
    )
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")


def duplicate_keys(dimension: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that would multiply rows in a join; empty when the dimension is sound."""
    return (
        dimension.groupBy(*keys)
        .agg(F.count(F.lit(1)).alias("rows"))
        .where(F.col("rows") > 1)
    )


def join_commit_pr(details: DataFrame, pulls: DataFrame) -> DataFrame:
    """Commit file details with their pull request; one huge pull request is dealt out."""
    return spread_join(
        details, pulls.withColumnRenamed("id", "pr_id"), ["pr_id"], "inner", ["sha", "filename"]
    )


def join_repository(rows: DataFrame, repositories: DataFrame, spread_by: Sequence[str]) -> DataFrame:
    """Left join of the repository's language and stars; addresses that are null match nothing."""
    known = repositories.where(F.col("repo_url").isNotNull())
    return spread_join(rows, known, ["repo_url"], "left", spread_by)


def hunks_of_commits(
    hunks: DataFrame, commits: DataFrame, keys: Sequence[str] = ("repo", "commit_hash")
) -> DataFrame:
    """Hunks whose commit is in ``commits``."""
    wanted = commits.select(*keys).distinct()
    spread = [c for c in hunks.columns if c not in keys]
    return spread_join(hunks, wanted, list(keys), "left_semi", spread)


def co_located_hunks(
    hunks: DataFrame, commits: DataFrame, keys: Sequence[str] = ("repo", "commit_hash")
) -> DataFrame:
    """Hunks whose commit is in ``commits``, where both are tables in buckets of the keys
    (``writers.co_located``): neither is shuffled. One commit's hunks are never many."""
    return hunks.join(commits.select(*keys), list(keys), "left_semi")


def allowed_hunks(hunks: DataFrame, allowed: DataFrame) -> DataFrame:
    """Hunks in the calibrated (language, category, length) strata.

    The strata table is a product of short value lists (at most a few hundred rows).
    """
    keys = ["language", "file_category", "length_bucket"]
    return hunks.join(F.broadcast(allowed.select(*keys).distinct()), keys, "left_semi")
