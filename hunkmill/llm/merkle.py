"""Merkle manifest of a dataset with nested-interval labels.

Every row is a leaf; per group (source) and then over the groups, runs of ``FAN`` nodes become their
parent. Leaves are numbered over the whole table by group and id, and each node is labelled with the
interval of leaf numbers that it covers. Ancestry is containment: a node's parent is the node of the
next level whose interval holds its own. The join that attaches parents has the level and the place of
the run as its keys (the bucket that alone can hold the interval) and containment as its condition, so
every bucket has at most ``FAN`` rows, however large a group is. The siblings are the parent's interval
less the node's own: what lies to its left, and what lies to its right.

Numbers come from a range partitioning by (group, id, digest) that is written before it is counted: the
place within a part plus the rows of the parts before it. No part, group or level passes through one
task; from the second level on tables are a sixteenth of the one before.

Paths are made from the root down: each level adds its two sides to what its parent has. A proof is all
siblings from the leaf's run to the root; folding puts a leaf's digest between the two sides, level by
level.

Edge cases: null fields are hashed as ``-``, an empty text as ``0:``; a null source is a group of its
own and comes first, a null id comes first within its source; rows that repeat an id are ordered by
their digest, equal ones in any order; a group of one row is its own subroot, a single group's subroot
is the root, and without siblings the proof is the hash of nothing; a run of one is hashed all the same;
very long texts are hashed in the JVM as they are; an empty table gives an empty table; extra columns
are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from hunkmill.llm.sized import sent_if_small
from hunkmill.session import landed

FAN = 16
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Place of a row within its part, in the low bits of Spark's running id.
PLACE_BITS = 33
PATH = "array<struct<before: string, after: string>>"


def digest(*inputs: Column) -> Column:
    """Lower-case hex SHA-256 of the inputs one after the other."""
    return F.sha2(F.concat(*inputs), 256)


def field(value: Column) -> Column:
    """A value with its length in bytes, so that neighbouring fields cannot run into each other."""
    told = value.cast("string")
    return F.when(told.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told))


def numbered(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """The rows with ``rank``, from 0 in the given order (nulls first); written by parts of the order."""
    parts = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    parts = landed(parts, name)
    part = F.shiftright("place", PLACE_BITS)
    sizes = parts.groupBy(part.alias("part")).agg(F.count("*").alias("n"))
    # One row for each part.
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = landed(sizes.select("part", before.alias("before")), f"{name}-offsets")
    within = F.col("place").bitwiseAND(F.lit((1 << PLACE_BITS) - 1))
    placed = parts.join(sent_if_small(offsets, 16), part == F.col("part"))
    return placed.withColumn("rank", F.col("before") + within).drop("place", "part", "before")


def _parents(nodes: DataFrame, name: str) -> DataFrame:
    """The next level of all trees that have several nodes on this one: every node with its children."""
    runs = nodes.where("n > 1").groupBy("tree", F.floor(F.col("at") / FAN).alias("at"))
    level = runs.agg(
        F.sort_array(F.collect_list(F.struct("low", "high", "digest"))).alias("children"), F.min("low").alias("low"),
        F.max("high").alias("high"), F.ceil(F.first("n") / FAN).alias("n"), F.first("tree_at").alias("tree_at"),
    )
    return landed(level.withColumn("digest", F.sha2(F.concat_ws("", "children.digest"), 256)), name)


def _levels(nodes: DataFrame, name: str) -> list[DataFrame]:
    """The given nodes and all levels above them, up to one node in each tree."""
    levels, most = [nodes], nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        levels.append(_parents(levels[-1], f"{name}-{len(levels)}"))
        most = -(-most // FAN)
    return levels


def _attached(nodes: DataFrame, above: DataFrame | None, own: Sequence[str]) -> DataFrame:
    """The nodes with path, subroot and root, from the parents whose interval holds theirs.

    ``above`` has the parents by ``held`` (a tree, or null for the tree over the trees) and place.
    """
    kept = [F.col(f"node.{c}").alias(c) for c in own]
    bottom = nodes.withColumn("held", F.when(F.col("n") > 1, F.col("tree"))).withColumn("run", F.floor(F.when(F.col("n") > 1, F.col("at")).otherwise(F.col("tree_at")) / FAN))
    if above is None:
        return bottom.alias("node").select(*kept, F.array().cast(PATH).alias("path"), F.col("digest").alias("subroot"), F.col("digest").alias("root"))
    joined = bottom.alias("node").join(
        above.alias("above"),
        F.col("node.held").eqNullSafe(F.col("above.held")) & (F.col("node.run") == F.col("above.at"))
        & (F.col("above.low") <= F.col("node.low")) & (F.col("node.high") <= F.col("above.high")),
    )

    def side(outside) -> Column:
        return F.concat_ws("", F.transform(F.filter("above.children", outside), lambda c: c.digest))

    step = F.struct(side(lambda c: c.high <= F.col("node.low")).alias("before"), side(lambda c: c.low >= F.col("node.high")).alias("after"))
    subroot = F.when(F.col("node.n") > 1, F.col("above.subroot")).otherwise(F.col("node.digest"))
    return joined.select(*kept, F.concat(F.array(step), F.col("above.path")).cast(PATH).alias("path"), subroot.alias("subroot"), F.col("above.root").alias("root"))


def _with_paths(levels: list[DataFrame], over: DataFrame | None, own: Sequence[str]) -> DataFrame:
    """The lowest of the levels with its paths, from the highest level down; ``over`` has the lowest
    level of the tree over these trees."""
    inner = ["tree", "at", "low", "high", "children"]
    above = over
    for number, nodes in reversed(list(enumerate(levels))):
        found = _attached(nodes, above, own if number == 0 else inner)
        if number:
            found = found.withColumn("held", F.col("tree")).drop("tree")
            above = found if over is None else found.unionByName(over)
    return found


def manifest(rows: DataFrame, key: str, group: str, leaf: Column, other: Column | None = None) -> DataFrame:
    """Rows (key, leaf, other, subroot, root, path): one for each row of the table.

    ``leaf`` is the digest of a row, ``other`` a digest to be folded in its place (null: the leaf).
    """
    other = F.lit(None).cast("string") if other is None else other
    leaves = landed(rows.select(F.col(key).alias("key"), F.col(group).alias("group"), leaf.alias("digest"), other.alias("other")), "leaves")
    leaves = numbered(leaves, ["group", "key", "digest", "other"], "ordered-leaves")
    groups = leaves.groupBy("group").agg(F.count("*").alias("n"), F.min("rank").alias("first"))
    groups = landed(numbered(landed(groups, "groups"), ["first"], "ordered-groups").withColumnRenamed("rank", "tree"), "ranked-groups")
    total = groups.count()
    trees = sent_if_small(groups, 48)
    bottom = leaves.join(trees.withColumnRenamed("group", "of"), F.col("group").eqNullSafe(F.col("of"))).select(
        "key", "digest", "other", "tree", (F.col("rank") - F.col("first")).alias("at"), F.col("rank").alias("low"),
        (F.col("rank") + 1).alias("high"), "n", F.col("tree").alias("tree_at"),
    )
    levels = _levels(landed(bottom, "leaf-nodes"), "level")
    label = ["tree", "low", "high", "digest"]
    ends = [level.where("n = 1").select("tree", "tree_at", "low", "high", "digest") for level in levels]
    subroots = ends[0]
    for more in ends[1:]:
        subroots = subroots.union(more)
    subroots = landed(subroots, "subroots").select(F.lit(-1).cast("long").alias("tree"), F.col("tree_at").alias("at"), *label[1:], F.lit(total).cast("long").alias("n"), F.lit(0).cast("long").alias("tree_at"))
    above = _levels(subroots, "over")[1:]
    over = None
    if above:
        over = _with_paths(above, None, ["tree", "at", "low", "high", "children"])
        over = landed(over.withColumn("held", F.lit(None).cast("long")).drop("tree"), "over")
    found = _with_paths(levels, over, ["key", "digest", "other"])
    return found.select(F.col("key").alias(key), F.col("digest").alias("leaf"), "other", "subroot", "root", "path")


def proof() -> Column:
    """The hash of all siblings on the path, from the leaf's run to the root."""
    return F.sha2(F.concat_ws("", F.transform("path", lambda p: F.concat(p.before, p.after))), 256)


def folded(start: Column) -> Column:
    """The root that follows from a leaf's digest and the siblings on its path."""
    return F.aggregate("path", start, lambda found, p: digest(p.before, found, p.after))


def verified_manifest(docs: DataFrame) -> DataFrame:
    """Proofs of all documents; those with an id whose CRC-32 is a multiple of 5 are folded with their
    text in lower case, so ``verified`` tells whether that changed them."""
    def leaf(text: Column) -> Column:
        return digest(*[field(F.col(c)) for c in ("doc_id", "source", "lang", "n_chars")], field(text))

    chosen = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    tampered = F.when(chosen, leaf(F.translate("text", UPPER, LOWER)))
    rows = manifest(docs.select("doc_id", "source", "lang", "n_chars", "text"), "doc_id", "source", leaf(F.col("text")), tampered)
    rows = rows.select("doc_id", "leaf", "subroot", "root", proof().alias("proof_sha256"), folded(F.coalesce("other", "leaf")).alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
