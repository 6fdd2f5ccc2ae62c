"""N-gram Jaccard join by prefixes under several global orders.

Documents are sets of hashed word shingles. Two sets of sizes a and b can only reach the similarity if
they share a token among the first ``size - least common + 1`` tokens of each, whatever the order of
all tokens, as long as it is the same for all documents. So several orders filter one after the other:

1. By hash, lengthened: the first tokens plus a tenth of the set. A linked document has a tenth of
   its least overlap there in tokens that another set has as well; most documents go here.
2. By rarity: for the rest all tokens are counted. Documents with too few repeated tokens go. Those
   sharing one of their first tokens, rarest first, form families.
3. Within a family a pair must share first tokens by rarity and under two more hash orders; only then
   the exact overlap is counted.

Equal sets are one set throughout, with the number of its copies. Tokens move between tasks as packed
blobs. Families of more than ``BLOCK_ROWS`` sets are cut into blocks, and every two blocks meet in a
group of their own, so each pair of unlike sets is looked at once, no task holds more than two blocks,
and nothing is capped. A group gives the number of links per set and just the pairs that connect its
classes; links of a family of unlike texts take time by their number, copies none.

Hashes have 64 bits. Tokens that a share of 1/256 of a task's sets have are looked for first; those
found come last in the order by rarity and are not dealt, so that no bucket holds a common passage.

Edge cases: null and empty texts have no set (size 0) and are their own class; with fewer words than
the width the whole sequence is one shingle; rows that repeat an id keep a row each; a null id counts
for no minimum and gets its class's smallest id, or null; an empty table gives an empty table; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from hunkmill.llm.dealing import BLOBS, GATHERED, bucket_runs, dealt, groups, in_buckets, mixed
from hunkmill.llm.graphs import connected
from hunkmill.llm.sized import sent_if_small
from hunkmill.llm.word_ids import forget, utf8
from hunkmill.session import landed

WIDTH, PERCENT = 5, 75
BLOCK_ROWS = 512
#: A token is looked at as common from this share of a task's sets on, and this share of all.
COMMON_LOCAL, COMMON_ALL = 256, 512
POST = np.dtype([("t", "<u8"), ("k", "<u8")])
RANKED = np.dtype([("t", "<u8"), ("k", "<u8"), ("df", "<u4")])
SIZE_MARK, COMMON_DF = np.uint64(0), np.uint32(0xFFFFFFFF)


def shingles(text: bytes, width: int = WIDTH) -> np.ndarray:
    """The distinct shingles of a text as ascending 64-bit hashes; A-Z lower-cased, ASCII white space."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh3_64_intdigest(b" ".join(words), len(words)) or 1], np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    size = len(words) - width + 1
    out = np.full(size, width, np.uint64)
    for k in range(width):
        out = mixed(out ^ hashes[k:k + size], k + 1)
    out[out == SIZE_MARK] = 1
    return np.unique(out)


def set_key(tokens: np.ndarray) -> int:
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) or 1


def least_common(size):
    """Tokens that a set of this size shares with any linked one, at least."""
    return -(-PERCENT * size // 100)


def _signed(number: int) -> int:
    return number - (1 << 64) if number >= 1 << 63 else number


def _members(docs: DataFrame, key: str, text: str) -> DataFrame:
    """doc, size, key of every row; the key is null for empty sets."""

    def work(batches):
        forget()
        for batch in batches:
            sets = [shingles(t) for t in utf8(batch["text"])]
            yield pa.RecordBatch.from_arrays([
                batch["doc"], pa.array([len(s) for s in sets], pa.int64()), pa.array([_signed(set_key(s)) if len(s) else None for s in sets], pa.int64()),
            ], ["doc", "size", "key"])

    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    return landed(rows.mapInArrow(work, "doc long, size long, key long"), "members")


def _first_by_hash(tokens: np.ndarray) -> np.ndarray:
    size = len(tokens)
    prefix = min(size, size - least_common(size) + -(-size // 10))
    if prefix == size:
        return tokens
    return tokens[np.argpartition(mixed(tokens, 11), prefix - 1)[:prefix]]


def _repeated_counts(docs: DataFrame, text: str, partitions: int) -> DataFrame:
    """(key, n): how many of a set's first tokens by hash occur in another set; at least that many."""
    buckets = partitions

    def post(batches):
        forget()
        held, size, seen = [], 0, set()
        for batch in batches:
            for raw in utf8(batch["text"]):
                tokens = shingles(raw)
                key = set_key(tokens) if len(tokens) else 0
                if not key or key in seen:
                    continue
                seen.add(key)
                rows = np.empty(len(first := _first_by_hash(tokens)), POST)
                rows["t"], rows["k"] = first, key
                held.append(rows)
                size += len(rows)
                if size >= GATHERED:
                    yield from settle(held)
                    held, size, seen = [], 0, set()
        if held:
            yield from settle(held)

    def settle(held):
        # A token that this task has met twice is known to be repeated: its sets are counted here and
        # the bucket only hears of the token, so a common passage fills no bucket.
        rows = np.concatenate(held)
        _, place, count = np.unique(rows["t"], return_inverse=True, return_counts=True)
        twice = count[place] > 1
        keys, n = np.unique(rows["k"][twice], return_counts=True)
        counts = np.empty(len(keys), POST)
        counts["t"], counts["k"] = n, keys
        yield dealt(counts, "k", buckets, kind=1)
        known = np.zeros(int((count > 1).sum()), POST)
        known["t"] = np.unique(rows["t"][twice])
        yield dealt(np.concatenate([rows[~twice], known]), "t", buckets)

    def count(batches):
        held, gathered = [], 0
        for kind, run in bucket_runs(batches, POST):
            if kind:
                yield run
                continue
            run = np.unique(run)
            _, place, times = np.unique(run["t"], return_inverse=True, return_counts=True)
            # A token that is only known by a mark (key 0) and one set is repeated as well.
            keys, n = np.unique(run["k"][(times[place] > 1) & (run["k"] != 0)], return_counts=True)
            counts = np.empty(len(keys), POST)
            counts["t"], counts["k"] = n, keys
            held.append(counts)
            gathered += len(counts)
            if gathered >= GATHERED:
                yield dealt(np.concatenate(held), "k", buckets, kind=1)
                held, gathered = [], 0
        if held:
            yield dealt(np.concatenate(held), "k", buckets, kind=1)

    def add(batches):
        for _, run in bucket_runs((_as_kind(b, 0) for b in batches), POST):
            keys, place = np.unique(run["k"], return_inverse=True)
            n = np.bincount(place, weights=run["t"].astype(np.float64), minlength=len(keys)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], ["key", "n"])

    posts = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(post, BLOBS)
    counts = in_buckets(posts, partitions).mapInArrow(count, BLOBS)
    return in_buckets(counts, partitions).mapInArrow(add, "key long, n long")


def _sets_of(docs: DataFrame, wanted: DataFrame, key: str, text: str) -> DataFrame:
    """key, tokens of the wanted documents; written once, read by the steps that follow."""

    def work(batches):
        for batch in batches:
            sets = [s for t in utf8(batch["text"]) if len(s := shingles(t))]
            yield pa.RecordBatch.from_arrays([
                pa.array([_signed(set_key(s)) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary()),
            ], ["key", "tokens"])

    ids = wanted.select(F.col("doc").alias("wanted_doc"))
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.col(text).cast("string").alias("text"))
    chosen = rows.join(sent_if_small(ids, 8), F.col("doc").eqNullSafe(F.col("wanted_doc")), "left_semi")
    return landed(chosen.select("text").mapInArrow(work, "key long, tokens binary"), "sets")


def _common_tokens(sets: DataFrame, total: int) -> np.ndarray:
    """Tokens of more than 1 / COMMON_ALL of all sets, as far as single tasks show them: fewer than
    COMMON_ALL times the mean size of a set."""

    def work(batches):
        for batch in batches:
            arrays = [np.frombuffer(t.as_buffer(), np.uint64) for t in batch["tokens"]]
            if not arrays:
                continue
            tokens, n = np.unique(np.concatenate(arrays), return_counts=True)
            often = n >= max(8, len(arrays) // COMMON_LOCAL)
            yield pa.RecordBatch.from_arrays([pa.array(tokens[often].view(np.int64)), pa.array(n[often].astype(np.int64))], ["t", "n"])

    found = sets.mapInArrow(work, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).where(F.col("n") > max(1000, total // COMMON_ALL))
    return np.sort(np.array([r.t for r in found.select("t").collect()], np.int64).view(np.uint64))


def _ranked(sets: DataFrame, common: np.ndarray, partitions: int) -> DataFrame:
    """key, size, tokens of the sets that have enough repeated tokens: these, rarest first."""
    buckets = partitions

    def post(batches):
        held, gathered = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            arrays = [np.frombuffer(t.as_buffer(), np.uint64) for t in batch["tokens"]]
            sizes = np.array([len(a) for a in arrays], np.int64)
            keys = batch["key"].to_numpy().view(np.uint64)
            rows = np.empty(int(sizes.sum()), POST)
            rows["t"], rows["k"] = np.concatenate(arrays), np.repeat(keys, sizes)
            often = np.isin(rows["t"], common)
            passed = np.empty(len(keys) + int(often.sum()), RANKED)
            passed["k"] = np.concatenate([keys, rows["k"][often]])
            passed["t"] = np.concatenate([np.full(len(keys), SIZE_MARK), rows["t"][often]])
            passed["df"] = np.concatenate([sizes.astype(np.uint32), np.full(int(often.sum()), COMMON_DF)])
            held.append((passed, rows[~often]))
            gathered += len(rows)
            if gathered >= GATHERED:
                yield from send(held)
                held, gathered = [], 0
        if held:
            yield from send(held)

    def send(held):
        yield dealt(np.concatenate([passed for passed, _ in held]), "k", buckets, kind=1)
        yield dealt(np.concatenate([rows for _, rows in held]), "t", buckets)

    def rank(batches):
        held, gathered = [], 0
        for kind, run in bucket_runs(batches, POST):
            if kind:
                yield run
                continue
            run = np.unique(run)
            _, place, df = np.unique(run["t"], return_inverse=True, return_counts=True)
            more = df[place] > 1
            out = np.empty(int(more.sum()), RANKED)
            out["t"], out["k"], out["df"] = run["t"][more], run["k"][more], df[place][more]
            held.append(out)
            gathered += len(out)
            if gathered >= GATHERED:
                yield dealt(np.concatenate(held), "k", buckets, kind=1)
                held, gathered = [], 0
        if held:
            yield dealt(np.concatenate(held), "k", buckets, kind=1)

    def gather(batches):
        for _, run in bucket_runs((_as_kind(b, 0) for b in batches), RANKED):
            run = np.unique(run[np.lexsort((run["t"], run["df"], run["k"]))])
            run = run[np.lexsort((run["t"], run["df"], run["t"] != SIZE_MARK, run["k"]))]
            cuts = np.concatenate([[0], np.flatnonzero(np.diff(run["k"])) + 1, [len(run)]])
            keys, sizes, tokens = [], [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                size = int(run["df"][a])
                if b - a - 1 >= least_common(size):
                    keys.append(run["k"][a])
                    sizes.append(size)
                    tokens.append(run["t"][a + 1:b].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.array(tokens, pa.binary())], ["key", "size", "tokens"])

    posts = in_buckets(sets.mapInArrow(post, BLOBS), partitions).mapInArrow(rank, BLOBS)
    return landed(in_buckets(posts, partitions).mapInArrow(gather, "key long, size long, tokens binary"), "ranked-sets")


def _as_kind(batch: pa.RecordBatch, kind: int) -> pa.RecordBatch:
    return batch.set_column(0, "kind", pa.array(np.full(batch.num_rows, kind, np.int32)))


def first_tokens(size: int, repeated: int) -> int:
    """How many repeated tokens belong to the prefix when all others come before them."""
    return max(0, size - least_common(size) + 1 - (size - repeated))


def _families(ranked: DataFrame) -> DataFrame:
    """(node, part): sets connected by first tokens, rarest first."""

    def work(batches):
        for batch in batches:
            arrays = [np.frombuffer(t.as_buffer(), np.uint64) for t in batch["tokens"]]
            arrays = [a[:first_tokens(n, len(a))] for a, n in zip(arrays, batch["size"].to_pylist())]
            sizes = [len(a) for a in arrays]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.zeros(0, np.uint64), *arrays]).view(np.int64)), pa.array(np.repeat(batch["key"].to_numpy(), sizes)),
            ], ["t", "key"])

    posts = landed(ranked.mapInArrow(work, "t long, key long"), "first-tokens")
    least = posts.groupBy("t").agg(F.min("key").alias("least"), F.max("key").alias("most")).where("least <> most").drop("most")
    return connected(posts.join(least, "t").select(F.col("key").alias("a"), F.col("least").alias("b")))


class _Index:
    """Owners of tokens, for the chosen tokens of some sets."""

    def __init__(self, tokens: list[np.ndarray], count: int):
        owner = np.repeat(np.arange(len(tokens)), [len(t) for t in tokens])
        flat = np.concatenate([np.zeros(0, np.int64), *tokens])
        order = np.argsort(flat, kind="stable")
        self.owner, self.starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(flat, minlength=count))])

    def owners(self, tokens: np.ndarray) -> np.ndarray:
        start, size = self.starts[tokens], self.starts[tokens + 1] - self.starts[tokens]
        ends = np.cumsum(size)
        return self.owner[np.repeat(start - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]


def links(keys: np.ndarray, sizes: np.ndarray, tokens: list[np.ndarray], copies: np.ndarray, side: np.ndarray | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """Pairs that connect the classes of linked sets, and how many copies of other sets each is linked
    with. With ``side`` only sets of different sides are compared."""
    count = len(keys)
    values, place = np.unique(np.concatenate(tokens), return_inverse=True)
    cuts = np.cumsum([len(t) for t in tokens])[:-1]
    sets = np.split(place, cuts)
    prefix = [first_tokens(int(n), len(t)) for n, t in zip(sizes, sets)]
    orders = [[t[:p] for t, p in zip(sets, prefix)]]  # by rarity, as they come
    for seed in (23, 29):
        rank = mixed(values, seed)
        orders.append([t[np.argsort(rank[t])[:p]] for t, p in zip(sets, prefix)])
    indexes, whole = [_Index(o, len(values)) for o in orders], _Index(sets, len(values))
    roots, found, told = np.arange(count), [], np.zeros(count, np.int64)
    for i in range(count - 1):
        near = 100 * np.minimum(sizes, sizes[i]) >= PERCENT * np.maximum(sizes, sizes[i])
        near[:i + 1] = False
        if side is not None:
            near &= side != side[i]
        for order, index in zip(orders, indexes):
            if not near.any():
                break
            shared = np.zeros(count, bool)
            shared[index.owners(order[i])] = True
            near &= shared
        if not near.any():
            continue
        common = np.bincount(whole.owners(sets[i]), minlength=count)
        linked = np.flatnonzero(near & (100 * common >= PERCENT * (sizes + sizes[i] - common)))
        told[i] += copies[linked].sum()
        told[linked] += copies[i]
        for j in linked[roots[linked] != roots[i]]:
            if roots[j] != roots[i]:
                found.append((int(keys[i]), int(keys[j])))
                roots[roots == roots[j]] = roots[i]
    return found, told


def _linked(ranked: DataFrame, families: DataFrame, copies: DataFrame, partitions: int) -> DataFrame:
    """Rows (a, b, n): pairs that connect exactly the classes of linked sets, and for a = b how many
    documents the set is linked with in one of its groups, copies of its own aside."""

    def work(batches):
        for group in groups(batches, "family", "block"):
            keys = group["key"].to_numpy()
            if len(keys) < 2:
                continue
            tokens = [np.frombuffer(t.as_buffer(), np.uint64) for t in group["tokens"]]
            side = group["later"].to_numpy() if group["crossed"][0].as_py() else None
            edges, told = links(keys, group["size"].to_numpy(), tokens, group["copies"].to_numpy(), side)
            some = told > 0
            a, b = zip(*edges) if edges else ((), ())
            yield pa.RecordBatch.from_arrays([
                pa.array(np.concatenate([np.array(a, np.int64), keys[some]])), pa.array(np.concatenate([np.array(b, np.int64), keys[some]])),
                pa.array(np.concatenate([np.zeros(len(a), np.int64), told[some]])),
            ], ["a", "b", "n"])

    kin = families.withColumnsRenamed({"node": "key", "part": "family"})
    counts = kin.groupBy("family").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks"))
    placed = kin.join(counts, "family").withColumn("own", F.pmod(F.xxhash64("key", F.lit(3)), F.col("blocks")).cast("int"))
    sets = placed.join(ranked, "key").join(copies.select("key", "copies"), "key")
    # Each block meets every other in a group of two and itself in a group of one.
    spread = sets.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    block = F.least("own", "other").cast("long") * F.col("blocks") + F.greatest("own", "other")
    spread = spread.select("family", block.alias("block"), (F.col("own") != F.col("other")).alias("crossed"), (F.col("own") > F.col("other")).alias("later"), "key", "size", "copies", "tokens")
    dealt_rows = spread.repartition(partitions, "family", "block").sortWithinPartitions("family", "block")
    return landed(dealt_rows.mapInArrow(work, "a long, b long, n long"), "links")


def jaccard_classes(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: the key, n_shingles, component_id, the smallest key reachable by links, and n_links, the
    number of other rows it is linked with."""
    partitions = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())
    members = _members(docs, key, text)
    first = members.where("key IS NOT NULL").groupBy("key").agg(F.min("doc").alias("doc"), F.first("size").alias("size"), F.count("*").alias("copies"))
    first = landed(first, "first-documents")
    least = F.ceil(F.lit(PERCENT) * F.col("size") / 100)
    survivors = _repeated_counts(docs, text, partitions).join(first, "key").where(F.col("n") >= F.ceil(least / 10))
    survivors = landed(survivors.select("key", "doc"), "survivors")
    sets = _sets_of(docs, survivors, key, text)
    common = _common_tokens(sets, survivors.count())
    ranked = _ranked(sets, common, partitions)
    linked = _linked(ranked, _families(ranked), first, partitions)
    classes = connected(linked.where("a <> b").select("a", "b"))
    told = linked.where("a = b").groupBy(F.col("a").alias("key")).agg(F.sum("n").alias("n"))
    # Only sets that have copies or links need a lookup; all others are alone.
    named = first.join(classes.withColumnRenamed("node", "key").join(told, "key"), "key", "left").where("copies > 1 OR part IS NOT NULL")
    named = named.withColumn("n_links", F.coalesce("n", F.lit(0)) + F.col("copies") - 1)
    named = named.withColumn("part", F.coalesce("part", "key"))
    smallest = named.groupBy("part").agg(F.min("doc").alias("component"))
    lookup = landed(named.join(smallest, "part").select("key", "component", "n_links"), "components")
    out = members.join(sent_if_small(lookup, 24), "key", "left")
    return out.select(F.col("doc").alias(key), F.col("size").alias("n_shingles"), F.coalesce("component", "doc").alias("component_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
