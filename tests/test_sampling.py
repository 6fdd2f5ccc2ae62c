import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from hunkmill.functions import draws
from hunkmill.operators import joins, sampling


def digest(seed, *key):
    return hashlib.md5("|".join(map(str, [seed, *key])).encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows share one group."""
    rows = [(i, "hot" if i % 3 == 0 else f"g{i % 40}") for i in range(6000)]
    return rows, spark.createDataFrame(rows, "id long, g string").repartition(7)


def expected(rows, cap, seed=42):
    groups = defaultdict(list)
    for i, g in rows:
        groups[g].append(i)
    return {(i, g) for g, ids in groups.items()
            for i in sorted(ids, key=lambda i: digest(seed, i))[:cap]}


@pytest.mark.parametrize("cap", [0, 1, 50, 1500, 10000])
def test_capped_sample(skewed, cap):
    rows, frame = skewed
    got = sampling.capped_sample(frame, ["g"], cap, ["id"]).collect()
    assert {tuple(r) for r in got} == expected(rows, cap) and len(got) == len(set(got))


def test_null_strata_are_left_out(spark):
    frame = spark.createDataFrame([(1, None), (2, "a")], "id long, g string")
    assert [r.id for r in sampling.capped_sample(frame, ["g"], 5, ["id"]).collect()] == [2]


@pytest.mark.parametrize("n", [0, 1, 2999, 6000, 9000])
def test_smallest_n(skewed, n):
    rows, frame = skewed
    want = set(sorted((i for i, _ in rows), key=lambda i: digest(1, i))[:n])
    got = [r.id for r in sampling.smallest_n(frame, n, ["id"], 1).collect()]
    assert set(got) == want and len(got) == len(want)


def test_sample_does_not_depend_on_partitions(skewed):
    _, frame = skewed
    one = {r.id for r in sampling.smallest_n(frame.coalesce(1), 100, ["id"]).collect()}
    many = {r.id for r in sampling.smallest_n(frame.repartition(13), 100, ["id"]).collect()}
    assert one == many


def test_exact_split(skewed):
    rows, frame = skewed
    split = sampling.split_exact(frame, ["id"], 0.2, by=["g"])
    counts = split.groupBy("g").agg(F.sum("is_test").alias("t"), F.count("*").alias("n")).collect()
    assert sum(c.n for c in counts) == len(rows)
    assert all(c.t == -(-c.n // 5) for c in counts)


def test_balance_needs_enough(spark):
    few = spark.range(3).withColumnRenamed("id", "key")
    many = spark.range(10).withColumnRenamed("id", "key")
    assert sampling.balance_classes(few, many, ["key"]).count() == 13
    balanced = sampling.balance_classes(many, few, ["key"], require_enough=True)
    assert sorted(r[0] for r in balanced.groupBy("label").count().select("count").collect()) == [3, 3]
    with pytest.raises(Exception, match="fewer human"):
        sampling.balance_classes(few, many, ["key"], require_enough=True).collect()


def test_published_caps(spark):
    """Stratum sizes of the published calibration set and what the caps make of them."""
    full = [2, 1, 1, 153, 57, 23, 86, 418, 2, 24, 859, 7165, 13, 3, 1, 1338, 17, 5, 9, 89, 1, 1, 2,
            21, 27, 41, 98, 1062, 16, 4, 16, 246, 193, 390, 2008, 10970, 131, 203, 609, 6836, 1312,
            4005, 6457, 40296, 540, 504, 905, 5218, 537, 739, 1280, 13779, 1228, 1100, 2586, 21147,
            3622, 4938, 13640, 85429, 1614, 1526, 2565, 17229]
    assert sum(full) == 265337
    sizes = spark.createDataFrame(list(enumerate(full)), "g int, n int")
    rows = sizes.select("g", F.explode(F.sequence(F.lit(1), "n")).alias("id"))
    sampled = sampling.capped_sample(rows, ["g"], 400, ["g", "id"])
    assert sampled.count() == 15076
    # 6000 rows over 64 strata: 93 of each, 4182 in all, of which 837 are test rows.
    from hunkmill.session import landed

    kept = landed(sampled, "sampled")
    capped = sampling.capped_stratified(kept, ["g", "id"], 6000, strata=["g"])
    assert capped.count() == 4182


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("limit", [0, 10, 1 << 20])
def test_spread_join(spark, how, limit):
    facts = spark.range(3000).select(
        "id", F.when(F.col("id") % 3 == 0, 1).when(F.col("id") % 7 != 0, F.col("id") % 50)
        .alias("k"))
    dimension = spark.range(30).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    got = joins.spread_join(facts, dimension, ["k"], how, ["id"], broadcast_bytes=limit)
    want = facts.join(dimension, "k", how)
    assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))


def test_plan_limits_groups_before_the_shuffle(skewed):
    _, frame = skewed
    plan = sampling.capped_sample(frame, ["g"], 50, ["id"])._jdf.queryExecution().toString()
    assert plan.count("WindowGroupLimit") >= 4 and "CartesianProduct" not in plan


@pytest.mark.parametrize("cap", [1, 3, 999, 1000, 1001, 1500])
def test_caps_are_exact_with_repeated_and_null_keys(spark, cap):
    rows = spark.range(4000).select(
        (F.col("id") % 2).alias("g"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("k"), (F.col("id") % 5).alias("v"))
    counts = {r.g: r["count"] for r in sampling.capped_sample(rows, ["g"], cap, ["k"]).groupBy("g").count().collect()}
    assert counts == {0: cap, 1: cap}
    assert sampling.smallest_n(rows, cap, ["k"]).count() == cap
    grouped = sampling.smallest_n(rows, cap, ["k"], by=["g"]).groupBy("g").count().collect()
    assert {r["count"] for r in grouped} == {cap}
    assert sampling.shuffle_head(rows, cap, ["k"]).count() == cap


def test_splits_are_exact_with_repeated_keys(spark):
    rows = spark.range(1000).select((F.col("id") % 2).alias("label"), (F.col("id") % 3).alias("k"))
    split = sampling.split_exact(rows, ["k"], 0.25)
    assert {(r.label, r["count"]) for r in split.where("is_test = 1").groupBy("label").count().collect()} == {(0, 125), (1, 125)}
    assert split.count() == 1000


def test_different_keys_have_different_digests(spark):
    rows = spark.createDataFrame([("a", None, "b"), ("a", "b", None), ("a|b", None, None), ("a\\pb", None, None), ("\\n", "", None), (None, "", "\\n")], "a string, b string, c string")
    digests = rows.select(draws.order_key(1, F.col("a"), F.col("b"), F.col("c")).alias("d")).distinct()
    assert digests.count() == 6


@pytest.mark.parametrize("parts", [4, 16])
def test_a_hot_key_is_dealt_over_many_tasks(spark, parts):
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        facts = spark.range(20000).select("id", F.when(F.col("id") % 10 < 6, 7).otherwise(F.col("id")).alias("k"))
        hot = joins.hot_keys(facts.groupBy("k").agg(F.count(F.lit(1)).alias("_rows")), ["k"]).collect()
        assert [(r.k, r._salts) for r in hot] == [(7, -(-6 * parts // 10))]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_the_rows_are_scanned_once_for_the_cut_and_once_for_the_result(spark, tmp_path):
    spark.range(5000).select("id", (F.col("id") % 2).alias("label")).write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows"))
    split = sampling.split_exact(rows, ["id"])
    plan = split._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Relation") == 2 and "Union" not in plan and "Window" not in plan  # rows and cut-offs
    assert {(r.label, r.n) for r in split.groupBy("label").agg(F.sum("is_test").alias("n")).collect()} == {(0, 500), (1, 500)}


def test_a_key_that_most_rows_share_is_cut_exactly(spark):
    rows = spark.range(3000).select(F.when(F.col("id") < 2000, -1).otherwise(F.col("id")).alias("k"), "id")
    for n in (1, 500, 1000, 2500, 2999, 3000):
        got = sampling.smallest_n(rows, n, ["k"]).collect()
        assert len(got) == len({r.id for r in got}) == n
