import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from hunkmill.functions import exact, fixed_values as fv
from hunkmill.functions.scoring import bands, length_bucket, year_scaled
from hunkmill.operators import curves, evaluation, ordered, pairs, rollups

# Confusion counts and the ratios published for them: threshold, tp, tn, fp, fn, accuracy,
# balanced accuracy, precision, recall.
PUBLISHED = [
    (0.44999999999999996, 522, 192, 49, 74, 0.8530465949820788, 0.8362597120499039,
     0.9141856392294221, 0.8758389261744967),
    (0.5499999999999999, 486, 206, 35, 110, 0.8267622461170848, 0.8351040129215517,
     0.9328214971209213, 0.8154362416107382),
    (0.49999999999999994, 508, 197, 44, 88, 0.8422939068100358, 0.8348881895903534,
     0.9202898550724637, 0.8523489932885906),
    (0.3, 557, 166, 75, 39, 0.8637992831541219, 0.8116802194435935, 0.8813291139240507,
     0.9345637583892618),
]


def test_published_ratios(spark):
    rows = spark.createDataFrame([p[:5] for p in PUBLISHED],
                                 "threshold double, tp long, tn long, fp long, fn long")
    got = evaluation.add_metrics(rows)
    for row, want in zip(got.orderBy(F.col("balanced_accuracy").desc()).collect(), PUBLISHED):
        assert (row.accuracy, row.balanced_accuracy, row.precision, row.recall) == pytest.approx(
            want[5:], abs=1e-12)
    assert evaluation.best_threshold(got).first()["threshold"] == 0.44999999999999996


def test_published_frozen_strata(spark):
    """Support, balanced accuracy and false positive rate of 18 published strata; 10 pass."""
    strata = [
        (25, "Java", "config", "long", .5, 1.), (34, "Java", "config", "very_short", .8901, .0769),
        (34, "Java", "docs", "long", 1., 0.), (36, "Java", "docs", "short", .91875, .1),
        (35, "Java", "docs", "very_short", .9524, 0.), (48, "Java", "source", "short", .8348, .1304),
        (32, "Java", "source", "very_short", .875, .0625),
        (36, "Java", "test", "very_short", .9231, 0.), (22, "Python", "config", "long", .6667, .6667),
        (35, "Python", "config", "very_short", .8007, .2222),
        (22, "Python", "source", "long", .7807, .3333),
        (26, "Python", "source", "medium", .65625, .5),
        (37, "Python", "source", "short", .4532, .7778),
        (45, "Python", "source", "very_short", .71, .08), (24, "Python", "test", "long", 1., 0.),
        (21, "Python", "test", "medium", .4737, 1.), (27, "Python", "test", "short", .5598, .75),
        (34, "Python", "test", "very_short", .6765, .2353),
    ]
    combined = spark.createDataFrame(
        strata, "support int, language string, file_category string, length_bucket string, "
                "balanced_accuracy double, false_positive_rate double")
    got = evaluation.frozen_strata(combined, combined)
    assert got.count() == 10 and got.where("length_bucket = 'medium'").count() == 0
    none = evaluation.frozen_strata(combined.where("support < 25"), combined)
    assert {tuple(r) for r in none.collect()} == {
        (a, b, c) for a in ("Java", "Python") for b in ("source", "test")
        for c in ("long", "medium", "short")}
    config = evaluation.frozen_config(got, combined, 0.45)
    table = {r.type: r.value for r in evaluation.exclusion_table(config).collect()}
    assert table["allowed_combinations"] == "10" and table["threshold"] == "0.45"


def test_published_years_and_periods(spark):
    """Yearly commits and flagged commits as published, and the two periods made of them."""
    years = [(2021, 2160, 846), (2022, 2159, 935), (2023, 2156, 973), (2024, 2159, 864),
             (2025, 2159, 899), (2019, 5, 5)]
    pooled = spark.createDataFrame(
        [(f"{y}-{m:02d}", n if m == 1 else 0, a if m == 1 else 0, 0.5, "medium")
         for y, n, a in years for m in (1, 2)],
        "calendar_month string, commits long, ai_like_commits long, mean_ai_line_fraction double, "
        "threshold_label string")
    yearly = rollups.yearly_weighted(pooled)
    shares = [r.weighted_commit_ai_fraction for r in yearly.orderBy("year").collect()]
    assert shares == pytest.approx([0.39166666666666666, 0.4330708661417323, 0.4512987012987013,
                                    0.4001852709587772, 0.41639647985178324])
    periods = {r.period: r for r in rollups.period_weighted(yearly).collect()}
    pre, post = periods[fv.PRE_PERIOD], periods[fv.POST_PERIOD]
    assert (pre.years, pre.commits, pre.ai_like_commits) == ("2021,2022", 4319, 1781)
    assert (post.years, post.commits, post.ai_like_commits) == ("2023,2024,2025", 6474, 2736)
    assert post.weighted_commit_ai_fraction == pytest.approx(0.422613531047266)


def scored(n, distinct, seed):
    rng = random.Random(seed)
    # A third of the rows share one score, others crowd near 1.
    return [(rng.randrange(2), rng.choice([0.5, 1 - rng.randrange(distinct) * 1e-12,
                                           rng.randrange(distinct) / distinct])) for _ in range(n)]


def roc_by_pairs(rows):
    pos = [s for y, s in rows if y == 1]
    neg = [s for y, s in rows if y == 0]
    wins = sum((p > q) + (p == q) / 2 for p in pos for q in neg)
    return wins / len(pos) / len(neg)


def pr_by_thresholds(rows):
    pos = sum(y for y, _ in rows)
    points = [(0.0, 1.0)]
    for t in sorted({s for _, s in rows}, reverse=True):
        taken = [y for y, s in rows if s >= t]
        points.append((sum(taken) / pos, sum(taken) / len(taken)))
    return points, sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(points, points[1:]))


@pytest.mark.parametrize("distinct", [1, 7, 400])
def test_areas_and_points(spark, distinct):
    rows = scored(500, distinct, distinct)
    frame = spark.createDataFrame(rows, "label int, score double")
    got = curves.areas(frame).first()
    points, pr = pr_by_thresholds(rows)
    assert got.roc_auc == pytest.approx(roc_by_pairs(rows), abs=1e-12)
    assert got.pr_auc == pytest.approx(pr, abs=1e-12) and got.loss == pytest.approx(1 - pr)
    drawn = curves.pr_points(frame).orderBy(F.col("threshold").desc()).collect()
    assert [(r.recall, r.precision) for r in drawn] == [pytest.approx(p) for p in points]
    every = curves.roc_points(frame, corners_only=False).orderBy(F.col("threshold").desc()).collect()
    corners = curves.roc_points(frame).orderBy(F.col("threshold").desc()).collect()
    area = lambda ps: sum((b.fpr - a.fpr) * (a.tpr + b.tpr) / 2 for a, b in zip(ps, ps[1:]))
    assert area(every) == pytest.approx(got.roc_auc) and area(corners) == pytest.approx(got.roc_auc)
    assert len(corners) <= len(every) and (every[-1].fpr, every[-1].tpr) == (1.0, 1.0)


def test_one_class_has_no_area(spark):
    frame = spark.createDataFrame([(1, 0.2), (1, 0.4)], "label int, score double")
    assert curves.areas(frame).first().roc_auc is None


def test_running_totals_by_group(spark):
    rows = [(i % 3, (i * 37 % 101) / 7.0) for i in range(400)]
    frame = spark.createDataFrame(rows, "g int, x double")
    got = ordered.running_totals(frame, "x", {"n": F.count(F.lit(1))}, ["g"], descending=False)
    for r in got.collect():
        assert r.run_n == sum(g == r.g and x <= r.x for g, x in rows)
        assert r.all_n == sum(g == r.g for g, _ in rows)


def test_quantiles_and_histogram(spark):
    values = [float(v) for v in [1, 1, 2, 3, 5, 8, 13, 21, 34]]
    frame = spark.createDataFrame([(v,) for v in values], "x double")
    row = ordered.exact_quantiles(frame, "x", {"q25": 0.25, "q50": 0.5, "q90": 0.9}).first()
    assert (row.q25, row.q50) == (2.0, 5.0) and row.q90 == pytest.approx(23.6)
    bins = curves.histogram(frame, "x", 3).orderBy("bin").collect()
    assert [b["count"] for b in bins] == [6, 2, 1] and bins[-1].high == 34.0
    one = curves.histogram(frame.where("x = 8"), "x", 2).orderBy("bin").collect()
    assert [(b.low, b["count"]) for b in one] == [(7.5, 0), (8.0, 1)]
    log = curves.histogram(frame, "x", 2, log=True).orderBy("bin").collect()
    assert [b["count"] for b in log] == [5, 4] and log[0].low == 1.0
    assert curves.histogram(frame.where("x < 0"), "x", 4).count() == 0


def test_buckets_bands_and_years(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 4, 5, 14, 15, 39, 40, 20000)], "n int")
    assert [r[0] for r in rows.select(length_bucket(F.col("n"))).collect()] == [
        "very_short", "very_short", "short", "short", "medium", "medium", "long", "long"]
    assert bands(0.05)["low"] == 0.0 and bands(0.95)["high"] == 0.99
    years = spark.createDataFrame([(2019, .9), (2021, .9), (2022, .9), (2024, .9)],
                                  "y int, p double")
    got = [r[0] for r in years.select(year_scaled(F.col("p"), F.col("y"))).collect()]
    assert got == pytest.approx([0.09, 0.36, 0.765, 1.0])


def test_probability_metrics(spark):
    rows = [(1, 0.9), (1, 0.4), (0, 0.2), (0, 0.6)]
    got = evaluation.probability_metrics(
        spark.createDataFrame(rows, "label int, probability double")).first()
    sse = sum((y - p) ** 2 for y, p in rows)
    assert (got.accuracy, got.f1, got.precision, got.recall) == (0.5, 0.5, 0.5, 0.5)
    assert got.mse == pytest.approx(sse / 4) and got.r2 == pytest.approx(1 - sse / 1.0)
    single = spark.createDataFrame([(1, 0.9)], "label int, probability double")
    assert evaluation.probability_metrics(single).first().r2 is None


def test_perturbation_statistics(spark):
    copies = spark.createDataFrame(
        [(1, 1, -2.0), (1, 2, -4.0), (1, 3, -9.0), (2, 1, -1.0), (2, 2, -1.0)],
        "pair_id int, copy_id int, ll double")
    base = spark.createDataFrame([(1, 0, -1.0), (2, 1, -1.5)], "pair_id int, label int, ll double")
    stats = pairs.perturbation_stats(copies, [1, 2], ["pair_id"])
    got = {(r.pair_id, r.n_perturbations, r.criterion): r.score
           for r in pairs.curvature(base, stats, ["pair_id"]).collect()}
    assert got[1, 1, "d"] == 1.0 and got[1, 1, "z"] == 1.0
    assert got[1, 2, "d"] == 2.0 and got[1, 2, "z"] == pytest.approx(2.0 / 1.0)
    assert got[2, 2, "z"] == -0.5


def test_commits_without_hunks_count(spark):
    commits = spark.createDataFrame(
        [("r", "a", "2024-01"), ("r", "b", "2024-01"), ("q", "a", "2024-01")],
        "repo string, commit_hash string, calendar_month string")
    hunks = spark.createDataFrame([("r", "a", 10, 0.5), ("r", "a", 30, 0.1), ("q", "a", 5, 0.2)],
                                  "repo string, commit_hash string, line_count int, prob_ai double")
    analysis = rollups.commit_analysis(commits, hunks, 0.45)
    monthly = {(r.repo, r.threshold_label): r for r in rollups.monthly_summary(analysis).collect()}
    medium = monthly["r", "medium"]
    assert (medium.commits, medium.commits_with_allowed_hunks, medium.ai_like_commits) == (2, 1, 1)
    assert medium.mean_ai_line_fraction == 0.125 and medium.mean_max_hunk_score == 0.25
    assert monthly["r", "high"].ai_like_commits == 0 and monthly["q", "low"].ai_like_commits == 0
    pooled = {r.threshold_label: r for r in rollups.pooled_monthly(analysis).collect()}
    assert pooled["medium"].commits == 3
    assert pooled["medium"].commit_ai_fraction == pytest.approx(1 / 3)
    assert not math.isnan(pooled["low"].mean_max_hunk_score)


def test_means_and_spreads_do_not_depend_on_the_order(spark):
    dice = random.Random(4)
    values = [dice.uniform(-9, 0) for _ in range(999)]
    orders = [values, sorted(values), sorted(values, reverse=True)]
    rows = [(g, x) for g, own in enumerate(orders) for x in own] + [(9, None), (8, 0.1), (8, 0.1)]
    frame = spark.createDataFrame(rows, "g int, x double")
    found = {r.g: r for r in frame.groupBy("g").agg(exact.mean(F.col("x")).alias("m"), exact.spread(F.col("x")).alias("s")).collect()}
    assert found[0][1:] == found[1][1:] == found[2][1:]
    assert found[0].m == pytest.approx(sum(values) / 999, abs=1e-9)
    assert found[0].s == pytest.approx(statistics.pstdev(values), abs=1e-9)
    assert found[9].m is None and found[8].s == 0.0
