from __future__ import annotations

from pyspark.sql import functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.registry import query, tidy
from hunkmill.functions import fixed_values as fv
from hunkmill.operators import curves, evaluation
from hunkmill.operators.ordered import exact_quantiles
from hunkmill.operators.pairs import curvature, likelihood_ratio, perturbation_stats

_RATIOS = """round((tp + tn) / (tp + tn + fp + fn), 9) AS accuracy,
       round((tp / (tp + fn) + tn / (tn + fp)) / 2, 9) AS balanced_accuracy,
       round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 9) AS precision,
       round(tp / (tp + fn), 9) AS recall, round(fp / (fp + tn), 9) AS false_positive_rate,
       round(fn / (fn + tp), 9) AS false_negative_rate, tp, tn, fp, fn"""


def _counts(threshold: str) -> str:
    return f"""count(*) FILTER (WHERE prob_ai >= {threshold} AND label = 1) AS tp,
         count(*) FILTER (WHERE prob_ai < {threshold} AND label = 0) AS tn,
         count(*) FILTER (WHERE prob_ai >= {threshold} AND label = 0) AS fp,
         count(*) FILTER (WHERE prob_ai < {threshold} AND label = 1) AS fn"""


_GRID = ", ".join(f"({x!r}::DOUBLE)" for x in fv.THRESHOLD_GRID)
_SCORED = t.HUNKS.replace("l_discount * 10 AS prob_ai", "(l_extendedprice % 1000) / 1000 AS prob_ai")


def _predictions(spark, folder):
    return t.hunks(spark, folder).withColumn("prob_ai", F.col("score"))


@query(
    "confusion_metrics",
    f"""WITH {_SCORED}, counted AS (SELECT {_counts('0.44999999999999996')} FROM hunks)
SELECT round(0.44999999999999996, 9)::DOUBLE AS threshold, {_RATIOS} FROM counted""",
)
def confusion_metrics(spark, folder):
    return tidy(evaluation.confusion_metrics(_predictions(spark, folder), fv.THRESHOLD_GRID[3]))


_SWEEP = f"""{_SCORED}, grid(threshold) AS (VALUES {_GRID}),
swept AS (SELECT threshold, {_counts('threshold')} FROM hunks, grid GROUP BY threshold)"""


@query(
    "threshold_sweep",
    f"WITH {_SWEEP} SELECT round(threshold, 9) AS threshold, {_RATIOS} FROM swept",
)
def threshold_sweep(spark, folder):
    return tidy(evaluation.threshold_sweep(_predictions(spark, folder)))


@query(
    "best_threshold",
    f"""WITH {_SWEEP}
SELECT round(threshold, 9) AS threshold, {_RATIOS} FROM swept
ORDER BY (tp / (tp + fn) + tn / (tn + fp)) / 2 DESC,
         CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END DESC, tp / (tp + fn) DESC, threshold
LIMIT 1""",
)
def best_threshold(spark, folder):
    sweep = evaluation.threshold_sweep(_predictions(spark, folder))
    return tidy(evaluation.best_threshold(sweep))


@query(
    "stratum_metrics",
    f"""WITH {_SCORED}, grouped AS (
  SELECT language, file_category, length_bucket, {_counts('0.44999999999999996')}
  FROM hunks GROUP BY GROUPING SETS ((language), (file_category), (length_bucket),
                                     (language, file_category, length_bucket)))
SELECT tp + tn + fp + fn AS support, language, file_category, length_bucket,
       round(0.44999999999999996, 9)::DOUBLE AS threshold, {_RATIOS}
FROM grouped WHERE tp + tn + fp + fn >= 20 AND tp + fn > 0 AND tn + fp > 0""",
)
def stratum_metrics(spark, folder):
    return tidy(evaluation.stratum_metrics(_predictions(spark, folder), fv.THRESHOLD_GRID[3]))


# A score that knows the label in some strata, so that a few of them are good enough.
def _leaning(spark, folder):
    rows = t.hunks(spark, folder)
    knows = (F.col("file_category") == "source") & (F.col("language") == "Python")
    return rows.withColumn(
        "prob_ai",
        F.when(knows, F.when(F.col("label") == 1, 0.5).otherwise(0.0) + F.col("score") / 2)
        .otherwise(F.col("score")),
    )


_KNOWING = t.HUNKS.replace("SELECT *, CASE WHEN line_count", """SELECT * REPLACE (
         CASE WHEN file_category = 'source' AND language = 'Python'
              THEN (CASE WHEN label = 1 THEN 0.5 ELSE 0.0 END)::DOUBLE + score / 2
              ELSE score END AS prob_ai), CASE WHEN line_count""", 1)
_FROZEN = f"""{_KNOWING}, grouped AS (
  SELECT language, file_category, length_bucket, {_counts('0.44999999999999996')}
  FROM hunks GROUP BY ALL),
good AS (
  SELECT language, file_category, length_bucket FROM grouped
  WHERE tp + tn + fp + fn >= 25 AND tp + fn > 0 AND tn + fp > 0
    AND (tp / (tp + fn) + tn / (tn + fp)) / 2 >= 0.60 AND fp / (fp + tn) <= 0.35)"""


def _frozen(spark, folder):
    rows = _leaning(spark, folder)
    combined = evaluation.stratum_metrics(rows, fv.THRESHOLD_GRID[3], [evaluation.STRATUM])
    return rows, evaluation.frozen_strata(combined, rows)


@query("frozen_strata", f"WITH {_FROZEN} SELECT * FROM good")
def frozen_strata(spark, folder):
    return _frozen(spark, folder)[1]


@query(
    "frozen_config",
    f"""WITH {_FROZEN}
SELECT round(0.44999999999999996, 9)::DOUBLE AS threshold,
       (SELECT string_agg(language || '/' || file_category || '/' || length_bucket, ';'
                          ORDER BY language, file_category, length_bucket) FROM good) AS allowed,
       (SELECT string_agg(DISTINCT language, ',' ORDER BY language) FROM hunks) AS main_languages,
       'source,test' AS main_file_categories,
       'docs,config,lockfile' AS excluded_file_categories,
       'very_short' AS excluded_length_buckets""",
)
def frozen_config(spark, folder):
    rows, strata = _frozen(spark, folder)
    config = evaluation.frozen_config(strata, rows, fv.THRESHOLD_GRID[3])
    combos = F.transform("allowed_combinations", lambda x: F.concat_ws("/", x["language"],
                         x["file_category"], x["length_bucket"]))
    lists = ["main_languages", "main_file_categories", "excluded_file_categories",
             "excluded_length_buckets"]
    return tidy(config.select(
        "threshold", F.array_join(combos, ";").alias("allowed"),
        *[F.array_join(c, ",").alias(c) for c in lists],
    ))


@query(
    "exclusion_table",
    f"""WITH {_FROZEN}
SELECT * FROM (VALUES ('excluded_file_categories', 'docs,config,lockfile'),
                      ('excluded_length_buckets', 'very_short'),
                      ('threshold', '0.44999999999999996')) AS v(type, value)
UNION ALL SELECT 'allowed_combinations', CAST(count(*) AS VARCHAR) FROM good""",
)
def exclusion_table(spark, folder):
    rows, strata = _frozen(spark, folder)
    return evaluation.exclusion_table(
        evaluation.frozen_config(strata, rows, fv.THRESHOLD_GRID[3])
    )


# --- curves -----------------------------------------------------------------------------------
def curve_sql(rows: str, by: str = "") -> str:
    """CTEs to ``curve``: distinct scores from high to low with running and total counts."""
    part = f"PARTITION BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return f"""levels AS (
  SELECT {keys} score, count(*) FILTER (WHERE label = 1) AS pos,
         count(*) FILTER (WHERE label = 0) AS neg FROM {rows} GROUP BY {keys} score),
curve AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS tp,
         sum(neg) OVER ({part} ORDER BY score DESC) AS fp,
         sum(pos) OVER ({part}) AS p, sum(neg) OVER ({part}) AS n,
         lead(pos) OVER ({part} ORDER BY score DESC) AS next_pos,
         lead(neg) OVER ({part} ORDER BY score DESC) AS next_neg,
         lag(score) OVER ({part} ORDER BY score DESC) AS above FROM levels)"""


def areas_sql(rows: str, by: str = "") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""{curve_sql(rows, by)},
steps AS (
  SELECT *, tp / (tp + fp) AS precision,
         CASE WHEN above IS NULL THEN 1.0 ELSE (tp - pos) / (tp - pos + fp - neg) END AS before
  FROM curve)
SELECT {keys} CAST(max(p) AS BIGINT) AS positives, CAST(max(n) AS BIGINT) AS negatives,
       round(sum(neg * (tp - pos / 2)) / (max(p) * max(n)), 9) AS roc_auc,
       round(sum(pos / p * (precision + before) / 2), 9) AS pr_auc,
       round(1 - sum(pos / p * (precision + before) / 2), 9) AS loss
FROM steps {group}"""


def _by_language(spark, folder):
    return t.hunks(spark, folder).select("language", "score", "label")


@query("roc_auc", f"WITH {t.HUNKS}, {areas_sql('hunks')}")
def roc_auc(spark, folder):
    return tidy(curves.areas(_by_language(spark, folder)))


@query("pr_auc", f"WITH {t.HUNKS}, {areas_sql('hunks', 'language')}")
def pr_auc(spark, folder):
    return tidy(curves.areas(_by_language(spark, folder), ["language"]))


@query(
    "roc_points",
    f"""WITH {t.HUNKS}, {curve_sql('hunks')}
SELECT 'start' AS threshold, 0.0::DOUBLE AS fpr, 0.0::DOUBLE AS tpr
UNION ALL
SELECT CAST(CAST(round(score * 100000) AS BIGINT) AS VARCHAR), round(fp / n, 9), round(tp / p, 9)
FROM curve
WHERE above IS NULL OR NOT coalesce(pos = next_pos AND neg = next_neg, false)""",
)
def roc_points(spark, folder):
    points = curves.roc_points(_by_language(spark, folder))
    return tidy(points.withColumn("threshold", _threshold_text()))


def _threshold_text():
    # Whole hundred-thousandths, so that both engines write the same text.
    return F.when(F.col("threshold") == float("inf"), "start").otherwise(
        F.round(F.col("threshold") * 100000).cast("long").cast("string")
    )


@query(
    "pr_points",
    f"""WITH {t.HUNKS}, {curve_sql('hunks')}
SELECT 'start' AS threshold, 1.0::DOUBLE AS precision, 0.0::DOUBLE AS recall
UNION ALL
SELECT CAST(CAST(round(score * 100000) AS BIGINT) AS VARCHAR), round(tp / (tp + fp), 9),
       round(tp / p, 9) FROM curve""",
)
def pr_points(spark, folder):
    points = curves.pr_points(_by_language(spark, folder))
    return tidy(points.withColumn("threshold", _threshold_text()))


# --- histograms -------------------------------------------------------------------------------
def histogram_sql(values: str, bins: str, log: bool) -> str:
    edge = "pow(10.0, {0})" if log else "{0}"
    low, high = (edge.format(f"lo + (bin + {i}) * ((hi - lo) / k)") for i in (0, 1))
    return f"""vals AS ({values}),
span AS (SELECT min(x) AS lo, max(x) AS hi, CAST({bins} AS INTEGER) AS k FROM vals),
placed AS (SELECT least(floor((x - lo) / (hi - lo) * k), k - 1) AS g, x, lo, hi, k
           FROM vals, span),
fixed AS (SELECT CASE WHEN x < lo + g * ((hi - lo) / k) THEN g - 1
                      WHEN x >= lo + (g + 1) * ((hi - lo) / k) AND g < k - 1 THEN g + 1
                      ELSE g END AS bin FROM placed),
counted AS (SELECT CAST(bin AS BIGINT) AS bin, count(*) AS count FROM fixed GROUP BY ALL),
grid AS (SELECT unnest(range(k)) AS bin, lo, hi, k FROM span)
SELECT bin, round({low}, 6) AS low, round({high}, 6) AS high, coalesce(count, 0) AS count
FROM grid LEFT JOIN counted USING (bin)"""


_PRICES = "SELECT log10(o_totalprice) AS x FROM orders WHERE o_totalprice > 0"
_QUANTITIES = "SELECT log10(l_quantity) AS x FROM lineitem WHERE l_quantity > 0"


@query("log_histogram", f"WITH {histogram_sql(_PRICES, '50', True)}")
def log_histogram(spark, folder):
    return tidy(curves.histogram(t.table(spark, folder, "orders"), "o_totalprice", 50, log=True), 6)


@query("log_histogram_files", f"WITH {histogram_sql(_QUANTITIES, '30', True)}")
def log_histogram_files(spark, folder):
    return tidy(curves.histogram(t.table(spark, folder, "lineitem"), "l_quantity", 30, log=True), 6)


@query("score_histogram",
       f"WITH {t.HUNKS}, {histogram_sql('SELECT score AS x FROM hunks', '10', False)}")
def score_histogram(spark, folder):
    return tidy(curves.histogram(t.hunks(spark, folder), "score", 10), 6)


_AUTO = """(SELECT ceil((max(x) - min(x)) / least(
      2 * (quantile_cont(x, 0.75) - quantile_cont(x, 0.25)) / cbrt(count(*)),
      (max(x) - min(x)) / (log2(count(*)) + 1))) FROM vals)"""


@query("automatic_histogram",
       f"WITH {histogram_sql('SELECT value AS x FROM events', _AUTO, False)}")
def automatic_histogram(spark, folder):
    return tidy(curves.automatic_histogram(t.table(spark, folder, "events"), "value"), 6)


@query(
    "score_quantiles",
    """SELECT count(*) AS n, round(min(value), 9) AS low, round(max(value), 9) AS high,
       round(quantile_cont(value, 0.25), 9) AS q25, round(quantile_cont(value, 0.5), 9) AS q50,
       round(quantile_cont(value, 0.75), 9) AS q75 FROM events""",
)
def score_quantiles(spark, folder):
    return tidy(exact_quantiles(
        t.table(spark, folder, "events"), "value", {"q25": 0.25, "q50": 0.5, "q75": 0.75}
    ))


# --- probability metrics ----------------------------------------------------------------------
_PROB = f"""WITH {t.HUNKS}, flagged AS (
  SELECT *, score > 0.5 AS flag FROM hunks),
sums AS (
  SELECT language AS Model, count(*) AS n, count(*) FILTER (WHERE flag AND label = 1) AS tp,
         count(*) FILTER (WHERE NOT flag AND label = 0) AS tn,
         count(*) FILTER (WHERE flag AND label = 0) AS fp,
         count(*) FILTER (WHERE NOT flag AND label = 1) AS fn,
         sum((label - score) * (label - score)) AS sse,
         sum((label - m) * (label - m)) AS sst
  FROM flagged JOIN (SELECT language, avg(label) AS m FROM hunks GROUP BY ALL) USING (language)
  GROUP BY language),
metrics AS (
  SELECT Model, n, round((tp + tn) / n, 9) AS accuracy,
         round(2 * tp / (2 * tp + fp + fn), 9) AS f1, round(tp / (tp + fp), 9) AS precision,
         round(tp / (tp + fn), 9) AS recall, round(sse / n, 9) AS mse,
         round(1 - sse / sst, 9) AS r2 FROM sums)"""


def _prob(spark, folder):
    rows = t.hunks(spark, folder).select(
        F.col("language").alias("Model"), "label", F.col("score").alias("probability")
    )
    return tidy(evaluation.probability_metrics(rows, ["Model"]))


@query("prob_metrics", f"{_PROB} SELECT * FROM metrics")
def prob_metrics(spark, folder):
    return _prob(spark, folder)


@query(
    "results_unpivot",
    f"""{_PROB}
SELECT Model, Metric, Score FROM (
  SELECT Model, accuracy, f1, precision, recall, mse, r2 FROM metrics)
UNPIVOT (Score FOR Metric IN (accuracy, f1, precision, recall, mse, r2))""",
)
def results_unpivot(spark, folder):
    return evaluation.metrics_long(_prob(spark, folder).drop("n"))


@query(
    "scored_pairs_long",
    """SELECT o_orderkey AS pair_id, 0 AS label, round(o_totalprice, 9) AS score FROM orders
UNION ALL SELECT o_orderkey, 1, round(o_totalprice * 2, 9) FROM orders""",
)
def scored_pairs_long(spark, folder):
    pairs = t.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pair_id"), F.col("o_totalprice").alias("real"),
        (F.col("o_totalprice") * 2).alias("sampled"),
    )
    return tidy(curves.labelled_scores(pairs, "real", "sampled", ["pair_id"]))


# --- perturbation statistics: an order is a text, its lines are the perturbed copies ----------
_COPIES = """base AS (
  SELECT o_orderkey AS pair_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS label,
         (o_totalprice % 1000) / 1000 AS ll FROM orders),
copies AS (
  SELECT l_orderkey AS pair_id, l_discount AS ll,
         row_number() OVER (PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS copy_id
  FROM lineitem),
stats AS (
  SELECT pair_id, n AS n_perturbations, avg(ll) AS mean,
         CASE WHEN count(*) <= 1 OR stddev_pop(ll) < 1e-9 THEN 1 ELSE stddev_pop(ll) END AS sd
  FROM copies, (VALUES (1), (3), (10)) AS c(n) WHERE copy_id <= n GROUP BY pair_id, n)"""


def _perturbed(spark, folder):
    from pyspark.sql import Window

    order = Window.partitionBy("pair_id").orderBy(
        "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"
    )
    copies = t.table(spark, folder, "lineitem").withColumnRenamed("l_orderkey", "pair_id").select(
        "pair_id", F.col("l_discount").alias("ll"), F.row_number().over(order).alias("copy_id")
    )
    base = t.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("pair_id"),
        (F.col("o_orderstatus") == "F").cast("int").alias("label"),
        (F.col("o_totalprice") % 1000 / 1000).alias("ll"),
    )
    return base, perturbation_stats(copies, [1, 3, 10], ["pair_id"])


@query(
    "perturbation_stats",
    f"""WITH {_COPIES}
SELECT pair_id, n_perturbations, round(mean, 7) AS perturbed_ll, round(sd, 7) AS perturbed_ll_std
FROM stats""",
)
def perturbation_statistics(spark, folder):
    return tidy(_perturbed(spark, folder)[1], 7)


_CURVATURE = f"""{_COPIES}, criteria AS (
  SELECT pair_id, n_perturbations, label, round(ll - mean, 7) AS d,
         round((ll - mean) / sd, 7) AS z FROM base JOIN stats USING (pair_id)),
curvature AS (
  SELECT pair_id, n_perturbations, label, 'd' AS criterion, d AS score FROM criteria
  UNION ALL SELECT pair_id, n_perturbations, label, 'z', z FROM criteria)"""


@query("curvature_d", f"WITH {_CURVATURE} SELECT * FROM curvature WHERE criterion = 'd'")
def curvature_d(spark, folder):
    return tidy(curvature(*_perturbed(spark, folder), ["pair_id"]), 7).where(
        F.col("criterion") == "d"
    )


@query("curvature_z", f"WITH {_CURVATURE} SELECT * FROM curvature WHERE criterion = 'z'")
def curvature_z(spark, folder):
    return tidy(curvature(*_perturbed(spark, folder), ["pair_id"]), 7).where(
        F.col("criterion") == "z"
    )


@query(
    "curvature_areas",
    f"""WITH {_CURVATURE}, named AS (
  SELECT 'perturbation_' || n_perturbations || '_' || criterion AS name, score, label
  FROM curvature),
{areas_sql('named', 'name')}""",
)
def curvature_areas(spark, folder):
    rows = tidy(curvature(*_perturbed(spark, folder), ["pair_id"]), 7)
    name = F.concat_ws("_", F.lit("perturbation"), "n_perturbations", "criterion")
    return tidy(curves.areas(rows.withColumn("name", name), ["name"]))


@query(
    "llr",
    f"""WITH {_COPIES}
SELECT pair_id, n_perturbations, round(ll - mean, 7) AS llr FROM base JOIN stats USING (pair_id)""",
)
def llr(spark, folder):
    return tidy(likelihood_ratio(*_perturbed(spark, folder), ["pair_id"]), 7)
