from __future__ import annotations

import hashlib

import numpy as np
from pyspark.ml.feature import Binarizer
from pyspark.sql import functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.metric_queries import areas_sql, histogram_sql
from hunkmill.catalog.registry import query, tidy
from hunkmill.catalog.rollup_queries import ANALYSIS, THRESHOLD, WITH_HUNKS, summary_sql
from hunkmill.operators import curves, joins, linear, models, sampling
from hunkmill.operators.evaluation import STRATUM
from hunkmill.operators.terms import top_terms
from hunkmill.plans import calibration, messages, trends
from hunkmill.session import landed, new_shared_path


def _vectors(spark, folder):
    """Embeddings with a class, and strata by vector number."""
    key = F.col("vec_id")
    return t.table(spark, folder, "embeddings").select(
        "vec_id", "embedding", (F.col("label") < 5).cast("int").alias("label"),
        F.when(key % 2 == 0, "Python").otherwise("Java").alias("language"),
        F.when(key % 3 == 0, "test").otherwise("source").alias("file_category"),
        F.when(key % 5 == 0, "very_short").otherwise("short").alias("length_bucket"),
    )


def _fitted(spark, folder):
    split = sampling.split_exact(_vectors(spark, folder), ["vec_id"])
    model = models.fit_embedding_detector(split.where("is_test = 0"))
    return model, split


@query(
    "balanced_weights",
    """WITH v AS (SELECT vec_id, CAST(label < 5 AS BIGINT) AS label FROM embeddings)
SELECT vec_id, label, round((SELECT count(*) FROM v) / (2 * count(*) OVER (PARTITION BY label)), 9)
  AS weight FROM v""",
)
def balanced_weights(spark, folder):
    rows = models.balanced_weights(_vectors(spark, folder))
    return tidy(rows.select("vec_id", "label", "weight"))


@query(
    "embedding_logreg_optimum",
    "SELECT unnest(range(65)) AS coefficient, 0.0::DOUBLE AS gradient",
)
def embedding_logreg_optimum(spark, folder):
    """The gradient of the loss at the fitted detector, summed anew by SQL: none is left."""
    split = landed(sampling.split_exact(_vectors(spark, folder), ["vec_id"]), "split")
    train = split.where("is_test = 0")
    return tidy(models.loss_gradient(train, models.fit_embedding_detector(train)), 5)


# Newton's method in SQL for three coefficients, solved by Cramer's rule.
_NEWTON = """train AS MATERIALIZED (
  SELECT label AS y, CAST(embedding[1] AS DOUBLE) AS x1, CAST(embedding[2] AS DOUBLE) AS x2,
         n / (2 * count(*) OVER (PARTITION BY label)) AS w
  FROM (SELECT *, count(*) OVER () AS n FROM split WHERE is_test = 0)),
newton AS (
  SELECT 0 AS i, 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2, 0.0::DOUBLE AS b0
  UNION ALL
  SELECT i + 1,
    b1 - (g1 * (h22 * h00 - h20 * h20) - h12 * (g2 * h00 - h20 * g0) + h10 * (g2 * h20 - h22 * g0)) / det,
    b2 - (h11 * (g2 * h00 - g0 * h20) - g1 * (h12 * h00 - h20 * h10) + h10 * (h12 * g0 - g2 * h10)) / det,
    b0 - (h11 * (h22 * g0 - g2 * h20) - h12 * (h12 * g0 - g2 * h10) + g1 * (h12 * h20 - h22 * h10)) / det
  FROM (
    SELECT *, h11 * (h22 * h00 - h20 * h20) - h12 * (h12 * h00 - h20 * h10) + h10 * (h12 * h20 - h22 * h10) AS det
    FROM (
      SELECT i, any_value(b1) AS b1, any_value(b2) AS b2, any_value(b0) AS b0,
             sum(w * (p - y) * x1) + any_value(b1) AS g1, sum(w * (p - y) * x2) + any_value(b2) AS g2,
             sum(w * (p - y)) AS g0, sum(w * p * (1 - p) * x1 * x1) + 1 AS h11,
             sum(w * p * (1 - p) * x1 * x2) AS h12, sum(w * p * (1 - p) * x2 * x2) + 1 AS h22,
             sum(w * p * (1 - p) * x1) AS h10, sum(w * p * (1 - p) * x2) AS h20, sum(w * p * (1 - p)) AS h00
      FROM (SELECT *, 1 / (1 + exp(-(b1 * x1 + b2 * x2 + b0))) AS p FROM newton, train WHERE i < 25) GROUP BY i)))"""


@query(
    "embedding_logreg_plane",
    f"""WITH RECURSIVE vectors AS (
  SELECT vec_id, embedding, CAST(label < 5 AS BIGINT) AS label FROM embeddings),
split AS MATERIALIZED (
  SELECT *, CAST(row_number() OVER (PARTITION BY label ORDER BY md5(concat_ws('|', '42', vec_id)))
                 <= ceil(count(*) OVER (PARTITION BY label) * 0.2::DOUBLE) AS BIGINT) AS is_test
  FROM vectors),
{_NEWTON}
SELECT vec_id, label,
       round(1 / (1 + exp(-(b1 * CAST(embedding[1] AS DOUBLE) + b2 * CAST(embedding[2] AS DOUBLE) + b0))), 7) AS prob_ai
FROM split, newton WHERE is_test = 1 AND i = 25""",
)
def embedding_logreg_plane(spark, folder):
    """Held-out probabilities of the detector fitted on the first two numbers of the vectors; the SQL
    makes the same fit."""
    vectors = _vectors(spark, folder).withColumn("embedding", F.slice("embedding", 1, 2))
    split = landed(sampling.split_exact(vectors, ["vec_id"]), "split")
    model = models.fit_embedding_detector(split.where("is_test = 0"))
    test = models.embedding_features(split.where("is_test = 1"))
    return tidy(models.score(model, test).select("vec_id", "label", "prob_ai"), 7)


@query("embedding_logreg")
def embedding_logreg(spark, folder):
    """Probabilities of the held-out vectors."""
    model, split = _fitted(spark, folder)
    test = models.embedding_features(split.where("is_test = 1"))
    return tidy(models.score(model, test).select("vec_id", "label", "prob_ai"), 4)


# A given detector of vectors, in numbers.
GIVEN = [((i * 37) % 11 - 5) / 10 for i in range(64)]
_GIVEN_SCORE = f"1 / (1 + exp(-list_dot_product(CAST(embedding AS DOUBLE[]), {GIVEN})))"


def _given_scores(spark, folder):
    def predict(batch):
        import numpy as np
        import pandas as pd

        return pd.Series(1.0 / (1.0 + np.exp(-(np.stack(batch.to_numpy()) @ np.array(GIVEN)))))

    return models.score_with(_vectors(spark, folder), predict, column="embedding")


@query(
    "score_hunks",
    f"""SELECT vec_id, CAST(label < 5 AS BIGINT) AS label, round({_GIVEN_SCORE}, 9) AS prob_ai
FROM embeddings""",
)
def score_hunks(spark, folder):
    """All vectors scored by a given detector that is called on Arrow batches."""
    return tidy(_given_scores(spark, folder).select("vec_id", "label", "prob_ai"))


@query(
    "detector_store",
    """SELECT vec_id, CAST(label < 5 AS BIGINT) AS label, 0.0::DOUBLE AS difference,
       0.55::DOUBLE AS threshold, CAST(vec_id % 2 = 0 AND vec_id % 3 <> 0 AS BIGINT) AS allowed
FROM embeddings""",
)
def detector_store(spark, folder):
    """What storing and loading a fitted detector changes in its scores: nothing. Its threshold and
    strata come back with it."""
    model, split = _fitted(spark, folder)
    rows = models.embedding_features(split)
    wanted = rows.where("language = 'Python' AND file_category = 'source'").select(*STRATUM).distinct()
    path = new_shared_path(spark, "detector")
    models.save(models.Detector(model, 0.55, wanted), path)
    stored = models.load(spark, path)
    both = models.score(stored.model, models.score(model, rows, "first"), "second")
    allowed = joins.allowed_hunks(both, stored.strata).select("vec_id", F.lit(1).alias("allowed"))
    return tidy(both.join(allowed, "vec_id", "left").select(
        "vec_id", "label", F.abs(F.col("first") - F.col("second")).alias("difference"),
        F.lit(stored.threshold).alias("threshold"), F.coalesce("allowed", F.lit(0)).alias("allowed"),
    ))


def _calibrated(spark, folder):
    return calibration.calibrate(_vectors(spark, folder), ["vec_id"], max_rows=None)


@query("calibration_overall")
def calibration_overall(spark, folder):
    return tidy(_calibrated(spark, folder).overall, 6)


@query("calibration_strata")
def calibration_strata(spark, folder):
    return tidy(_calibrated(spark, folder).strata, 6)


_HUNK_SCORE = "1 / (1 + exp(-(line_count / 20.0::DOUBLE - file_index / 3.0::DOUBLE + score - 1)))"
_SCORED_ANALYSIS = ANALYSIS.replace(
    "SELECT * FROM hunks\n  WHERE", f"SELECT * REPLACE ({_HUNK_SCORE} AS prob_ai) FROM hunks\n  WHERE"
)


@query(
    "scored_trend",
    f"WITH {_SCORED_ANALYSIS} {summary_sql('repo, calendar_month', WITH_HUNKS)} GROUP BY ALL",
)
def scored_trend(spark, folder):
    """The whole trend job: all commits, their hunks scored by a given detector, months."""

    def score(rows):
        margin = F.col("line_count") / 20.0 - F.col("file_index") / 3.0 + F.col("score") - 1
        return rows.withColumn("prob_ai", 1 / (1 + F.exp(-margin)))

    found = trends.analyse(
        t.commits(spark, folder), t.hunks(spark, folder), score, THRESHOLD, ["Java", "Python"],
        keys=["commit_hash"],
    )
    return tidy(found.monthly)


@query("tfidf_models")
def tfidf_models(spark, folder):
    """The four text classifiers on user and assistant turns."""
    turns = t.table(spark, folder, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("key"), "role", "text"
    )
    human = turns.where(F.col("role") == "user")
    machine = turns.where(F.col("role") == "assistant")
    texts = messages.training_texts(human, machine, one_line=True, max_characters=None)
    return tidy(messages.compare_detectors(texts), 4)


# --- words, naive Bayes, and a sigmoid, each as SQL ---------------------------------------------
_RUNS = "regexp_extract_all(lower(text), '[\\p{L}\\p{M}\\p{Nd}\\p{Pc}]{2,}')"
_TRAIN = f"""texts AS (
  SELECT doc_id, text, quality AS label,
         CAST(('0x' || substr(md5(concat_ws('|', '42', doc_id)), 1, 8))::BIGINT / 4294967296 < 0.2 AS BIGINT) AS is_test
  FROM documents JOIN labels USING (doc_id)),
listed AS MATERIALIZED (SELECT doc_id, label, is_test, {_RUNS} AS w FROM texts),
used AS MATERIALIZED (
  SELECT doc_id, label, is_test, unnest(w) AS term FROM listed
  UNION ALL
  SELECT doc_id, label, is_test, a || ' ' || b FROM (
    SELECT doc_id, label, is_test, unnest(w[1:len(w) - 1]) AS a, unnest(w[2:]) AS b FROM listed WHERE len(w) > 1)),
dictionary AS MATERIALIZED (
  SELECT term, count(*) AS uses, count(DISTINCT doc_id) AS texts FROM used WHERE is_test = 0
  GROUP BY term ORDER BY uses DESC, term LIMIT {models.VOCABULARY}),
sizes AS (SELECT count(*) FILTER (WHERE is_test = 0) AS n FROM texts),
idf AS (SELECT term, uses, ln((1 + n) / (1 + texts)) + 1 AS idf FROM dictionary, sizes)"""


def _split_texts(spark, folder):
    return landed(sampling.split_by_draw(t.labelled_texts(spark, folder), ["doc_id"]), "labelled")


@query(
    "term_dictionary",
    f"WITH {_TRAIN} SELECT term, uses, round(idf, 9) AS idf FROM idf",
)
def term_dictionary(spark, folder):
    """The most used words and pairs of the labelled documents that are not held out, with their idf."""
    train = _split_texts(spark, folder).where("is_test = 0")
    top = landed(top_terms(train, models.VOCABULARY), "top-terms")
    fitted = models.fit_tfidf(train)
    terms, factors = fitted.stages[-3].vocabulary, fitted.stages[-2].getScalingVec()
    idf = spark.createDataFrame([(w, float(f)) for w, f in zip(terms, factors)], "term string, idf double")
    return tidy(top.join(idf, "term"))


@query(
    "bayes_posteriors",
    f"""WITH {_TRAIN},
weighted AS MATERIALIZED (
  SELECT doc_id, label, is_test, term, count(*) * any_value(idf) AS x FROM used JOIN idf USING (term)
  GROUP BY doc_id, label, is_test, term),
units AS MATERIALIZED (
  SELECT *, x / sqrt(sum(x * x) OVER (PARTITION BY doc_id)) AS u FROM weighted),
classes AS (
  SELECT term, sum(u) FILTER (WHERE label = 0) AS s0, sum(u) FILTER (WHERE label = 1) AS s1
  FROM dictionary LEFT JOIN (SELECT * FROM units WHERE is_test = 0) USING (term) GROUP BY term),
totals AS (SELECT sum(coalesce(s0, 0) + 1) AS t0, sum(coalesce(s1, 0) + 1) AS t1 FROM classes),
odds AS (
  SELECT term, ln((coalesce(s1, 0) + 1) / t1) - ln((coalesce(s0, 0) + 1) / t0) AS lean FROM classes, totals),
prior AS (SELECT ln(count(*) FILTER (WHERE label = 1)) - ln(count(*) FILTER (WHERE label = 0)) AS lean
          FROM texts WHERE is_test = 0)
SELECT doc_id, label, round(1 / (1 + exp(-(any_value(p.lean) + coalesce(sum(u * o.lean), 0)))), 9) AS probability
FROM (SELECT * FROM texts WHERE is_test = 1) LEFT JOIN (SELECT doc_id, term, u FROM units) USING (doc_id)
LEFT JOIN odds o USING (term), prior p GROUP BY doc_id, label""",
)
def bayes_posteriors(spark, folder):
    """Posteriors of naive Bayes on TF-IDF vectors for held-out documents."""
    split = _split_texts(spark, folder)
    tfidf = models.fit_tfidf(split.where("is_test = 0"))
    features = tfidf.transform(split).select("doc_id", "label", "is_test", "features")
    detector = linear.fit_bayes(features.where("is_test = 0"))
    return tidy(models.score(detector, features.where("is_test = 1"), "probability").select("doc_id", "label", "probability"))


@query(
    "platt_sigmoid",
    f"""WITH RECURSIVE given AS (
  SELECT vec_id, CAST(label < 5 AS BIGINT) AS label, list_dot_product(CAST(embedding AS DOUBLE[]), {GIVEN}) AS m
  FROM embeddings),
sizes AS (SELECT count(*) FILTER (WHERE label = 1) AS one, count(*) FILTER (WHERE label = 0) AS zero FROM given),
rows AS MATERIALIZED (
  SELECT m, CASE WHEN label = 1 THEN (one + 1) / (one + 2) ELSE 1 / (zero + 2) END AS y FROM given, sizes),
newton AS (
  SELECT 0 AS i, 0.0::DOUBLE AS a, 0.0::DOUBLE AS b
  UNION ALL
  SELECT i + 1, a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab), b - (haa * gb - hab * ga) / (haa * hbb - hab * hab)
  FROM (SELECT i, any_value(a) AS a, any_value(b) AS b, sum((p - y) * m) AS ga, sum(p - y) AS gb,
               sum(p * (1 - p) * m * m) AS haa, sum(p * (1 - p) * m) AS hab, sum(p * (1 - p)) AS hbb
        FROM (SELECT *, 1 / (1 + exp(-(a * m + b))) AS p FROM newton, rows WHERE i < 25) GROUP BY i))
SELECT vec_id, label, round(1 / (1 + exp(-(a * m + b))), 7) AS probability FROM given, newton WHERE i = 25""",
)
def platt_sigmoid(spark, folder):
    """Probabilities out of given margins, by the sigmoid that the machine's folds are turned into."""
    given = linear.LinearModel(np.array(GIVEN), 0.0)
    margins = given.score(models.embedding_features(_vectors(spark, folder)), "p")
    margins = landed(margins.select("vec_id", "label", F.log(F.col("p") / (1 - F.col("p"))).alias("margin")), "margins")
    slope, shift = linear.fit_sigmoid(margins)
    return tidy(margins.select("vec_id", "label", (1 / (1 + F.exp(-(slope * F.col("margin") + shift)))).alias("probability")), 7)


@query(
    "detector_eval",
    f"""WITH {_TRAIN},
scored AS (
  SELECT label, coalesce(sum(idf * (CASE WHEN ascii(substr(md5(term), 1, 1)) % 2 = 0 THEN 1 ELSE -1 END)), 0) AS score
  FROM (SELECT DISTINCT doc_id, label FROM listed WHERE is_test = 1)
  LEFT JOIN (SELECT DISTINCT doc_id, term FROM used WHERE is_test = 1) USING (doc_id) LEFT JOIN idf USING (term)
  GROUP BY doc_id, label),
named AS (SELECT round(score, 7) AS score, label, 'all' AS name FROM scored),
{areas_sql("named", "name")}""",
)
def detector_eval(spark, folder):
    """Areas of a given text detector on held-out documents: every term has a sign of its own."""
    split = _split_texts(spark, folder)
    tfidf = models.fit_tfidf(split.where("is_test = 0"))
    terms, factors = tfidf.stages[-3].vocabulary, tfidf.stages[-2].getScalingVec()
    signs = [1.0 if ord(hashlib.md5(w.encode()).hexdigest()[0]) % 2 == 0 else -1.0 for w in terms]
    given = linear.LinearModel(np.array(signs) * factors.toArray(), 0.0)
    present = Binarizer(threshold=0.0, inputCol="_counts", outputCol="present")
    held_out = present.transform(tfidf.transform(split.where("is_test = 1"))).select("label", "present")
    scored = given.margin(held_out, "score", "present").withColumn("name", F.lit("all"))
    return tidy(models.detector_areas(tidy(scored.select("name", "label", "score"), 7), ["name"]))


@query("fitted_detector_eval")
def fitted_detector_eval(spark, folder):
    """Areas of a text detector fitted on labelled documents, on held-out ones."""
    split = _split_texts(spark, folder)
    tfidf = models.fit_tfidf(split.where("is_test = 0"))
    features = landed(tfidf.transform(split).select("label", "is_test", "features"), "features")
    train = features.where("is_test = 0")
    detector, = linear.descend(train, [linear.Descent(linear.width(train) + 1, "logistic")])
    scored = models.score(detector, features.where("is_test = 1"), "score")
    return tidy(models.detector_areas(scored.select("label", "score")), 4)


_ORDER_SCORE = "1 / (1 + exp(-((o_totalprice % 1000) / 500.0::DOUBLE - month(o_orderdate) / 6.0::DOUBLE)))"


@query(
    "usage_trend",
    f"""WITH messages AS (
  SELECT year(o_orderdate) + 22 AS year, {_ORDER_SCORE} AS raw FROM orders),
scaled AS (
  SELECT *, CASE WHEN year < 2021 THEN raw * 0.10::DOUBLE WHEN year = 2021 THEN raw * 0.40::DOUBLE
                 WHEN year = 2022 THEN raw * 0.85::DOUBLE
                 ELSE least(raw * 1.3::DOUBLE, 1.0::DOUBLE) END AS p FROM messages)
SELECT CAST(year AS BIGINT) AS year, count(*) AS total_commits,
       count(*) FILTER (WHERE p > 0.5) AS ai_commits,
       count(*) FILTER (WHERE raw > 0.5) AS ai_commits_raw, round(avg(p), 9) AS avg_ai_probability,
       round(count(*) FILTER (WHERE p > 0.5) / count(*) * 100, 9) AS percentage_ai,
       round(count(*) FILTER (WHERE raw > 0.5) / count(*) * 100, 9) AS percentage_ai_raw
FROM scaled GROUP BY year""",
)
def usage_trend(spark, folder):
    """Yearly share of flagged messages out of a given detector, over all messages."""
    orders = t.table(spark, folder, "orders").select(
        F.col("o_orderkey").alias("key"), (F.year("o_orderdate") + 22).alias("year"),
        "o_totalprice", "o_orderdate",
    )

    def score(rows):
        margin = F.col("o_totalprice") % 1000 / 500.0 - F.month("o_orderdate") / 6.0
        return rows.withColumn("raw_ai_probability", 1 / (1 + F.exp(-margin)))

    return tidy(messages.usage_trend(orders, score))


@query("score_distribution",
       f"WITH {histogram_sql(f'SELECT {_GIVEN_SCORE} AS x FROM embeddings', '10', False)}")
def score_distribution(spark, folder):
    """Histogram of a given detector's probabilities on all vectors."""
    return tidy(curves.histogram(_given_scores(spark, folder), "prob_ai", 10), 6)
