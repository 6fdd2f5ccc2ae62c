"""Soft-membership mixing of domains to target weights, with DataFrame functions only.

A labelled table says for some documents which domain they belong to. A logistic classifier over the
words that tell the domains apart (up to ``VOCABULARY``), and three text marks, gives every document a
posterior per domain.
Nonnegative rates per document are then fitted so that the expected tokens of each domain, the sum of
rate x posterior x tokens, meet the targets: projected gradient on the least squares of what is
missing, starting from rate 1. The gradient is taken in the metric of the documents' tokens and the
missing tokens are weighted by the inverse of the posteriors' moments, so a step meets the targets
but for the projection. Each step is one distributed sum; the driver holds numbers per domain only.

Bounds: the classifier is fitted on at most ``SAMPLE_ROWS`` labelled documents; counts, posteriors and
sums cover all documents. Targets that rates cannot meet (a domain without documents, or more of one
that always comes with another) are told: the mixture has targets, what the rates reach, and ``met``.

Edge cases: a null or empty text has no tokens and does not matter to the sums, its posterior is
that of a text without any word; very long texts are hashed word by word like others; labels with null id or domain are ignored, of several labels the smallest domain
counts; without labels there are no domains and every rate is 1; repeated and null ids are rows like
others; an empty table gives an empty table; extra columns are kept by ``with_rates``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from hunkmill.llm.sized import sent_if_small
from hunkmill.session import landed

SAMPLE_ROWS = 50_000
#: What a word must tell of the domains (in nats, summed over the labelled documents), and how many such
#: words the classifier knows, at most; enough for those of several languages.
GAIN, VOCABULARY = 8.0, 4096
PENALTY, FIT_STEPS, FIT_TASKS = 1e-3, 40, 2
STEPS, CLOSE = 40, 1e-6
#: Targets count as met if no domain misses more than this share of all tokens.
MET = 1e-3


def _words(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _told(rows: DataFrame, text: str) -> DataFrame:
    """Adds n_tokens, ``seen`` (the distinct words) and ``signs`` for many symbols, capitals and repeated
    words."""
    worded = rows.withColumn("words", _words(text))
    worded = worded.withColumn("n_tokens", F.size("words").cast("long")).withColumn("seen", F.array_distinct("words")).drop("words")
    body, size = F.coalesce(F.col(text).cast("string"), F.lit("")), F.col("n_tokens")
    symbols = F.length(body) - F.length(F.translate(body, "#*$%&|<>", ""))
    capitals = F.length(body) - F.length(F.translate(body, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    signs = [symbols * 10 > size, capitals * 4 > F.length(body), F.size("seen") * 5 < size * 2]
    return worded.withColumn("signs", F.array(*[sign.cast("double") for sign in signs]))


def _features(told: DataFrame, vocabulary: list[str]) -> DataFrame:
    """Adds ``features``: which of the words are there, and the signs."""
    counter = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="seen", outputCol="there")
    vectors = counter.transform(told).withColumn("signs", array_to_vector("signs"))
    return VectorAssembler(inputCols=["there", "signs"], outputCol="features").transform(vectors).drop("seen", "there", "signs")


class Classifier:
    """The domains in order, and the words and model that give their probabilities; without a model,
    ``shares``."""

    def __init__(self, domains: list[str], shares: list[float], words: list[str] | None = None, model: LogisticRegressionModel | None = None):
        self.domains, self.shares, self.words, self.model = domains, shares, words, model
        #: Set by ``fit_rates``.
        self.targets: dict[str, float] = {}
        self.reached: dict[str, float] = {}
        self.met = True


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", domain: str = "domain", sample_rows: int = SAMPLE_ROWS, vocabulary: int = VOCABULARY) -> Classifier:
    """Logistic regression on the labelled documents whose hashed ids come first."""
    known = labels.where(F.col(key).isNotNull() & F.col(domain).isNotNull()).groupBy(F.col(key).alias("key")).agg(F.min(F.col(domain).cast("string")).alias("domain"))
    chosen = landed(known.orderBy(F.xxhash64("key"), "key").limit(sample_rows), "labelled")
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(chosen), "key")
    told = landed(_told(rows, "text").select("domain", "seen", "signs"), "labelled-words")
    sizes = {r.domain: r.n for r in told.groupBy("domain").agg(F.count("*").alias("n")).collect()}
    domains, total = sorted(sizes), sum(sizes.values())
    if len(domains) < 2:
        return Classifier(domains, [1.0] * len(domains))
    per_domain = [F.count_if(F.col("domain") == d).alias(f"d{i}") for i, d in enumerate(domains)]
    counts = told.select("domain", F.explode("seen").alias("word")).groupBy("word").agg(*per_domain)
    # The part of the mutual information that a word's presence has on the domain.
    gain, all_docs = F.lit(0.0), sum((F.col(f"d{i}") for i in range(len(domains))), F.lit(0))
    for i, d in enumerate(domains):
        there = F.col(f"d{i}")
        gain = gain + F.when(there > 0, there * F.log(there * float(total) / (all_docs * float(sizes[d])))).otherwise(0.0)
    best = [r.word for r in counts.withColumn("gain", gain).where(F.col("gain") >= GAIN).orderBy(F.desc("gain"), "word").limit(vocabulary).select("word").collect()]
    if not best:
        return Classifier(domains, [sizes[d] / total for d in domains])
    place = F.create_map(*[F.lit(x) for i, d in enumerate(domains) for x in (d, float(i))])
    rows = _features(told, best).select(F.element_at(place, F.col("domain")).alias("label"), "features")
    # Few rows, by their bound, so that few tasks hold them through all steps.
    model = LogisticRegression(family="multinomial", regParam=PENALTY, maxIter=FIT_STEPS, tol=1e-6, standardization=True).fit(landed(rows, "training-rows").coalesce(FIT_TASKS))
    return Classifier(domains, [sizes[d] / total for d in domains], best, model)


def with_posteriors(docs: DataFrame, classifier: Classifier, text: str = "text") -> DataFrame:
    """All columns, n_tokens and ``posterior``, an array in the order of the classifier's domains."""
    own = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(text).alias("text"))
    if classifier.model is None:
        posterior = F.array(*[F.lit(s) for s in classifier.shares]).cast("array<double>")
        return own.select("row", F.size(_words("text")).cast("long").alias("n_tokens"), posterior.alias("posterior"))
    told = classifier.model.transform(_features(_told(own, "text"), classifier.words))
    return told.select("row", "n_tokens", vector_to_array("probability").alias("posterior"))


def _solved(matrix: list[list[float]], right: list[float]) -> list[float]:
    """The solution of a small linear system, by elimination; a vanishing direction gets 0."""
    size = len(right)
    rows = [[*matrix[i], right[i]] for i in range(size)]
    largest = max((abs(x) for row in matrix for x in row), default=0.0)
    used: dict[int, int] = {}
    free = list(range(size))
    for column in range(size):
        pivot = max(free, key=lambda r: abs(rows[r][column]), default=None)
        if pivot is None or abs(rows[pivot][column]) <= 1e-12 * largest:
            continue
        free.remove(pivot)
        used[column] = pivot
        for r in range(size):
            if r != pivot:
                factor = rows[r][column] / rows[pivot][column]
                rows[r] = [a - factor * b for a, b in zip(rows[r], rows[pivot])]
    return [rows[used[c]][size] / rows[used[c]][c] if c in used else 0.0 for c in range(size)]


def _missing(reached: list[float], targets: list[float]) -> float:
    return max(abs(r - t) for r, t in zip(reached, targets))


def fit_rates(told: DataFrame, classifier: Classifier, weights: dict[str, float], targets_of: Callable[[dict[str, float]], dict[str, float]] | None = None) -> tuple[Column, dict[str, float], dict[str, float]]:
    """The rate as an expression over ``posterior``, the targets, and the expected tokens it reaches.

    ``told`` (written already) has n_tokens and posterior. The targets share out all tokens by weight;
    domains without a weight get 0. ``targets_of`` gives other targets from the domains' expected
    tokens at rate 1. A target far above what a domain has is met by documents that only might belong
    to it, at the expense of all others.
    """
    size = len(classifier.domains)
    if not size:
        return F.lit(1.0), {}, {}
    p = [F.col("posterior")[d] for d in range(size)]
    tokens = F.col("n_tokens").cast("double")
    moments = told.agg(*[F.coalesce(F.sum(tokens * p[a] * p[b]), F.lit(0.0)).alias(f"m{a}_{b}") for a in range(size) for b in range(a, size)], *[F.coalesce(F.sum(tokens * p[d]), F.lit(0.0)).alias(f"s{d}") for d in range(size)]).first()
    gram = [[moments[f"m{min(a, b)}_{max(a, b)}"] for b in range(size)] for a in range(size)]
    reached = [moments[f"s{d}"] for d in range(size)]
    now = dict(zip(classifier.domains, reached))
    total = sum(reached)
    share = sum(weights.get(d, 0.0) for d in classifier.domains) or 1.0
    targets = [total * weights.get(d, 0.0) / share for d in classifier.domains]
    if targets_of:
        wanted = targets_of(now)
        targets = [wanted.get(d, 0.0) for d in classifier.domains]
    steps: list[list[float]] = []
    rate = best_rate = F.lit(1.0)
    best, best_reached = _missing(reached, targets), reached
    # The projection may leave something missing for good: stop when three steps have gained nothing.
    idle = 0
    while len(steps) < STEPS and best > CLOSE * max(total, 1.0) and idle < 3:
        steps.append(_solved(gram, [r - t for r, t in zip(reached, targets)]))
        walked = F.array(*[F.array(*[F.lit(float(x)) for x in step]) for step in steps])
        rate = F.aggregate(walked, F.lit(1.0), lambda r, step: F.greatest(F.lit(0.0), r - F.aggregate(F.zip_with(step, F.col("posterior"), lambda a, b: a * b), F.lit(0.0), lambda x, y: x + y)))
        sums = told.agg(*[F.coalesce(F.sum(tokens * p[d] * rate), F.lit(0.0)).alias(f"s{d}") for d in range(size)]).first()
        reached = list(sums)
        missing = _missing(reached, targets)
        idle = 0 if missing < 0.999 * best else idle + 1
        if missing < best:
            best, best_rate, best_reached = missing, rate, reached
    classifier.targets = dict(zip(classifier.domains, targets))
    classifier.reached = dict(zip(classifier.domains, best_reached))
    classifier.met = best <= MET * max(total, 1.0)
    return best_rate, classifier.targets, classifier.reached


def with_rates(docs: DataFrame, labels: DataFrame, weights: dict[str, float], key: str = "doc_id", text: str = "text", keep: list[str] | None = None, targets_of: Callable[[dict[str, float]], dict[str, float]] | None = None) -> tuple[DataFrame, Classifier]:
    """All rows, their columns ``keep`` (all) as ``row``, with n_tokens, posterior and rate, and the
    classifier. The texts are read once for the posteriors, which are written with what is kept."""
    classifier = fit(docs, labels, key, text)
    kept = F.struct(*[F.col("row")[c].alias(c) for c in (docs.columns if keep is None else keep)])
    told = landed(with_posteriors(docs, classifier, text).withColumn("row", kept), "posteriors")
    rate, _, _ = fit_rates(told.select("n_tokens", "posterior"), classifier, weights, targets_of)
    return told.withColumn("rate", rate), classifier


def label_domains(labels: DataFrame) -> DataFrame:
    """doc_id and domain of the labels table: low (quality 0), toxic, clean."""
    domain = F.when(F.col("quality") == 0, "low").when(F.col("toxic") == 1, "toxic").when(F.col("quality").isNotNull(), "clean")
    return labels.select("doc_id", domain.alias("domain"))
