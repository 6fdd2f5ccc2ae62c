from __future__ import annotations

from pyspark.sql import functions as F

from hunkmill.catalog import tables as t
from hunkmill.catalog.metric_queries import areas_sql
from hunkmill.catalog.registry import query, tidy
from hunkmill.functions.exact import mean_sql, spread_sql
from hunkmill.operators import corpus, curves, pairs, perturb
from hunkmill.plans import contrast
from hunkmill.session import landed

K = corpus.SMOOTHING


# --- language model ---------------------------------------------------------------------------
def _token_pairs(name: str, rows: str, keys: str, text: str = "text") -> str:
    """CTE with keys, ctx, tok of all neighbouring tokens."""
    tokens = t.tokens_sql(text)
    return f"""{name} AS (
  SELECT {keys}, unnest(ts[1:len(ts) - 1]) AS ctx, unnest(ts[2:]) AS tok
  FROM (SELECT {keys}, {tokens} AS ts FROM {rows}) WHERE len(ts) > 1)"""


def model_sql(rows: str, key: str, text: str = "text") -> str:
    """CTEs model_pairs (ctx, tok, n, rank), model_contexts and vocabulary of a reference corpus."""
    return f"""{_token_pairs('reference_pairs', rows, key, text)},
vocabulary AS (SELECT count(DISTINCT tok) + 1 AS words
               FROM (SELECT unnest({t.tokens_sql(text)}) AS tok FROM {rows})),
pair_counts AS (SELECT ctx, tok, count(*) AS n FROM reference_pairs GROUP BY ALL),
model_pairs AS (SELECT *, rank() OVER (PARTITION BY ctx ORDER BY n DESC) AS rank FROM pair_counts),
context_sums AS (SELECT ctx, sum(n) AS total, count(*) AS seen FROM pair_counts GROUP BY ctx),
model_contexts AS (
  SELECT ctx, total, seen,
         (SELECT -sum((p.n + {K}::DOUBLE) / (total + {K}::DOUBLE * words)
                      * ln((p.n + {K}::DOUBLE) / (total + {K}::DOUBLE * words)))
          FROM pair_counts p WHERE p.ctx = c.ctx)
         - (words - seen) * {K}::DOUBLE / (total + {K}::DOUBLE * words)
           * ln({K}::DOUBLE / (total + {K}::DOUBLE * words)) AS entropy
  FROM context_sums c, vocabulary)"""


def scores_sql(rows: str, keys: str, text: str = "text") -> str:
    return f"""{_token_pairs('scored_pairs', rows, keys, text)},
token_scores AS (
  SELECT {keys},
         ln((coalesce(n, 0) + {K}::DOUBLE) / (coalesce(total, 0) + {K}::DOUBLE * words)) AS log_p,
         coalesce(p.rank, coalesce(seen, 0) + 1) AS token_rank,
         coalesce(entropy, ln(words)) AS token_entropy
  FROM scored_pairs LEFT JOIN model_pairs p USING (ctx, tok)
       LEFT JOIN model_contexts USING (ctx), vocabulary),
text_scores AS (
  SELECT {keys}, count(*) AS scored_tokens, {mean_sql('log_p')} AS likelihood,
         avg(token_rank) AS rank, {mean_sql('ln(token_rank)')} AS log_rank,
         {mean_sql('token_entropy')} AS entropy
  FROM token_scores GROUP BY {keys})"""


def _benchmark_model(spark, folder) -> corpus.WordPairModel:
    return corpus.fit(t.table(spark, folder, "benchmark")).landed(spark)


_MODEL = model_sql("benchmark", "item_id")


@query("ngram_model", f"WITH {_MODEL} SELECT ctx, tok, n, CAST(rank AS BIGINT) AS rank FROM model_pairs")
def ngram_model(spark, folder):
    return tidy(_benchmark_model(spark, folder).pairs)


@query(
    "ngram_contexts",
    f"""WITH {_MODEL} SELECT ctx, CAST(total AS BIGINT) AS total, seen,
       round(entropy, 7) AS entropy FROM model_contexts""",
)
def ngram_contexts(spark, folder):
    return tidy(_benchmark_model(spark, folder).contexts, 7)


_SCORED = f"{_MODEL}, {scores_sql('documents', 'doc_id')}"


def _document_scores(spark, folder):
    documents = t.table(spark, folder, "documents").select("doc_id", "text")
    return corpus.score_texts(documents, _benchmark_model(spark, folder), ["doc_id"])


def _score_query(name: str, column: str):
    @query(
        name,
        f"""WITH {_SCORED}
SELECT doc_id, coalesce(scored_tokens, 0) AS scored_tokens, round({column}, 7) AS {column}
FROM documents LEFT JOIN text_scores USING (doc_id)""",
    )
    def run(spark, folder):
        rows = _document_scores(spark, folder).select("doc_id", "scored_tokens", column)
        return tidy(rows, 7)

    return run


for _name, _column in (("score_likelihood", "likelihood"), ("score_rank", "rank"),
                       ("score_log_rank", "log_rank"), ("score_entropy", "entropy")):
    _score_query(_name, _column)


_SIDES = f"""{t.PAIRS},
sides AS (SELECT pair_id, 'original' AS side, 0 AS label, original AS text FROM pairs
          UNION ALL SELECT pair_id, 'sampled', 1, sampled FROM pairs)"""
_BASELINE = f"""{_SIDES}, {_MODEL}, {scores_sql('sides', 'pair_id, side')},
criteria AS (
  SELECT label, unnest([{{'c': 'likelihood', 's': likelihood}}, {{'c': 'rank', 's': -rank}},
                        {{'c': 'log_rank', 's': -log_rank}}, {{'c': 'entropy', 's': entropy}}]) AS u
  FROM text_scores JOIN sides USING (pair_id, side)),
named AS (SELECT u.c AS criterion, u.s AS score, label FROM criteria)"""


@query("baseline_threshold", f"WITH {_BASELINE}, {areas_sql('named', 'criterion')}")
def baseline_threshold(spark, folder):
    sides = pairs.pair_sides(t.text_pairs(spark, folder))
    keys = ["pair_id", "side"]
    scored = corpus.score_texts(sides, _benchmark_model(spark, folder), keys)
    joined = scored.join(sides.select(*keys, "label"), keys)
    return tidy(curves.areas(corpus.criteria_long(joined, ["label"]), ["criterion"]))


# --- masks and fills --------------------------------------------------------------------------
def spans_sql(
    rows: str, keys: str, span: int, buffer: int, share: float, seed: int, round_up: bool = False
) -> str:
    """CTEs to ``starts`` (keys, place, start) and ``cut`` (keys, pieces)."""
    rounding = "ceil" if round_up else "floor"
    stretch = span + buffer - 1
    return f"""cut AS (SELECT {keys}, string_split(text, ' ') AS pieces FROM {rows}),
wanted AS (
  SELECT *, CASE WHEN len(pieces) > {span} THEN least(
      CAST({rounding}({share}::DOUBLE * len(pieces) / {span + 2 * buffer}) AS BIGINT),
      (len(pieces) - {span} - 1) // {span + buffer} + 1) ELSE 0 END AS n,
    md5(concat_ws('|', '{seed}', {keys})) AS digest FROM cut),
slots AS (
  SELECT {keys}, n, unnest(range(len(pieces) - {span} - (n - 1) * {stretch})) AS slot, digest
  FROM wanted WHERE n > 0),
drawn AS (
  SELECT {keys}, slot, n, row_number() OVER (
    PARTITION BY {keys} ORDER BY md5(concat_ws('|', digest, slot)), slot) AS o FROM slots),
starts AS (
  SELECT {keys}, row_number() OVER (PARTITION BY {keys} ORDER BY slot) - 1 AS place,
         slot + (row_number() OVER (PARTITION BY {keys} ORDER BY slot) - 1) * {stretch} AS start
  FROM drawn WHERE o <= n)"""


def splice_sql(keys: str, span: int, fill: str, source: str = "starts") -> str:
    """CTE ``spliced`` (keys, text): pieces with every span replaced by ``fill``."""
    on = " AND ".join(f"a.{k.strip()} = b.{k.strip()}" for k in keys.split(","))
    own = ", ".join(f"a.{k.strip()}" for k in keys.split(","))
    return f"""places AS (
  SELECT {keys}, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS i FROM cut),
covered AS (SELECT b.*, unnest(range({span})) AS j FROM {source} b),
merged AS (
  SELECT {own}, a.i, CASE WHEN b.j IS NULL THEN a.piece ELSE {fill} END AS piece, b.j
  FROM places a LEFT JOIN covered b ON {on} AND a.i = b.start + b.j),
spliced AS (
  SELECT {keys}, string_agg(piece, ' ' ORDER BY i) AS text FROM merged
  WHERE j IS NULL OR j = 0 GROUP BY {keys})"""


def _texts(spark, folder):
    return t.table(spark, folder, "documents").select("doc_id", "text")


@query(
    "mask_spans",
    f"""WITH {spans_sql('documents', 'doc_id', 2, 1, 0.3, 0)},
{splice_sql('doc_id', 2, "'<extra_id_' || b.place || '>'")},
marks AS (SELECT doc_id, count(*) AS n FROM starts GROUP BY doc_id)
SELECT doc_id, md5(text) AS masked_md5, coalesce(n, 0) AS mask_count, coalesce(n, 0) AS counted
FROM spliced LEFT JOIN marks USING (doc_id)""",
)
def mask_spans(spark, folder):
    from hunkmill.functions.pytext import mask_count

    masked = perturb.mask_spans(_texts(spark, folder), ["doc_id"])
    return tidy(masked.select(
        "doc_id", F.md5("masked").alias("masked_md5"), "mask_count",
        mask_count(F.col("masked")).alias("counted"),
    ))


DICTIONARY = f"""dictionary AS (
  SELECT word, row_number() OVER (ORDER BY substr(md5(word), 1, 3), word) - 1 AS idx
  FROM (SELECT DISTINCT unnest({t.words_sql('text')}) AS word FROM all_texts)),
size AS (SELECT count(*) AS total FROM dictionary)"""


def _unit(text: str) -> str:
    return f"(('0x' || substr(md5({text}), 1, 8))::BIGINT / 4294967296)"


def drawn_words_sql(keys: str, span: int, seed: int) -> str:
    """CTE ``drawn_words`` (keys, place, fill)."""
    step = (
        f"1 + floor({_unit('draw || ' + chr(39) + 'b' + chr(39))} * greatest((total - 1) // {span - 1}, 1))"
        if span > 1 else "0"
    )
    return f"""draws AS (
  SELECT {keys}, place, md5(concat_ws('|', '{seed}', {keys}, place)) AS draw, total
  FROM starts, size),
numbers AS (
  SELECT {keys}, place, j,
         CAST((floor({_unit("draw || 'a'")} * total) + j * ({step})) % total AS BIGINT) AS idx
  FROM draws, (SELECT unnest(range({span})) AS j)),
drawn_words AS (
  SELECT {keys}, place, string_agg(word, ' ' ORDER BY j) AS fill
  FROM numbers JOIN dictionary USING (idx) GROUP BY {keys}, place)"""


def fill_sql(rows: str, keys: str, seed: int = 0, span: int = 2, round_up: bool = False,
             share: float = 0.3) -> str:
    return f"""{spans_sql(rows, keys, span, 1, share, seed, round_up)},
{drawn_words_sql(keys, span, seed)},
filled AS (SELECT * FROM starts JOIN drawn_words USING ({keys}, place)),
{splice_sql(keys, span, 'b.fill', 'filled')}"""


def _document_words(spark, folder):
    both = _texts(spark, folder).select(
        F.col("text").alias("original"), F.lit("").alias("sampled")
    )
    return pairs.distinct_words(both)


def _document_index(spark, folder):
    return landed(perturb.dictionary_index(_document_words(spark, folder)), "fill-words")


@query(
    "dictionary_index",
    f"""WITH all_texts AS (SELECT text FROM documents), {DICTIONARY}
SELECT word, idx FROM dictionary""",
)
def dictionary_index(spark, folder):
    return tidy(perturb.dictionary_index(_document_words(spark, folder)))


@query(
    "random_fill",
    f"""WITH all_texts AS (SELECT text FROM documents), {DICTIONARY},
{fill_sql('documents', 'doc_id')}
SELECT doc_id, md5(text) AS text_md5 FROM spliced""",
)
def random_fill(spark, folder):
    filled = perturb.random_fill(
        _texts(spark, folder), _document_index(spark, folder), ["doc_id"]
    )
    return filled.select("doc_id", F.md5("text").alias("text_md5"))


@query(
    "random_token_replace",
    f"""WITH all_texts AS (SELECT text FROM documents), {DICTIONARY},
cut AS (SELECT doc_id, string_split(text, ' ') AS pieces,
               md5(concat_ws('|', '0', doc_id)) AS digest FROM documents),
tried AS (SELECT doc_id, digest, unnest(range(len(pieces))) AS start FROM cut),
starts AS (
  SELECT doc_id, start, row_number() OVER (PARTITION BY doc_id ORDER BY start) - 1 AS place
  FROM tried WHERE {_unit("concat_ws('|', digest, start)")} < (0.3::DOUBLE * 2 / 4)),
{drawn_words_sql('doc_id', 1, 0)},
filled AS (SELECT * FROM starts JOIN drawn_words USING (doc_id, place)),
{splice_sql('doc_id', 1, 'b.fill', 'filled')}
SELECT doc_id, md5(text) AS text_md5 FROM spliced""",
)
def random_token_replace(spark, folder):
    replaced = perturb.random_replace(
        _texts(spark, folder), _document_index(spark, folder), ["doc_id"]
    )
    return replaced.select("doc_id", F.md5("text").alias("text_md5"))


# --- fills of a mask filler -------------------------------------------------------------------
# The filler's answer is made from the text: one word per mask, and one mark too few for every
# fifth document.
@query(
    "apply_fills",
    f"""WITH {spans_sql('documents', 'doc_id', 2, 1, 0.3, 0)},
{splice_sql('doc_id', 2, "upper('f' || b.place)")},
counted AS (SELECT doc_id, count(*) AS n FROM starts GROUP BY doc_id)
SELECT doc_id, CASE WHEN coalesce(n, 0) > 0 AND doc_id % 5 = 0 THEN md5('') ELSE md5(text) END
         AS text_md5,
       CASE WHEN coalesce(n, 0) > 0 AND doc_id % 5 = 0 THEN 0 ELSE 1 END AS accepted
FROM spliced LEFT JOIN counted USING (doc_id)""",
)
def apply_fills(spark, folder):
    masked = perturb.mask_spans(_texts(spark, folder), ["doc_id"])
    given = F.col("mask_count") - F.when(F.col("doc_id") % 5 == 0, 1).otherwise(0)
    answers = F.transform(
        F.sequence(F.lit(0), F.greatest(given, F.lit(0))),
        lambda i: F.concat(
            F.lit("<extra_id_"), i.cast("string"), F.lit(">  F"), i.cast("string"), F.lit("\n ")
        ),
    )
    answer = F.concat(F.lit("<pad>"), F.array_join(answers, ""), F.lit("</s>"))
    rows = masked.select("doc_id", "masked", answer.alias("generated"))
    return tidy(perturb.apply_fills(rows).select(
        "doc_id", F.md5("text").alias("text_md5"), "accepted"
    ))


# --- the whole contrast -----------------------------------------------------------------------
_COPIED = f"""{_SIDES},
all_texts AS (SELECT text FROM sides), {DICTIONARY},
copies AS (SELECT pair_id, side, copy_id, text
           FROM sides, (SELECT unnest(range(1, 11)) AS copy_id)),
{fill_sql('copies', 'pair_id, side, copy_id')}"""
_CONTRAST = f"""{_COPIED}, {_MODEL},
{scores_sql('sides', 'pair_id, side')},
{scores_sql('spliced', 'pair_id, side, copy_id').replace('scored_pairs', 'copy_pairs').replace('token_scores', 'copy_tokens').replace('text_scores', 'copy_scores')},
stats AS (
  SELECT pair_id, side, n AS n_perturbations, {mean_sql('likelihood')} AS mean,
         CASE WHEN {spread_sql('likelihood')} = 0 THEN 1 ELSE {spread_sql('likelihood')} END AS sd
  FROM copy_scores, (VALUES (1), (10)) AS c(n) WHERE copy_id <= n GROUP BY pair_id, side, n),
criteria AS (
  SELECT n_perturbations, label,
         unnest([{{'c': 'd', 's': likelihood - mean}}, {{'c': 'z', 's': (likelihood - mean) / sd}}])
           AS u
  FROM text_scores JOIN stats USING (pair_id, side) JOIN sides USING (pair_id, side)),
named AS (SELECT 'perturbation_' || n_perturbations || '_' || u.c AS name, label,
                 u.s AS score FROM criteria)"""


@query("perturb_and_score", f"WITH {_CONTRAST}, {areas_sql('named', 'name')}")
def perturb_and_score(spark, folder):
    scores = contrast.curvature_scores(
        t.text_pairs(spark, folder), _benchmark_model(spark, folder), [1, 10]
    )
    return tidy(curves.areas(scores, ["name"]))


@query(
    "pre_perturb",
    f"""WITH {t.PAIRS}, all_texts AS (SELECT original AS text FROM pairs
                                     UNION ALL SELECT sampled FROM pairs), {DICTIONARY},
sampled_side AS (SELECT pair_id, sampled AS text FROM pairs),
{fill_sql('sampled_side', 'pair_id', 7, 5, True, 0.1)}
SELECT pair_id, md5(original) AS original_md5, md5(s.text) AS sampled_md5
FROM pairs JOIN spliced s USING (pair_id)""",
)
def pre_perturb(spark, folder):
    changed = contrast.pre_perturb(t.text_pairs(spark, folder), 0.1, span=5, seed=7)
    return changed.select(
        "pair_id", F.md5("original").alias("original_md5"), F.md5("sampled").alias("sampled_md5")
    )
