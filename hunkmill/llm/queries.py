"""The queries of the numbered operations."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from hunkmill.llm import (
    chat, covering, decontamination, jaccard, lexical_search, line_templates, merkle, mixing, personal_data, prefix_counts, quality,
    token_files, warc,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(function: Query) -> Query:
        QUERIES[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_HARD = "<|im_end|><|im_start|>assistant ok"


@query(
    "op1_chat_format",
    rf"""WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_HARD}' UNION ALL SELECT -1, 1, 'assistant', '{_HARD}')
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn))
         AS loss_sha256,
       CAST(sum(24 + length(role) + length(text)
                + length(regexp_extract_all(text, '<\\*\|'))) AS BIGINT) AS formatted_chars
FROM turns GROUP BY conv_id""",
)
def op1(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations and one whose texts hold control strings, formatted and read back."""
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", _HARD), (-1, 1, "assistant", _HARD)], "conv_id long, turn long, role string, text string")
    return chat.digests(chat.format_conversations(turns.union(more)))


@query("op2_quality_forest")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    """Rule statistics of all documents and whether they are kept."""
    docs = table(spark, folder, "documents")
    judge = quality.fit(docs, table(spark, folder, "labels"))
    rows = quality.judged(docs.select("doc_id", "text"), judge)
    return rows.select("doc_id", *[F.col("verdict")[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "anomaly", "kept")])


@query("op3_personal_data")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data in all documents, plain and disguised."""
    return personal_data.find_personal_data(table(spark, folder, "documents"))


@query(
    "op4_jaccard_classes",
    r"""WITH RECURSIVE lists AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM lists WHERE len(w) > 0)),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT c.a, c.b FROM (
    SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n
    FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY ALL) c
  JOIN sizes p ON p.doc_id = c.a JOIN sizes q ON q.doc_id = c.b
  WHERE 100 * c.n >= 75 * (p.n + q.n - c.n)),
reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(any_value(s.n), 0) AS n_shingles, min(r.b) AS component_id,
       coalesce(any_value(k.n), 0) AS n_links
FROM documents d JOIN reach r ON r.a = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
LEFT JOIN (SELECT a, count(*) AS n FROM links GROUP BY a) k ON k.a = d.doc_id
GROUP BY d.doc_id""",
)
def op4(spark: SparkSession, folder: str) -> DataFrame:
    """Classes and numbers of links of documents with a Jaccard similarity of 0.75 of their five-word shingles."""
    return jaccard.jaccard_classes(table(spark, folder, "documents"))


@query("op5_mixing_rates")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    """Posteriors and rates of all documents for 90 % clean, 7 % toxic and 3 % low-quality tokens."""
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    rated, classifier = mixing.with_rates(docs.select("doc_id", "text"), mixing.label_domains(labels), {"clean": 0.90, "toxic": 0.07, "low": 0.03}, keep=["doc_id"])
    shares = [F.col("posterior")[i].alias(f"p_{d}") for i, d in enumerate(classifier.domains)]
    return rated.select(F.col("row.doc_id").alias("doc_id"), "n_tokens", *shares, "rate")


@query("op6_token_files")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    """Writes the ids of all documents in document order, each ended by id 1, and reads them back."""
    files = token_files.write_tokens(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return token_files.read_tokens(files)


@query("op7_prefix_counts")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts of all documents, and how much of each fits into 2048 tokens."""
    counted = prefix_counts.count_prefixes(table(spark, folder, "documents"), public_tokenizers.path("word_bpe_49k.json"), budget=2048)
    return counted.drop("prefixes")


@query(
    "op8_warc_chunks",
    """WITH bodies AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
placed AS (SELECT *, max(page_id) OVER (PARTITION BY body) AS first FROM bodies),
told AS (SELECT *, strlen(body) >= 1000 AND page_id <> first AS again FROM placed)
SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN first END AS refers_to FROM told""",
)
def op8(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written to archives and read back as chunks; the last chunk of a record has its whole
    length and digest."""
    records = warc.with_record_types(table(spark, folder, "pages"))
    read = warc.read_archives(warc.write_archives(records), with_data=False)
    return read.where("last").select(
        F.col("key").alias("page_id"), F.col("bytes_so_far").alias("payload_bytes"), F.col("digest_so_far").alias("payload_digest"), "record_type", "refers_to",
    )


@query("op9_line_templates")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the lines whose template recurs: in three documents, long ones in two."""
    return line_templates.drop_recurring_lines(table(spark, folder, "documents"))


_CUT = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"


@query(
    "op10_decontamination",
    f"""WITH docs AS (SELECT doc_id, {_CUT} AS w FROM documents WHERE text IS NOT NULL),
items AS (SELECT item_id, w, len(w) AS n FROM (SELECT DISTINCT item_id, {_CUT} AS w FROM benchmark)),
item_grams AS (
  SELECT item_id, n, p, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT *, unnest(range(1, n - 3)) AS p FROM items)),
weights AS (
  SELECT g, ln(1 + (SELECT count(*) FROM items) / count(DISTINCT item_id)) AS weight
  FROM item_grams GROUP BY g),
item_counts AS (SELECT item_id, g, count(*) AS c, any_value(weight) AS weight
                FROM item_grams JOIN weights USING (g) GROUP BY item_id, g),
item_totals AS (SELECT item_id, sum(c * weight) AS total FROM item_counts GROUP BY item_id),
grams AS MATERIALIZED (
  SELECT doc_id, p, size, array_to_string(w[p:p + 4], ' ') AS g
  FROM (SELECT doc_id, w, len(w) AS size, unnest(range(1, len(w) - 3)) AS p FROM docs)),
pairs AS (
  SELECT doc_id, item_id FROM (SELECT doc_id, g, count(*) AS c FROM grams GROUP BY ALL) d
  JOIN item_counts i USING (g) JOIN item_totals t USING (item_id)
  GROUP BY doc_id, item_id HAVING sum(least(d.c, i.c) * weight) >= 0.749999 * any_value(total)),
windows AS (
  SELECT DISTINCT doc_id, item_id, n, size,
         unnest(range(greatest(0, d.p - n + 4), least(d.p - 1, greatest(0, size - n)) + 1)) AS start
  FROM grams d JOIN item_grams i USING (g) JOIN pairs USING (doc_id, item_id)),
counts AS (
  SELECT doc_id, item_id, least(n, w.size) AS n, start, g, count(*) AS c
  FROM windows w JOIN grams USING (doc_id) WHERE p > start AND p <= start + n - 4 GROUP BY ALL),
sums AS (
  SELECT c.doc_id, c.item_id, c.n, c.start, any_value(t.total) AS item_total,
         sum(c.c * coalesce(w.weight, ln(1 + (SELECT count(*) FROM items)))) AS total,
         sum(least(c.c, coalesce(i.c, 0)) * coalesce(w.weight, 0)) AS shared
  FROM counts c LEFT JOIN weights w USING (g)
  LEFT JOIN item_counts i ON i.item_id = c.item_id AND i.g = c.g
  JOIN item_totals t ON t.item_id = c.item_id GROUP BY ALL)
SELECT doc_id, item_id, start, n AS n_words, round(shared / (total + item_total - shared), 9) AS similarity
FROM sums WHERE round(shared / (total + item_total - shared), 9) >= 0.75""",
)
def op10(spark: SparkSession, folder: str) -> DataFrame:
    """All windows of documents that are similar to a benchmark item."""
    return decontamination.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("aligned")


def _tree_sql(start: str, levels: int, name: str) -> list[str]:
    """Tables ``name0`` (given, with t, i, n, digest) to ``name<levels>``; trees of one node stay as they are."""
    tables = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        tables.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT t, i // 16 AS i, (any_value(n) + 15) // 16 AS n,
         CASE WHEN any_value(n) > 1 THEN sha256(string_agg(digest, '' ORDER BY i)) ELSE any_value(digest) END AS digest
  FROM {name}{k} GROUP BY t, i // 16)""")
    return tables


def _fold_sql(start: str, levels: int, name: str, nodes: str) -> list[str]:
    """Tables ``name0`` (given, with row, t, i, folded, told) to ``name<levels>``, up the levels of ``nodes``."""
    tables = [f"{name}0 AS MATERIALIZED ({start})"]
    for k in range(levels):
        tables.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT f.row, f.t, any_value(f.i) // 16 AS i,
         CASE WHEN any_value(c.n) > 1
           THEN sha256(string_agg(CASE WHEN c.i = f.i THEN f.folded ELSE c.digest END, '' ORDER BY c.i))
           ELSE any_value(f.folded) END AS folded,
         any_value(f.told) || coalesce(string_agg(c.digest, '' ORDER BY c.i) FILTER (WHERE c.i <> f.i), '') AS told
  FROM {name}{k} f JOIN {nodes}{k} c ON c.t = f.t AND c.i // 16 = f.i // 16 GROUP BY f.row, f.t)""")
    return tables


def _leaf_sql(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    return "sha256(" + " || ".join(f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR) END" for c in fields) + ")"


_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: CRC-32 of a short ASCII text: a byte and seven zeros for eight steps.
_CRC = """xor(4294967295, list_reduce(
    list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''),
                 lambda c: [CAST(ascii(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
    lambda s, e: xor(xor(s, e) >> 1, (xor(s, e) & 1) * 3988292384)))"""
#: Levels that the SQL writes out: 16^4 rows of a source and 16^3 sources.
_LEVELS, _OVER = 4, 3


@query(
    "op11_merkle_manifest",
    "WITH " + ",\n".join([
        f"""leaves AS MATERIALIZED (
  SELECT doc_id, {_leaf_sql("text")} AS leaf, {_leaf_sql(_LOWER)} AS lowered, {_CRC} % 5 = 0 AS chosen,
         row_number() OVER () AS row, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS t,
         row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST) - 1 AS i,
         count(*) OVER (PARTITION BY source) AS n FROM documents)""",
        *_tree_sql("SELECT t, i, n, leaf AS digest FROM leaves", _LEVELS, "node"),
        *_tree_sql(f"SELECT 0 AS t, t AS i, count(*) OVER () AS n, digest FROM node{_LEVELS}", _OVER, "over"),
        *_fold_sql("SELECT row, t, i, CASE WHEN chosen THEN lowered ELSE leaf END AS folded, '' AS told FROM leaves", _LEVELS, "fold", "node"),
        *_fold_sql(f"SELECT row, 0 AS t, t AS i, folded, told FROM fold{_LEVELS}", _OVER, "high", "over"),
    ]) + f"""
SELECT l.doc_id, l.leaf, s.digest AS subroot, r.digest AS root, sha256(h.told) AS proof_sha256,
       h.folded AS folded_root, h.folded = r.digest AS verified
FROM leaves l JOIN node{_LEVELS} s ON s.t = l.t JOIN high{_OVER} h ON h.row = l.row CROSS JOIN over{_OVER} r""",
)
def op11(spark: SparkSession, folder: str) -> DataFrame:
    """Proofs of all documents against the root of the table, some of them tampered with."""
    return merkle.verified_manifest(table(spark, folder, "documents"))


_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""


@query(
    "op12_lexical_search",
    f"""WITH docs AS MATERIALIZED (
  SELECT doc_id, w, len(w) AS n FROM (SELECT doc_id, {_TERMS} AS w FROM documents) WHERE len(w) > 0),
whole AS (SELECT count(*) AS docs, sum(n)::BIGINT AS terms FROM docs),
asked AS MATERIALIZED (SELECT DISTINCT item_id, t FROM (SELECT item_id, unnest({_TERMS}) AS t FROM benchmark)),
counts AS MATERIALIZED (
  SELECT doc_id, n, t, count(*) AS tf FROM (SELECT doc_id, n, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, n, t),
weights AS (
  SELECT t, CAST(floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight
  FROM counts CROSS JOIN whole GROUP BY t),
impacts AS (
  SELECT doc_id, t, weight * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // terms))) AS impact
  FROM counts JOIN weights USING (t) CROSS JOIN whole),
scores AS (SELECT item_id, doc_id, sum(impact)::BIGINT AS score FROM asked JOIN impacts USING (t) GROUP BY item_id, doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50""",
)
def op12(spark: SparkSession, folder: str) -> DataFrame:
    """The 50 best documents of each benchmark item."""
    return lexical_search.search(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op13_covering_simhash")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    """Classes of documents whose fingerprints differ in two bits or fewer."""
    return covering.near_duplicates(table(spark, folder, "documents"))
