"""The subpackage's registered queries, with production parameters over whole tables, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontamination, fingerprint, html_text, katz, line_dedup, packing, quality, simhash, substring_dedup
from ._common import bounded_batches, crc_mod

#: The negative control conversation that op8 adds: texts made of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.score_corpus(_documents(spark, sf_dir))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(_documents(spark, sf_dir)).drop("kept_text")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, network)
    return scored.select(F.col("doc_id").cast("long").alias("doc_id"), (crc_mod(F.col("doc_id"), 5) == 0).alias("held_out"), "score", "predicted")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_documents(spark, sf_dir))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text"), 256).alias("kept_sha256"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_documents(spark, sf_dir))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprint_documents(_documents(spark, sf_dir))


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    control = spark.createDataFrame([(-7, 0, "user", CONTROL_TEXT), (-7, 1, "assistant", CONTROL_TEXT)], "conv_id bigint, turn bigint, role string, text string")
    return chat.conversation_digests(chat.format_turn_rows(rows.unionByName(control)))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_documents(spark, sf_dir), tokenizer_path(), with_ids=False).drop("ids")


QUERIES = {
    "op1_katz_scoring": op1,
    "op2_substring_dedup": op2,
    "op3_quality_classifier": op3,
    "op4_line_dedup": op4,
    "op5_simhash_near_dedup": op5,
    "op6_document_fingerprints": op6,
    "op7_decontamination": op7,
    "op8_chat_formatting": op8,
    "op9_html_extraction": op9,
    "op10_packing": op10,
}

_WORDS_SPACE = r"list_filter(regexp_split_to_array(coalesce({}, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"
_ASCII_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_OP7_WORDS = r"list_filter(regexp_split_to_array(" + _ASCII_LOWER + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '')"

ORACLE_SQL = {
    "op2_substring_dedup": rf"""
WITH w AS (SELECT doc_id, {_WORDS_SPACE.format("text")} AS words FROM documents),
win AS (SELECT doc_id, s, array_to_string(words[s:s + 19], ' ') AS seq FROM (SELECT doc_id, words, unnest(range(1, len(words) - 18)) AS s FROM w WHERE len(words) >= 20)),
firsts AS (SELECT seq, min((doc_id, s)) AS f FROM win GROUP BY seq),
dup AS (SELECT DISTINCT doc_id, unnest(range(s, s + 20)) AS p FROM win JOIN firsts USING (seq) WHERE (win.doc_id, win.s) > f),
gone AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM dup GROUP BY doc_id)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed,
  sha256(CASE WHEN n IS NULL THEN array_to_string(words, ' ') ELSE coalesce(array_to_string(list_filter(words, lambda x, i: NOT list_contains(ps, i)), ' '), '') END) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)""",
    "op4_line_dedup": rf"""
WITH l AS (SELECT doc_id, i, lines[i] AS line, {_ASCII_LOWER.format(r"regexp_replace(regexp_replace(lines[i], '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '')")} AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents))),
lost AS (SELECT key, max(doc_id) AS last FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT l.*, last IS NOT NULL AND doc_id <> last AS gone FROM l LEFT JOIN lost USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id""",
    "op7_decontamination": rf"""
WITH d AS (SELECT doc_id, {_OP7_WORDS.format("coalesce(text, '')")} AS words FROM documents),
b AS (SELECT item_id, words, least(len(words), 10) AS k FROM (SELECT item_id, {_OP7_WORDS.format("coalesce(text, '')")} AS words FROM benchmark) WHERE len(words) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(words[s:s + k - 1], ' ') AS seq FROM (SELECT item_id, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM b)),
occ AS (SELECT doc_id, s, k, array_to_string(words[s:s + k - 1], ' ') AS seq FROM (SELECT doc_id, words, k, unnest(range(1, len(words) - k + 2)) AS s FROM d, (SELECT DISTINCT k FROM win) WHERE len(words) >= k)),
hit AS (SELECT doc_id, s, k, item_id FROM occ JOIN win USING (k, seq)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + k)) AS p FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(words)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)""",
    "op8_chat_formatting": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))),
e AS (SELECT *, length(regexp_replace(text, '(\\|<\||</s>|<s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>)', '\1+', 'g')) AS escaped FROM c)
SELECT conv_id::BIGINT AS conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(12 + length(role) + 1 + escaped + 11)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
}
