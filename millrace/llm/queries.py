"""The queries opN_<name> and, where SQL can say the same, their DuckDB SQL.

Each takes (spark, sf_dir), applies its operator to the whole table and derives the columns of its contract.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.llm import best_fit_packing, byte_bpe, chat_format, exact_dedup, language_id, quality_rules, simhash_dedup, suffix_dedup, token_counts, toxicity
from millrace.llm.common import read, texts


def op1_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_dedup.simhash_groups(read(spark, sf_dir, "documents"), shingle=3, max_bits=2, seed=42)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
    coded = byte_bpe.decode(byte_bpe.encode(read(spark, sf_dir, "documents"), ranks, pattern), ranks, pattern)
    decimal = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(decimal, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def held_out() -> Column:
    """A fifth of the documents, by the checksum of their id, is kept from learning; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    langs, model = language_id.train(docs.where(~held_out()).select("text", "lang"))
    return language_id.predict(docs, langs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "mixture")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels")
    rows = texts(docs).where(~held_out())
    model = toxicity.train(toxicity.sample(rows, labels.where(~held_out()).select("doc_id", F.col("toxic").alias("label"))))
    return toxicity.score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"])
    return done.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = "\\### Assistant: </turn> ok"
    own = spark.sql("SELECT -7L AS conv_id, turn, role, :text AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)", args={"text": planted})
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    # a conversation is a tree with one branch: each turn replies to the one before
    id_ = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    nodes = rows.select(F.col("conv_id").alias("tree_id"), id_.alias("id"), "role", "text")
    chat = chat_format.format_trees(nodes.withColumns({"parent": F.col("id") - 1, "score": F.lit(0.0)}))
    turns, loss = chat_format.parse(F.col("formatted")), chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    read_back = chat.select(F.col("tree_id").alias("conv_id"), turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP6_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
l AS (SELECT *, len(text) + len(regexp_extract_all(text, '[\\#<]')) + len(role) + len(regexp_extract_all(role, '[\\#<:]')) + 14 AS chars FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(len(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM l GROUP BY conv_id
"""


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(read(spark, sf_dir, "documents"))


OP7_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY norm) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY norm) AS kept, sha256(norm) AS text_sha256
FROM d
"""


def packed(docs: DataFrame) -> DataFrame:
    """Op 8 over any documents; digests are taken where the ids are, so that ids need no shuffle."""
    pieces = best_fit_packing.tokenize_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=4096, end_id=1)
    slim = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return best_fit_packing.pack(slim, docs.count(), capacity=4096)


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(read(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_R = quality_rules.Rules()
OP9_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
starts AS (SELECT doc_id, words, unnest(range(1, len(words) - {_R.window - 2})) AS i FROM w WHERE len(words) >= {_R.window}),
wins AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, words[i:i + {_R.window - 1}]) AS c FROM starts),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + {_R.window})) AS p FROM wins WHERE c > 1) GROUP BY doc_id),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
sized AS (SELECT doc_id, line, len(regexp_replace(line, '[\x20\x09-\x0D]+', '', 'g')) AS chars FROM lines),
per_line AS (
  SELECT doc_id, count(*) FILTER (chars > 0) - count(DISTINCT line) FILTER (chars > 0) AS dup,
    coalesce(sum(chars) FILTER (
      (len(line) - len(regexp_replace(line, '[#*$%&|<>]', '', 'g'))) * 100 > chars * {_R.max_line_symbol_percent}
      OR len(regexp_extract_all(line, '[|»›•]')) + 1 >= {_R.min_navigation_fields}
      OR NOT regexp_matches(line, '[\p{{L}}\p{{N}}]')
      OR chars <= {_R.max_boilerplate_chars} AND regexp_matches(line, '(?i){_R.phrases()}')), 0) AS lost
  FROM sized GROUP BY doc_id),
base AS (
  SELECT w.doc_id, len(words)::BIGINT AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0) AS lost
  FROM w LEFT JOIN covered USING (doc_id) LEFT JOIN per_line USING (doc_id)),
failed AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.max_repeat_percent} * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND 100 * lost <= {_R.max_lost_percent} * word_chars AS kept
FROM failed
"""

def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_simhash_dedup": op1_simhash_dedup,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_chat_format": op6_chat_format,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_best_fit_packing": op8_best_fit_packing,
    "op9_quality_rules": op9_quality_rules,
    "op10_token_counts": op10_token_counts,
}
ORACLE_SQL: dict[str, str] = {
    "op6_chat_format": OP6_SQL,
    "op7_exact_dedup": OP7_SQL,
    "op9_quality_rules": OP9_SQL,
}
