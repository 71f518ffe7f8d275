"""The queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from barloom.llm import chat, minhash, packing, pii, sentencepiece_codec, simhash, suffix_array, token_counts, topk, toxicity
from barloom.llm.common import secret_key, table


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", odd), (-7, 1, "assistant", odd)], "conv_id long, turn long, role string, text string")
    return chat.chat_digest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.codec_digest(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_chat_format, op2_token_counts, op3_sentencepiece, op5_packing)
}
_ODD = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace({0}, '\', '\b'), '##', '\h'), '</turn>', '\t')"
_LABEL = "CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 ELSE 1 + length(replace(" + _ESCAPED.format("role") + r", ':', '\c')) END"
SQL: dict[str, str] = {
    # Digests of the rows themselves: what is read back from the output must be the same.
    "op1_chat_format": f"""WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, 0, 'user', '{_ODD}' UNION ALL SELECT -7, 1, 'assistant', '{_ODD}'),
 o AS (SELECT *, row_number() OVER w AS i, coalesce(lag(role) OVER w, 'start') AS before FROM c WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
 m AS (SELECT *, concat(before, '>', role) NOT IN ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') AS bad, 14 + {_LABEL} + length({_ESCAPED.format('text')}) AS chars FROM o)
 SELECT conv_id, count(*) AS n_turns, sha256(string_agg(concat(role, chr(10), text, chr(10)), '' ORDER BY i)) AS turns_sha256, cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256, cast(sum(chars) AS BIGINT) AS formatted_chars, count(*) FILTER (bad) = 0 AND arg_max(role, i) = 'assistant' AS valid,
 cast(coalesce(min(i - 1) FILTER (bad), -1) AS INTEGER) AS bad_turn FROM m GROUP BY conv_id""",
    # Every query against every vector.
    "op7_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings WHERE vec_id IS NOT NULL AND len(embedding) > 0
 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
 s AS (SELECT q.vec_id AS query_id, c.vec_id, cast(list_inner_product(q.v, c.v) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s) SELECT query_id, cast(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 20""",
}


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=4, percent=80)


QUERIES["op4_minhash"] = op4_minhash


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.removal_digest(table(spark, sf_dir, "documents"))


QUERIES["op6_suffix_array"] = op6_suffix_array


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


QUERIES["op7_topk"] = op7_topk


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.edited_likeness(table(spark, sf_dir, "documents"))


QUERIES["op9_simhash"] = op9_simhash


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES["op10_toxicity"] = op10_toxicity


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.pii_report(table(spark, sf_dir, "documents"), secret_key(spark))


QUERIES["op8_pii"] = op8_pii
