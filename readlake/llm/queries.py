"""Queries of this package: whole tables, production parameters, the columns of each contract."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality
from .bpe import roundtrip
from .common import documents
from .embedding_dedup import cosine_classes
from .exact_dedup import exact_dedup
from .packing import fast_encoder, packed
from .permutation_index import neighbours
from .preferences import preference_pairs
from .sharding import sharded
from .simhash import simhash_classes
from .substring_dedup import MIN_UNIT, repeated_spans
from .toxicity import fit, held_out, scored
from .vector_codes import ENTRIES, PARTS, ROUNDS, SCALE, vector_codes


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(packed(documents(spark, sf_dir), public_encoder, release=fast_encoder.cache_clear))


def piece_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum in place of their ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")


def public_encoder():
    """The 50k byte-level vocabulary."""
    return fast_encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS cp,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), k AS (
  SELECT doc_id, norm, count(*) OVER (PARTITION BY norm) AS group_size,
         first_value(doc_id) OVER (PARTITION BY norm ORDER BY cp DESC, doc_id) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(documents(spark, sf_dir), 16)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_spans(documents(spark, sf_dir), line_words=MIN_UNIT).drop("text_key")


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_classes(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, vectors = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return scored(vectors, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op7_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cosine_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = roundtrip(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    ratings = labels.filter(~held_out(F.col("doc_id"))).select("doc_id", quality.grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return quality.graded(docs, quality.fit(docs, ratings)).withColumn("held_out", held_out(F.col("doc_id")))


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2k (chosen) and 2k + 1 (rejected) are a pair."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    pairs = preference_pairs(turns.select(F.shiftright("conv_id", 1).alias("pair_id"), (F.col("conv_id").bitwiseAND(F.lit(1)) == 0).alias("chosen"), "turn", "role", "text"))
    spans = lambda mask: F.array_join(F.transform(mask, lambda m: F.concat_ws("-", m["start"].cast("string"), m["stop"].cast("string"))), ",")
    return pairs.withColumn("chosen_mask", spans("chosen_mask")).withColumn("rejected_mask", spans("rejected_mask"))


OP10_SQL = r"""
WITH t AS (
  SELECT conv_id >> 1 AS pair_id, conv_id & 1 = 0 AS c, coalesce(turn, -1) AS turn, coalesce(role, 'unknown') AS role,
         regexp_replace(coalesce(text, ''), '<\|(im_start|im_end)\|>', '<\\|\1|>', 'g') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), n AS (
  SELECT *, row_number() OVER (PARTITION BY pair_id, c ORDER BY turn, role, text) AS i FROM t
), d AS (
  SELECT coalesce(a.pair_id, b.pair_id) AS pair_id, coalesce(a.i, b.i) AS i,
         coalesce(a.role = b.role AND a.text = b.text, false) AS same
  FROM (SELECT * FROM n WHERE c) a FULL JOIN (SELECT * FROM n WHERE NOT c) b ON a.pair_id = b.pair_id AND a.i = b.i
), k AS (
  SELECT pair_id, coalesce(min(i) FILTER (WHERE NOT same) - 1, max(i)) AS k FROM d GROUP BY pair_id
), s AS (
  SELECT n.*, k.k, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) AS shown FROM n JOIN k USING (pair_id)
), m AS (
  SELECT *, coalesce(sum(length(shown)) FILTER (WHERE i > k) OVER (PARTITION BY pair_id, c ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s
), f AS (
  SELECT *, CASE WHEN i > k AND role = 'assistant'
    THEN CAST(before + 13 + length(role) AS BIGINT) || '-' || CAST(before + 13 + length(role) + length(text) + 10 AS BIGINT) END AS span
  FROM m
)
SELECT pair_id,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE c AND i <= k), '') AS prompt,
  CAST(any_value(k) AS INTEGER) AS prompt_turns,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE c AND i > k), '') AS chosen,
  coalesce(string_agg(shown, '' ORDER BY i) FILTER (WHERE NOT c AND i > k), '') AS rejected,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE c), '') AS chosen_mask,
  coalesce(string_agg(span, ',' ORDER BY i) FILTER (WHERE NOT c), '') AS rejected_mask,
  bool_or(c) AND bool_or(NOT c) AND count(span) > 0 AS usable
FROM f GROUP BY pair_id
"""


def op11_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes(spark.read.parquet(f"{sf_dir}/embeddings.parquet")).drop("label")


def _op12_sql() -> str:
    """The rounds written out: assignment by exact whole numbers, then the floors of the means."""
    rounds = [f"""k AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda e: CAST(floor(CAST(e AS DOUBLE) * {SCALE}) AS BIGINT)) AS x
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, g AS part, x[g * (len(x) // {PARTS}) + 1 : (g + 1) * (len(x) // {PARTS})] AS v FROM k, range({PARTS}) r(g)
), b0 AS MATERIALIZED (
  SELECT part, row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS entry, v AS c FROM p WHERE vec_id IN (SELECT vec_id FROM k ORDER BY vec_id LIMIT {ENTRIES})
)"""]  # fmt: skip
    for r in range(ROUNDS + 1):
        rounds.append(f"""a{r} AS MATERIALIZED (
  SELECT vec_id, part, any_value(v) AS v, min(CAST(list_inner_product(CAST(v AS DOUBLE[]), CAST(v AS DOUBLE[])) - 2 * list_inner_product(CAST(v AS DOUBLE[]), CAST(c AS DOUBLE[])) + list_inner_product(CAST(c AS DOUBLE[]), CAST(c AS DOUBLE[])) AS BIGINT) * {ENTRIES} + entry) AS m
  FROM p JOIN b{r} USING (part) GROUP BY vec_id, part
)""")
        if r < ROUNDS:
            rounds.append(f"""n{r} AS MATERIALIZED (
  SELECT part, entry, list(c ORDER BY i) AS c FROM (
    SELECT part, m % {ENTRIES} AS entry, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS c FROM (SELECT *, unnest(range(1, len(v) + 1)) AS i FROM a{r}) GROUP BY ALL
  ) GROUP BY part, entry
), b{r + 1} AS MATERIALIZED (
  SELECT part, entry, coalesce(n{r}.c, b{r}.c) AS c FROM b{r} LEFT JOIN n{r} USING (part, entry)
)""")
    return f"""WITH {', '.join(rounds)}, f AS (
  SELECT vec_id, string_agg(format('{{:02x}}', m % {ENTRIES}), '' ORDER BY part) AS code, CAST(sum(m // {ENTRIES}) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(CAST(c AS VARCHAR[]), ','), ',' ORDER BY part, entry)) FROM b{ROUNDS}) AS codebooks_sha256
FROM f JOIN k USING (vec_id)"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_packing": op1_packing,
        "op2_exact_dedup": op2_exact_dedup,
        "op3_sharding": op3_sharding,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_simhash": op5_simhash,
        "op6_toxicity": op6_toxicity,
        "op7_embedding_dedup": op7_embedding_dedup,
        "op8_byte_bpe": op8_byte_bpe,
        "op9_quality": op9_quality,
        "op10_preferences": op10_preferences,
        "op11_permutation_index": op11_permutation_index,
        "op12_vector_codes": op12_vector_codes,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_exact_dedup": OP2_SQL, "op10_preferences": OP10_SQL, "op12_vector_codes": _op12_sql()}
