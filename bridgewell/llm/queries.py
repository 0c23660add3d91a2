"""The registered queries of this subpackage: each takes (spark, sf_dir) and applies one operator to whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, interpolation, lexical, media, mixing, neighbours, quality, resampling, simhash, substrings, tokenfiles, toxicity
from .memory import small_batches


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    coded = bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary_path(), public_tokenizers.PATTERN)
    return coded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.train(docs, table(spark, sf_dir, "labels"), quality.learns(5, 0))
    return quality.score(docs, model).select(
        "doc_id", (~quality.learns(5, 0)).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), mixing.standard_path(), mixing.WEIGHTS, mixing.FRACTION)


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    learn = quality.learns(7, 2)
    found = interpolation.score(table(spark, sf_dir, "documents"), learn)
    return found.select("doc_id", (~learn).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op7_audio_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.find_excerpts(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    index = toxicity.train(docs, table(spark, sf_dir, "labels"), quality.learns(3, 1))
    return toxicity.score(docs, index).select(
        "doc_id", (~quality.learns(3, 1)).alias("held_out"), "score", (F.col("score") >= toxicity.THRESHOLD).cast("int").alias("predicted"),
        F.size("evidence").alias("n_evidence"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    back = chat.read_back(chat.format_conversations(turns)).select(
        "*", F.size("turns").cast("long").alias("n_back"), F.sha2(whole, 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    kept = ["n_back", "turns_sha256", "formatted_chars"]
    examples = chat.expand_examples(back, kept, outer=True).select("conv_id", *kept, F.when(F.col("target_start").isNotNull(), F.struct("target_start", chat.target().alias("text"))).alias("reply"))
    folded = examples.groupBy("conv_id", *kept).agg(F.sort_array(F.collect_list("reply")).alias("replies"))
    lost = F.array_join(F.transform("replies", lambda r: r["text"]), "")
    return folded.select(
        "conv_id", F.col("n_back").alias("n_turns"), "turns_sha256", F.length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), "formatted_chars")


def op10_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    folder = tokenfiles.save(table(spark, sf_dir, "documents"), str(public_tokenizers.path("word_bpe_49k.json")), 1)
    return tokenfiles.load(spark, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), e AS (
  SELECT *, length(role) + length(text) + 11
    + (length(role || text) - length(replace(replace(replace(role || text, '\', ''), '<', ''), '[', '')))
    + (length(role) - length(replace(role, ']', ''))) AS shown
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(shown) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

# DuckDB has no checksum of this kind: bytes go through a table of 256 entries, made by its rule, once for each distinct word.
OP11_SQL = r"""
WITH RECURSIVE bits AS (
  SELECT range AS i, 0 AS k, range AS c FROM range(256)
  UNION ALL SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8
), steps AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8
), words AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), kinds AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * octet_length(encode(w)), 2), lambda j: CAST('0x' || substr(hex(encode(w)), j, 2) AS BIGINT))),
    lambda c, b: xor(c // 256, t[CAST(xor(c % 256, b) + 1 AS BIGINT)])), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT w FROM words), steps
), n AS (
  SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM words JOIN kinds USING (w) GROUP BY bucket
), gain AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1) * ((SELECT sum(s) FROM n) + 10000))::DOUBLE / ((s + 1) * ((SELECT sum(t) FROM n) + 10000))::DOUBLE)) AS BIGINT) AS gain FROM n
), weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(sum(gain) AS BIGINT) AS weight FROM words JOIN kinds USING (w) JOIN gain USING (bucket) WHERE side = 0 GROUP BY doc_id
), scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM documents LEFT JOIN weights USING (doc_id)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (n_features >= 20) OVER () AS n FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank FROM placed
"""

OP13_SQL = r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM documents
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS w FROM benchmark
), sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id
), whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes
), tf AS (SELECT doc_id, w, count(*) AS tf FROM words GROUP BY doc_id, w
), weights AS (SELECT w, CAST(floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS weight FROM tf, whole GROUP BY w, docs
), parts AS (
  SELECT doc_id, w, weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms))) AS part FROM tf JOIN sizes USING (doc_id) JOIN weights USING (w), whole
), scores AS (SELECT item_id, doc_id, CAST(sum(part) AS BIGINT) AS score FROM asked JOIN parts USING (w) GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""

QUERIES = {"op1_byte_bpe": op1_byte_bpe, "op2_substring_dedup": op2_substring_dedup, "op3_quality_classifier": op3_quality_classifier, "op4_simhash": op4_simhash, "op5_source_mix": op5_source_mix,
    "op6_lm_score": op6_lm_score, "op7_audio_alignment": op7_audio_alignment, "op8_toxicity": op8_toxicity,
    "op9_chat_format": op9_chat_format, "op10_inverted_multi_index": op10_inverted_multi_index,
    "op11_importance_resampling": op11_importance_resampling, "op12_token_files": op12_token_files,
    "op13_lexical_search": op13_lexical_search}
ORACLES = {"op9_chat_format": OP9_SQL, "op11_importance_resampling": OP11_SQL, "op13_lexical_search": OP13_SQL}
