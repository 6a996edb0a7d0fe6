"""The queries of this subpackage: each applies its operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, ball_kmeans, decontaminate, jaccard_join, language_id, license_scan, personal_data, reply_trees, secret_scan, shared, source_mix, spelling_variants, substring_dedup, token_files
from .shared import table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secret_digest(secret_scan.secret_scan(table(spark, sf_dir, "documents")))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.where("vec_id % 20 = 0"))


def op5_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = reply_trees.with_control_case(table(spark, sf_dir, "conversations"))
    return reply_trees.chat_digest(reply_trees.format_branches(reply_trees.linear(rows)))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = language_id.fit(docs.where(~held_out))
    found = language_id.identify(docs, model)
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "tokens")
    token_files.write_tokens(table(spark, sf_dir, "documents"), path, tokenizer_path())
    return token_files.token_digest(token_files.read_tokens(spark, path))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op10_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = source_mix.mix_sources(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", F.get("source_sizes", F.lit(0)).alias("source_size"), F.get("targets", F.lit(0)).alias("target"), "taken")


def op11_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.personal_digest(personal_data.personal_data(table(spark, sf_dir, "documents")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.ball_kmeans(table(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (op1_secret_scan, op2_license_scan, op3_jaccard_join, op4_ann, op5_reply_trees, op6_decontaminate, op7_language_id, op8_token_files, op9_substring_dedup, op10_source_mix, op11_personal_data, op12_spelling_variants, op13_ball_kmeans)
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    return {
        "op3_jaccard_join": jaccard_join.ORACLE,
        "op4_ann": ann.ORACLE,
        "op5_reply_trees": reply_trees.ORACLE,
        "op9_substring_dedup": substring_dedup.ORACLE,
        "op10_source_mix": source_mix.ORACLE,
        "op12_spelling_variants": spelling_variants.ORACLE,
        "op13_ball_kmeans": ball_kmeans.ORACLE,
    }
