"""The registered queries of this subpackage, each over its whole table, and the SQL of those that SQL can express."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, decontaminate, hmm_lm, jaccard_join, license_scan, line_dedup, mil_quality, mixing, oracles, quality_rules, secret_scan, token_alignment, token_files
from .frames import hash_part, shared_folder


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_counts(_documents(spark, sf_dir), settings=mixing.MixSettings(block_words=128))


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(_documents(spark, sf_dir), settings=jaccard_join.JaccardSettings(n=3, percent=90))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = secret_scan.GuessRules(vocabulary=public_tokenizers.path("byte_bpe_50k.json"))
    found = secret_scan.scan_secrets(_documents(spark, sf_dir).select("doc_id", "text"), rules=rules)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    spans = F.col("secrets.spans")
    return found.select(
        "doc_id", *[F.col(f"secrets.n_{k}").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(joined(F.filter(spans, lambda s: s["kind"] != "guess")), 256).alias("base_sha256"), joined(spans).alias("spans"), F.col("secrets.n_guess").alias("n_guess"),
    )


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    gone = ~F.col("kept")
    counts = line_dedup.line_groups(docs).groupBy("doc_id").agg(F.count("*").alias("n_lines"), F.sum(gone.cast("long")).alias("n_removed"), F.sum((gone & ~F.col("exact")).cast("long")).alias("n_removed_fuzzy"))
    return docs.select("doc_id").join(counts, "doc_id", "left").fillna(0)


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digest(_documents(spark, sf_dir))


def token_digest(docs: DataFrame) -> DataFrame:
    """Writes the token files of docs and reads them back as doc_id, start, n_tokens and ids_crc32."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/token-files-{uuid.uuid4().hex}"
    token_files.write_token_files(docs, path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.with_checksum(token_files.read_tokens(spark, path))


def op7_mil_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    part = F.coalesce(hash_part("doc_id", 3) == 1, F.lit(False))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~part)
    model = mil_quality.fit_quality(docs, labels)
    score = F.col("quality.score")
    return mil_quality.score_quality(docs, model).select("doc_id", part.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"), F.col("quality.n_passages").alias("n_passages"))


def op8_hmm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.coalesce(hash_part("doc_id", 5) == 1, F.lit(False))
    scored = hmm_lm.hmm_scores(_documents(spark, sf_dir), ~part)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    found = license_scan.scan_licenses(docs, license_scan.fit_licenses(docs))
    hits = F.col("licenses.hits")
    families = F.array_join(F.array_sort(F.array_distinct(F.transform(hits, lambda h: h["family"]))), ",")
    return found.select("doc_id", F.col("licenses.n_segments").alias("n_segments"), F.size(hits).cast("long").alias("n_notices"), families.alias("families"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    measured = quality_rules.repetition_coverage(_documents(spark, sf_dir).select("doc_id", "text"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return measured.select("doc_id", *[F.col(f"quality.{c}").alias(c) for c in names])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    settings = token_alignment.AlignSettings(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    return token_alignment.alignment_scores(_documents(spark, sf_dir).select("doc_id", "text"), settings)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_documents(spark, sf_dir))


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.round_trip(_documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select("doc_id", "coded.*")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_mix_sources, op2_jaccard_join, op3_secret_scan, op4_decontaminate, op5_line_dedup, op6_token_files, op7_mil_quality, op8_hmm_scores, op9_license_scan, op10_quality_rules, op11_token_alignment, op12_collocations, op13_byte_bpe)}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
