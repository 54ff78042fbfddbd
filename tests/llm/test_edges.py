"""Every operator takes nulls in any column, empty and very long texts, repeated rows, empty tables and extra columns with names of its own."""

import hashlib
import uuid

import public_tokenizers
import pytest
from conftest import AWKWARD
from pyspark.sql import functions as F

import corpus_pipeline
from nitraflow.llm import bpe, collocations, decontaminate, hmm_lm, jaccard_join, license_scan, line_dedup, mil_quality, mixing, quality_rules, secret_scan, token_alignment, token_files

NAMES = "text_hash own_id gone row ref sid start size source_size target taken takes block hash line node root part set_id component_id raw plain template train rid ids local_start n_tokens held_out score keys grp tile value".split()
ITEM = "the quick brown fox jumps over the lazy dog while seven small birds watch from an old oak tree nearby"


@pytest.fixture(scope="module")
def awkward(docs_of):
    texts = [*AWKWARD, ITEM, ITEM, "some line of four words\n" * 3 + "w " * 60_000]
    df = docs_of(texts).withColumn("doc_id", F.when(F.col("doc_id") != 5, F.col("doc_id"))).withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.col("source")))
    df = df.unionByName(df.where("doc_id in (0, 3, 11)"))
    return df.withColumns({n: F.lit(f"own {n}") for n in NAMES}).repartition(3)


def operators(spark, items, tmp):
    """{name: (function of documents, whether it keeps every row)}"""

    def tokens(df):
        path = f"{tmp}/{uuid.uuid4().hex}"
        token_files.write_token_files(df, path, public_tokenizers.path("byte_bpe_50k.json"))
        return token_files.with_checksum(token_files.read_tokens(spark, path))

    labels = spark.createDataFrame([(0, 1), (3, 0), (11, 1), (None, 1), (3, 0)], "doc_id long, quality int")
    return {
        "mix_counts": (mixing.mix_counts, True), "mix_documents": (mixing.mix_documents, False),
        "jaccard_components": (jaccard_join.jaccard_components, True), "keep_one_of_each": (jaccard_join.keep_one_of_each, False),
        "scan_secrets": (secret_scan.scan_secrets, True), "contaminated": (lambda df: decontaminate.contaminated(df, items), False),
        "without_benchmark": (lambda df: decontaminate.without_benchmark(df, items), False), "dedup_lines": (line_dedup.dedup_lines, True),
        "tokens": (tokens, True), "quality": (lambda df: mil_quality.score_quality(df, mil_quality.fit_quality(df, labels)), True),
        "hmm": (lambda df: hmm_lm.hmm_scores(df, F.col("doc_id") % 2 == 0, settings=hmm_lm.HmmSettings(rounds=1)), True),
        "licenses": (lambda df: license_scan.scan_licenses(df, license_scan.fit_licenses(df, settings=license_scan.LicenseSettings(epochs=3, copies=4))), True),
        "align": (lambda df: token_alignment.alignment_scores(df, token_alignment.AlignSettings(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))), True),
        "align_texts": (lambda df: token_alignment.align_texts(df, token_alignment.AlignSettings(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))), True),
        "phrases": (lambda df: collocations.collocations(df, collocations.PhraseRules(support=3)), False),
        "bpe": (lambda df: bpe.encode_texts(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), True),
        "round_trip": (lambda df: bpe.round_trip(df, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN), True),
        "rules": (quality_rules.repetition_coverage, True), "keep_by_rules": (quality_rules.keep_by_rules, False),
    }


OPERATORS = "mix_counts mix_documents jaccard_components keep_one_of_each scan_secrets contaminated without_benchmark dedup_lines tokens quality hmm licenses align align_texts phrases bpe round_trip rules keep_by_rules".split()


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows_and_empty_tables(spark, awkward, tmp_path, name):
    items = spark.createDataFrame([(1, ITEM), (None, ITEM), (2, None), (3, "")], "item_id long, text string")
    run, every = operators(spark, items, tmp_path)[name]
    n = awkward.count()
    rows = run(awkward).collect()
    assert len(rows) == n if every else name in ("mix_documents", "phrases") or len(rows) <= n
    held = {r["text"]: r for r in rows if "text" in r}
    if name == "rules":
        assert held[None]["quality"]["n_words"] == held[""]["quality"]["n_words"] == 0 and not held[None]["quality"]["kept"] and held[ITEM]["quality"]["kept"] == (len(ITEM.split()) >= 20)
    if name == "bpe":
        assert held[None]["tokens"]["n_tokens"] == 0 and held["word"]["tokens"]["n_tokens"] == 1 and len(held["x" * 100_000]["tokens"]["ids"]) == held["x" * 100_000]["tokens"]["n_tokens"]
    if name == "round_trip":
        assert held[None]["coded"]["ids_sha256"] == held[""]["coded"]["decoded_sha256"] and held[ITEM]["coded"]["decoded_sha256"] == hashlib.sha256(ITEM.encode()).hexdigest()
    if name == "align_texts":
        assert held[None]["alignment"]["links"] == [] and len(held["word"]["alignment"]["groups"]) == 1
    if name == "align":
        assert sum(r["n_a"] == 0 for r in rows) == sum(not r["text"] for r in awkward.select("text").collect()) and all(r["n_links"] >= max(r["n_a"], r["n_b"]) for r in rows)
    if name == "phrases":
        assert {r["lang"] for r in rows} == {"en"} and {r["phrase"]: r["a"] for r in rows}["a b c a"] == 19_999
    if name == "scan_secrets":
        assert all(r["secrets"]["spans"] == [] for r in rows)
    if name == "licenses":
        assert all(r["licenses"]["hits"] == [] for r in rows) and held[None]["licenses"]["n_segments"] == 0
    if name == "quality":
        assert all(0 <= r["quality"]["score"] <= 1 for r in rows)
    if name == "tokens":
        assert sorted(r["start"] for r in rows)[0] == 0 and sum(r["n_tokens"] for r in rows) == max(r["start"] + r["n_tokens"] for r in rows)
    if name in ("without_benchmark", "keep_one_of_each", "dedup_lines", "keep_by_rules"):
        assert set(rows[0].asDict()) == set(awkward.columns) if rows else name == "keep_by_rules"
    if name == "without_benchmark":
        assert len(rows) == n - 3 and not any(r["text"] == ITEM for r in rows)
    if name == "keep_one_of_each":
        assert sum(r["text"] == ITEM for r in rows) == 1 and sum(r["doc_id"] is None for r in rows) == sum(r["doc_id"] is None for r in awkward.collect())
    assert run(awkward.limit(0)).count() == 0


def test_pipeline_takes_awkward_and_empty_tables(spark, awkward, tmp_path):
    for label, df in (("awkward", awkward.drop(*NAMES)), ("empty", awkward.drop(*NAMES).limit(0))):
        df.write.parquet(f"{tmp_path}/{label}/documents.parquet")
        spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/{label}/benchmark.parquet")
        found = {r["doc_id"] for r in corpus_pipeline.run(spark, f"{tmp_path}/{label}").collect()}
        assert found <= {r["doc_id"] for r in df.select("doc_id").collect()} and (label == "awkward" or not found)
