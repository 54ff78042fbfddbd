"""A corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, token files.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns the rows that go on.
Every stage but the last returns the columns of documents; its result is written as a Parquet table,
which the next stage reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nitraflow.llm import decontaminate, jaccard_join, mixing, quality_rules
from nitraflow.llm.frames import shared_folder
from nitraflow.llm.queries import token_digest


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go."""
    return quality_rules.keep_by_rules(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return jaccard_join.keep_one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontaminate.without_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: a row for each piece of a document that a slot takes."""
    mixed = mixing.mix_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files of the mix, read back: where each row's ids start, how many, and their checksum."""
    return token_digest(docs)


STAGES = [("quality rules", quality), ("n-gram Jaccard join", near_duplicates), ("benchmark decontamination", decontamination), ("mixing sources", mix), ("token files", tokens)]

#: The hashes, permutations and tokenizer of the stages aren't SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            path = f"{shared_folder(spark)}/stage-{i}-{uuid.uuid4().hex}"
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
