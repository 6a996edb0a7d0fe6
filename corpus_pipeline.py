"""A corpus, stage by stage: what language ID accepts, without near copies, without benchmark text, mixed by source, as token files.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept, and returns documents with the columns
of `documents`; the last returns a row for each document of the token files it wrote. ORACLE_SQL is None, because SQL cannot express
language ID; tests/llm hold the pipeline against a plain version.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from trajspark.llm import decontaminate, jaccard_join, language_id, shared, source_mix, token_files
from trajspark.llm.queries import tokenizer_path


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return language_id.accepted(docs, language_id.fit(docs))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard_join.one_of_each(docs)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, shared.table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return source_mix.mixed(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "tokens")
    token_files.write_tokens(docs, path, tokenizer_path())
    return token_files.token_digest(token_files.read_tokens(spark, path))


STAGES = [
    ("language ID", identify_language),
    ("near copies", drop_near_copies),
    ("benchmark decontamination", drop_benchmark),
    ("source mix", mix),
    ("token files", write_tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = shared.table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES[:-1]):
        read, docs = docs, shared.settle(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if i:  # the first stage reads the input
            shared.discard(read)
    return STAGES[-1][1](spark, docs, sf_dir)
