"""The corpus pipeline: five stages over `documents`, each on all that the one before kept.

A stage takes (spark, docs, sf_dir). What it returns is written as Parquet in the shared folder and read again for the next
stage, so a lost executor costs at most the stage that runs. All but the last return the columns of docs: rejected documents
are gone, of linked documents the one with the least id stays, documents with benchmark passages are gone, and secrets are
overwritten in the texts. The last returns doc_id, lang, source and the ids of every document that is left, with digests.
Nulls, empty texts, repeated rows, empty tables and other columns are handled as each operator's module says.
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from scoutlake.llm import bpe, decontaminate, jaccard, quality_rules, secrets, shared


#: What the last stage wrote for itself.
_left: list[str] = []


def fresh(stage):
    """A stage that first deletes what the one before it wrote for itself: docs is a table of its own by then."""

    @functools.wraps(stage)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        shared.discard(spark, _left)
        before = shared.made()
        out = stage(spark, docs, sf_dir)
        _left[:] = shared.made_since(before)
        return out

    return run_stage


@fresh
def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality_rules.good_documents(docs)


@fresh
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.one_of_each(docs)


@fresh
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@fresh
def secrets_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


@fresh
def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encoded(docs, bpe.vocabulary_path(), keep=[c for c in ("doc_id", "lang", "source") if c in docs.columns])


STAGES = [
    ("quality rules", quality_rules_stage),
    ("n-gram Jaccard join", near_duplicates_stage),
    ("benchmark decontamination", decontamination_stage),
    ("secret scans", secrets_stage),
    ("BPE encoding and decoding", encoding_stage),
]

#: The last stage's merges and the second's components are not for SQL; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = shared.written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
