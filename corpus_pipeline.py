"""A pipeline over the documents: quality, near-duplicates, benchmark leaks, personal data, tokens.

Every stage works on all rows that its predecessor kept; all but the last return the columns of
``documents``, whatever further ones there are and however they are called. Between stages the rows
are written as Parquet in the cluster's shared folder and read again; a stage's rows are removed
when the next one's are written, the last one's stay for the caller.

Defined results, stage by stage. Null and empty texts: scored as an empty text; kept by the
near-duplicate stage, as they are linked with nothing; without leaks; without personal data; no
tokens. Null ids: never a copy. Repeated rows: one stays, as do the smallest id of a group and, of
equal ids, one row. Very long texts are read whole. An empty table gives no rows at every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridreach.llm import bpe, decontaminate, neardup, pii, quality
from gridreach.llm.common import fresh, table
from gridreach.plans.checkpoints import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores below 0.5 go."""
    model, score = quality.train(docs, table(spark, sf_dir, "labels")), fresh(docs.columns, "score")
    return quality.score(docs, model, score).filter(F.col(score) >= 0.5).drop(score)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the smallest id."""
    return neardup.drop_copies(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaked passages are cut out; documents that are mostly leaked go."""
    return decontaminate.remove_leaks(docs, table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and the ids of the text's byte-level BPE."""
    return bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES = [
    ("quality", quality_stage), ("near_duplicates", dedup_stage), ("decontamination", decontamination_stage), ("pii", pii_stage), ("byte_bpe", token_stage),
]

#: SQL can't express the classifier and the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in turn, applied to ``documents``."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        if i:
            before = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{i - 1}")
            before.getFileSystem(spark._jsc.hadoopConfiguration()).delete(before, True)
    return docs
