"""From raw documents to packed training sequences, in five stages.

Every stage reads what its predecessor wrote and passes on documents with the columns of ``documents``; the last
returns packed pieces. ``run`` writes each stage's result as Parquet to the session's shared folder and reads it again,
so that no stage is computed twice and lost executors cost no more than a stage. A stage may be given a result only after
that was written: where it starts, what its predecessor staged on the way is deleted, and its shuffle files are let go.

All stages keep every column under any name, dots included. Null texts: the language stage rejects them, as it does
texts without a letter, and the later stages pass them on. Ties of near-duplicates go to the least doc_id; repeated rows
share one fate there and are packed each for itself. Texts of any length are read whole. An empty table passes through
all stages as an empty table. With no usable language label nothing can be identified, and the first stage keeps all
documents that have a letter.
"""

from __future__ import annotations

import functools
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrail.llm import common, op1_mixing, op5_superminhash, op6_language, op8_pii, op9_packing

#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5


def stage(fn: Callable) -> Callable:
    """A stage that starts by clearing away what the stage before it staged."""

    @functools.wraps(fn)
    def start(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        with common.stage(spark):
            common.small_batches(spark)
            return fn(spark, docs, sf_dir)

    return start


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that is known well enough, go."""
    return op6_language.accepted(docs)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, by shingles of five words, the document with the least doc_id stays."""
    return op5_superminhash.deduplicated(docs, SHINGLE)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets are replaced by their kind; every document stays."""
    return op8_pii.redacted(docs)


@stage
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in training order."""
    return op1_mixing.curriculum(docs)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of token ids, each a piece of one document."""
    return op9_packing.pack(docs, keep_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("mixing", mixing),
    ("packing", packing),
]

#: Naive Bayes, minimum hashes, graph scores and a tokenizer are beyond SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. The written result stays in the shared folder; those of earlier stages go."""
    docs = common.table(spark, sf_dir, "documents")
    folder = f"{common.shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    before = None
    for k, (name, each) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        each(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            common.delete(spark, before)
        before = path
    with common.stage(spark):
        return docs
