"""A corpus pipeline of five operators: toxic documents go, of near copies one stays, contaminated documents go, secrets
are masked, and what is left is encoded and decoded.

Every stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame; all but the
last return the columns of ``documents``. Side tables (labels, benchmark) are read from ``sf_dir``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from pulsegrid.llm import bpe, decontamination, secret_scan, simhash, toxicity
from pulsegrid.llm.common import shared_dir, table

#: Jaccard similarity of five-word shingle sets from which on two documents are near copies.
NEAR = 0.8


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score under 0.3 with a model learned from ``labels``. Null text scores as an empty one; repeated
    rows share their verdict; without labels none goes; an empty table gives none; all columns stay, whatever their names."""
    return toxicity.reject(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the least id. Null and empty texts are copies of each other;
    of equal rows one stays; rows without an id come last; an empty table gives none; all columns stay."""
    return simhash.deduplicate(docs, similarity=NEAR)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of which less than a twentieth of the words is in passages of ``benchmark``. Null and empty texts are
    clean; repeated rows share their verdict; an empty table gives none; all columns stay."""
    return decontamination.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets masked and n_chars counted anew. Null and empty texts pass as they are, so do repeated rows
    each; an empty table gives none; all columns stay."""
    return secret_scan.redact(docs)


def encode_and_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document. Null text counts as empty; equal rows give equal
    rows; an empty table gives none; other columns are ignored."""
    return bpe.digests(docs, bpe.default_path())


def remove(spark: SparkSession, path: str) -> None:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    found.getFileSystem(spark._jsc.hadoopConfiguration()).delete(found, True)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("bpe", encode_and_decode),
]
#: SQL can express neither the classifier nor the tokenizer; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages in order, each written as Parquet in the shared folder and read again by the next.

    A stage's table is removed once the next one's is complete; the last one's stays, since the result reads it.
    """
    docs = table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if k + 1 == len(STAGES):
            return out
        path = f"{folder}/{k}_{name}"
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        if before:
            remove(spark, before)
        before = path
    return docs
