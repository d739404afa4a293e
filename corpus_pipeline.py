"""From documents to token ids: quality rules, near duplicates, repeated passages, source mixture, SentencePiece.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of documents.

Cases, as the operators define them: null, blank or wordless texts go in the first stage; a null doc_id takes part in everything but
the searches for near copies and repeats, and is kept there; repeated rows of one doc_id pass the search for near copies together,
and a passage counts as repeated only if it stands at another place; null languages and sources are groups of their own; ties go to
the smaller doc_id; columns beyond those of documents pass through to the last stage, whatever their names; a table without
rows gives one without rows.

ORACLE_SQL is None: the minimum covariance determinant is an iteration that SQL does not express. Tests hold run() against
a brute-force version instead.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import jaccard_join, mixing, quality_rules, sentencepiece_codec, suffix_dedup
from kindred.llm.common import read, shared_folder


def drop_outliers(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go."""
    return quality_rules.accepted(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: the one with the least doc_id."""
    return jaccard_join.without_copies(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of at least 50 words that stand in an earlier document go; the rest of the text stays."""
    return suffix_dedup.without_repeats(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources come in proportion to their target weights; a document stands once for each epoch that takes it."""
    return mixing.mix(docs, epoch=None)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document of the mixture."""
    return sentencepiece_codec.encode(docs)


STAGES = [
    ("quality rules", drop_outliers),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents. What one stage returns is written as Parquet and read again by the next, and deleted when that one is written; what the last one reads goes when the process ends."""
    return apply(spark, read(spark, sf_dir, "documents"), sf_dir)


def apply(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/corpus-pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{k}")
            docs = spark.read.parquet(f"{folder}/{k}")
            if k:
                delete(spark, f"{folder}/{k - 1}")
    atexit.register(delete, spark, folder)
    return docs


def delete(spark: SparkSession, folder: str) -> None:
    """A folder of the shared file system goes, unless the session has gone before."""
    if spark.sparkContext._jsc is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
