"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Every stage but the last returns the columns of its input.  None changes the
schema, so extra columns pass through.  An empty table stays empty.  Each stage
takes all rows that its predecessor kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate as benchmarks
from tidemark.llm import packing, secret_scan, simhash, toxicity
from tidemark.llm.common import table, written

#: Rows of a list of ids that may be broadcast; longer lists are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that score THRESHOLD or more under a model fitted on the training labels."""
    out, c = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    return out.where(F.col(c)["score"] < toxicity.THRESHOLD).drop(c)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies: five-word shingles alike to 0.8 or more.

    Rows that share an id are one document: they stay if one of them is its
    component's first.  Rows with a null id are never dropped.
    """
    found = simhash.similar(docs.select("doc_id", "text"))
    gone = found.where("doc_id is not null").groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("first")).where("not first").select("doc_id")
    gone = written(gone)
    return docs.join(F.broadcast(gone) if gone.count() <= BROADCAST_ROWS else gone, "doc_id", "left_anti").select(*docs.columns)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    out, c = benchmarks.decontaminate(docs, table(spark, sf_dir, "benchmark"))
    return out.where(~F.col(c)["contaminated"]).drop(c)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps every document and blanks its secrets; n_chars follows where the text changed."""
    return secret_scan.redact(docs, length="n_chars")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece: where it lies in which sequence."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", remove_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", remove_contaminated),
    ("secrets", redact_secrets),
    ("packing", pack),
]

#: Learned scores, fingerprints and token ids are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
