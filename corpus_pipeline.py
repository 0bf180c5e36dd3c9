"""The training-data pipeline: from ``documents`` to packed sequences.

``STAGES`` are (name, function) pairs; each function takes (spark, docs, sf_dir)
and works on all rows its predecessor kept.  All but the last return the
columns of ``docs``; the last returns the packed pieces.  ``run`` applies them in
order; every stage's result is written as Parquet into the shared checkpoint
folder and read again as the next one's input.

Every stage reads doc_id and text only and keeps the other columns as they are.
Empty and NULL texts are kept by all stages (and packed as their end id).  Rows
equal in doc_id and text are judged alike; rows that share only the doc_id are
told apart by their texts, except by near dedup, which decides by doc_id.  A NULL
doc_id is an id like any other.  Empty tables pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wearhouse.llm import decontam, linededup, neardup, packing, toxicity
from wearhouse.llm.common import documents, materialize, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects (0.5 or more) go; learned from
    the training folds of the labels, word counts from all of ``docs``."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal and nearly equal lines the first (by doc_id, text hash, line number)
    stays; a document of which no text is left goes, and one of which an earlier
    one has half or more, but not all, is left whole for near dedup."""
    return linededup.drop_lines(docs)


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five-word shingles,
    similarity of 0.8 or more)."""
    return neardup.drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a ten-word window of a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document left is tokenised and packed into sequences of 1024 tokens."""
    return packing.public_pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", dedup_lines),
    ("near_dedup", dedup_documents),
    ("decontamination", decontaminate),
    ("packing", pack),
]

#: SQL can't express the learned score, the edit join or the tokeniser; the
#: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs)
    return docs
