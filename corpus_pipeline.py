"""A corpus pipeline of five of the training-data operators, each stage over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from passagework.llm import bpe, mixing, ngramjoin, quality, secrets
from passagework.llm.common import materialize, table

#: (name, function of (spark, docs, sf_dir)); all but the last return the columns of documents.
STAGES = [
    ("quality classifier", quality.quality_stage),
    ("n-gram Jaccard join", ngramjoin.near_copy_stage),
    ("secret scans", secrets.secret_stage),
    ("mixing sources to target weights", mixing.mix_stage),
    ("byte-level BPE encoding and decoding", bpe.bpe_stage),
]

#: A trained classifier and byte-pair merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, name.replace(" ", "-"))
    return docs
