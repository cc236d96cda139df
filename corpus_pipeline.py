"""The corpus pipeline: toxicity, line dedup, near-dedup, decontamination, encoding.

Each stage takes the documents that the one before kept, with all their columns, and states what it does with null ids
and texts in the operator's own docstring. Every stage of an empty table gives an empty table.
"""

from __future__ import annotations

from reachlight.llm import bpe, decontaminate, line_dedup, minhash, toxicity
from reachlight.llm.common import shared, table


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier, trained on the labelled rows of these documents, does not reject."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark, docs, sf_dir):
    """Documents without the blocks that an earlier one holds; those left without a word go."""
    return line_dedup.dedup_lines(docs)


def near_dedup(spark, docs, sf_dir):
    """One document of each group of five-word shingle sets with a similarity of 0.8 or more."""
    return minhash.keep_one(docs)


def decontaminated(spark, docs, sf_dir):
    """Documents that hold no passage of the benchmark."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encoded(spark, docs, sf_dir):
    """Token ids of each document, with their number and digests."""
    return bpe.encode_decode(docs, with_ids=True)


STAGES = [("toxicity", drop_toxic), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontaminated), ("bpe", encoded)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """STAGES applied to documents, each written as Parquet in the shared folder and read again."""
    docs, out = table(spark, sf_dir, "documents"), shared(spark, "pipeline")
    for k, (_, f) in enumerate(STAGES):
        f(spark, docs, sf_dir).write.parquet(f"{out}/{k}")
        docs = spark.read.parquet(f"{out}/{k}")
    return docs
