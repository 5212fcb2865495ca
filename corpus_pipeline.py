"""The corpus pipeline: five stages over documents, each an operator of kinetiq.llm.

Every stage reads all rows that the one before kept and takes (spark, docs, sf_dir). All but the last return the columns
of documents; the last returns a row per packed piece.
"""

from __future__ import annotations

from kinetiq.llm import decontam, packing, pii, simhash, toxicity
from kinetiq.llm.store import cut


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark, docs, sf_dir):
    """Documents that the classifier rejects go.

    Null and empty texts are judged as texts without words; equal texts share their fate; columns are carried unread.
    """
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark, docs, sf_dir):
    """One document of each group of near copies stays: the one with the smallest doc_id.

    Null and empty texts are copies of each other; equal rows are one; rows without a doc_id stay.
    """
    return simhash.keep_one(docs)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold a benchmark passage go. Null and empty texts hold none; equal texts share their fate."""
    return decontam.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mask_personal_data(spark, docs, sf_dir):
    """Personal data in the texts is masked; every document stays, with null and empty texts as they are."""
    return pii.redact(docs)


def pack(spark, docs, sf_dir):
    """The texts as token pieces in sequences of at most 2048; a null or empty text is its end id."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("personal_data", mask_personal_data),
    ("packing", pack),
]

#: Stages that score, hash or tokenise have no SQL counterpart; tests hold them against brute force.
ORACLE_SQL = None


def run(spark, sf_dir):
    """All stages over documents; each result is written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = cut(docs, name)
    return docs
