"""The queries of this subpackage and the SQL that gives the same rows, where SQL can."""

from __future__ import annotations

from . import alignment, ann, decontam, packing, phrases, pii, sharding, simhash, substring, toxicity, vectors, warc, wavelet


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_toxicity(spark, sf_dir):
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_ann(spark, sf_dir):
    return ann.neighbours(_table(spark, sf_dir, "embeddings"))


def op4_decontam(spark, sf_dir):
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op5_substring(spark, sf_dir):
    return substring.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_packing(spark, sf_dir):
    return packing.pack(_table(spark, sf_dir, "documents"))


def op7_pii(spark, sf_dir):
    return pii.find(_table(spark, sf_dir, "documents"))


def op8_sharding(spark, sf_dir):
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op9_warc(spark, sf_dir):
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op10_wavelet(spark, sf_dir):
    return wavelet.round_trip(_table(spark, sf_dir, "documents"))


def op11_phrases(spark, sf_dir):
    return phrases.collocations(_table(spark, sf_dir, "documents"))


def op12_vectors(spark, sf_dir):
    return vectors.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op13_alignment(spark, sf_dir):
    return alignment.align_documents(_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_simhash, op2_toxicity, op3_ann, op4_decontam, op5_substring, op6_packing, op7_pii, op8_sharding, op9_warc, op10_wavelet,
        op11_phrases, op12_vectors, op13_alignment,
    )
}

ORACLES: dict[str, str] = {"op4_decontam": decontam.ORACLE, "op9_warc": warc.ORACLE, "op11_phrases": phrases.ORACLE, "op12_vectors": vectors.ORACLE}
