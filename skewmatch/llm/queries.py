"""The registered queries of the training-data operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from skewmatch.llm import (balltree, brown, exact, fingerprint, licenses, merkle, minhash, mixing, nra, packing, quality, secrets,
                           suffix)
from skewmatch.llm.common import documents


def op1_minhash_near_dedup(spark, sf_dir):
    return minhash.near_components(documents(spark, sf_dir), shingle=4, percent=80)


def op2_exact_dedup(spark, sf_dir):
    return exact.exact_dedup(documents(spark, sf_dir))


def op3_fingerprints(spark, sf_dir):
    return fingerprint.document_fingerprints(documents(spark, sf_dir))


def op4_packing(spark, sf_dir):
    return packing.pack(documents(spark, sf_dir))


def op5_brown_ngrams(spark, sf_dir):
    return brown.language_scores(documents(spark, sf_dir))


def op6_quality_classifier(spark, sf_dir):
    return quality.quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def op7_license_scan(spark, sf_dir):
    """Documents as files: every fifth in ``source/lang``, the others in one of 16 folders below. Of the documents with a
    statement, wherever it stands, those with an even id license their directory."""
    folder = F.when(F.col("doc_id") % 5 != 0, F.concat(F.lit("d"), F.pmod("doc_id", F.lit(16)).cast("string")))
    path = F.concat_ws("/", "source", "lang", folder, F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return licenses.scan_licenses(documents(spark, sf_dir), path, stands=F.pmod("doc_id", F.lit(2)) == 0)


def op8_secret_scan(spark, sf_dir):
    return secrets.secrets(documents(spark, sf_dir))


def op9_suffix_dedup(spark, sf_dir):
    return suffix.remove_repeats(documents(spark, sf_dir))


def op10_mixing(spark, sf_dir):
    return mixing.mix(documents(spark, sf_dir))


def op11_top_k_search(spark, sf_dir):
    return nra.top_k(spark.read.parquet(f"{sf_dir.rstrip('/')}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op12_ranked_search(spark, sf_dir):
    return balltree.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet"))


def op13_merkle_manifest(spark, sf_dir):
    return merkle.manifest(documents(spark, sf_dir), tampers=merkle.half_without_newlines())


QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_exact_dedup, op3_fingerprints, op4_packing, op5_brown_ngrams, op6_quality_classifier,
    op7_license_scan, op8_secret_scan, op9_suffix_dedup, op10_mixing, op11_top_k_search, op12_ranked_search,
    op13_merkle_manifest)}
ORACLE = {"op1_minhash_near_dedup": minhash.ORACLE, "op2_exact_dedup": exact.ORACLE, "op9_suffix_dedup": suffix.ORACLE,
          "op11_top_k_search": nra.ORACLE, "op12_ranked_search": balltree.ORACLE, "op13_merkle_manifest": merkle.ORACLE}
