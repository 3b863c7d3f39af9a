"""The stages of the corpus pipeline: quality, exact dedup, near dedup, mixing, packing.

Every stage takes ``(spark, docs, sf_dir)``; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewmatch.llm import exact, minhash, mixing, packing, quality
from skewmatch.llm.common import documents, hot_join, numbered, without_rows, written

ORACLE_SQL = None


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go. Each row is judged by its text alone: repeated rows and rows without an id
    like any other, a null text as an empty one, texts of any length whole. An empty table stays empty."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row stays, that with the smallest doc_id (a null one is the largest). A null text is
    empty; rows that repeat an id and its text are dropped too; texts of any length are whole; an empty table stays empty."""
    rows = numbered(docs)
    return without_rows(rows, written(exact.surplus_rows(rows.select("row", "doc.doc_id", "doc.text"))))


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five words, similarity 0.8) stays, the row with the smallest doc_id (a null one is
    the largest; of repeated ones any). Null texts and texts without words are linked with nothing and stay; texts of any
    length are whole; an empty table stays empty."""
    rows = numbered(docs)
    found = written(minhash.near_components(rows.select("row", "doc.text"), id_col="row").select(F.col("doc_id").alias("row"), "component_id"))
    sizes = found.groupBy("component_id").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    grouped = written(hot_join(found, sizes, ["component_id"], "inner", rows_col="rows"))
    ids = grouped.join(rows.select("row", F.col("doc.doc_id").alias("doc_id")).hint("merge"), "row")
    stays = ids.groupBy("component_id").agg(F.min_by("row", F.struct(F.col("doc_id").isNull(), "doc_id", "row")).alias("row"))
    return without_rows(rows, written(grouped.join(stays.hint("merge"), "row", "left_anti").select("row")))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources: each copy of a document holds the words that the mix takes. Every row has ranges of its own, repeated ones
    too; a document without words is never taken; a null source is the last one; an empty table stays empty."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 ids; null texts are the end id alone, repeated rows are packed one by one."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage),
          ("mixing to target weights", mixing_stage), ("packing", packing_stage)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again."""
    docs = documents(spark, sf_dir)
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
