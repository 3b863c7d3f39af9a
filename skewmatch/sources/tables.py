"""Entity inputs built from the driver tables.

Every input keeps whole texts, unaltered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewmatch.functions.text import split_lines, split_words
from skewmatch.sources.lines import entity_lines


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line of every document: ``(id, text, doc_id, line_no)``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return entity_lines(docs, "doc_id", "text")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text of every page, line by line, each tag a line break (so that
    many lines are empty): ``(id, text, page_id, line_no)``."""
    pages = table(spark, sf_dir, "pages").select("page_id", F.regexp_replace("html", "<[^>]*>", "\n").alias("text"))
    return entity_lines(pages, "page_id", "text")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Page urls as entities: ``(id, text)``."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return pages.select(F.col("page_id").alias("id"), F.col("url").alias("text"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names as entities: ``(id, text)``."""
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return parts.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"))


ENTITY_INPUTS = {
    "documents": document_lines,
    "pages": page_urls,
    "parts": part_names,
}


def benchmark_sources(spark: SparkSession, sf_dir: str):
    """Two line sources from ``benchmark``: even ``item_id`` and odd ``item_id``.

    Returns two DataFrames with one column ``line``.
    """
    bench = table(spark, sf_dir, "benchmark").select("item_id", "text")
    lines = bench.select("item_id", F.explode(split_lines("text")).alias("line"))
    left = lines.filter(F.pmod("item_id", F.lit(2)) == 0).select("line")
    right = lines.filter(F.pmod("item_id", F.lit(2)) == 1).select("line")
    return left, right


def distinct_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """Remove duplicate lines of one source (words stay repeated across lines)."""
    return lines.select(line).distinct()


def tokenize_words(lines: DataFrame, line: str = "line") -> DataFrame:
    """One row per word: lines split on single spaces, empty words dropped."""
    return lines.select(F.explode(split_words(F.col(line))).alias("word"))
