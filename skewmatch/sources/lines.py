"""Entities as text lines: from text files, or from a text column of a table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewmatch.functions.text import split_lines
from skewmatch.session import exists, move, remove

def read_lines(spark: SparkSession, path: str, line_numbers: bool = False,
               partitions: int | None = None) -> DataFrame:
    """One entity per line of the text file(s) at ``path``: ``(id, text)``.

    The reader ends lines at ``\\n``, ``\\r\\n`` and ``\\r``. By default ``id`` is
    ``monotonically_increasing_id()`` of the scan: unique, and the same on
    every evaluation for the same files and split settings, at no extra cost.
    With ``line_numbers`` it is the line number from 0 over the files in path
    order: a first scan counts the lines of each file split, and a line gets the lines before its split plus
    its place there, so no text is sorted or shuffled. ``partitions`` is the
    number of partitions of the result; by default that of the scan.
    """
    raw = spark.read.text(path).select(F.col("value").alias("text"), F.monotonically_increasing_id().alias("_row"),
                                       F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
    lines = raw.select(F.col("_row").alias("id"), "text")
    if line_numbers:
        lines = raw.join(F.broadcast(split_offsets(raw)), ["_file", "_start"]).select(
            (F.col("_row") - F.col("_first") + F.col("_before")).alias("id"), "text")
    return lines.repartition(partitions) if partitions else lines


def split_offsets(raw: DataFrame) -> DataFrame:
    """``_file, _start, _first, _before`` per file split: its first row id and the lines before it, over the files in path order.

    One row per split, which the driver has planned one by one; the windows are over splits and over files.
    """
    splits = raw.groupBy("_file", "_start").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines"))
    ahead = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = splits.withColumn("_inside", F.coalesce(F.sum("_lines").over(ahead(Window.partitionBy("_file").orderBy("_start"))), F.lit(0)))
    files = splits.groupBy("_file").agg(F.sum("_lines").alias("_all"))
    files = files.select("_file", F.coalesce(F.sum("_all").over(ahead(Window.orderBy("_file"))), F.lit(0)).alias("_files"))
    return inside.join(files, "_file").select("_file", "_start", "_first", (F.col("_inside") + F.col("_files")).alias("_before"))


def write_lines(texts: DataFrame, path: str, order: list[str], text: str = "text") -> str:
    """Write a text column as text files whose path order is ``order``; null texts are left out."""
    n = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (texts.filter(F.col(text).isNotNull()).repartitionByRange(n, *order).sortWithinPartitions(*order)
          .select(F.col(text).alias("value")).write.text(path))
    return path


def entity_lines(df: DataFrame, record_id: str | list[str], text: str) -> DataFrame:
    """Every line of a text column as its own entity: ``(id, text, <record id columns>, line_no)``.

    ``id`` is the struct of the record's id columns and the line number: unique
    and ordered for any number of records and lines. Lines are split like Java's
    ``String.split("\\n")`` (trailing empty lines dropped). No shuffle: each
    record is exploded where it is read.
    """
    record = [record_id] if isinstance(record_id, str) else list(record_id)
    exploded = df.select(*record, F.posexplode(split_lines(F.col(text))).alias("line_no", "text"))
    exploded = exploded.withColumn("line_no", F.col("line_no").cast("long"))
    return exploded.select(F.struct(*record, "line_no").alias("id"), "text", *record, "line_no")


def drop_empty_lines(df: DataFrame, text: str = "text") -> DataFrame:
    """Drop lines that are exactly empty; whitespace-only lines stay."""
    return df.filter(F.col(text) != "")


def write_matches(matches: DataFrame, path: str, fmt: str = "parquet", mode: str = "error") -> str:
    """Write a match table; returns the path. Parquet by default (zstd: ids and texts recur in pair after pair), or ``csv`` / ``json``.

    The table is written beside ``path`` and moved there in one step when it is complete, so ``path`` never holds a part of
    it, and nothing is left if the write fails. ``mode`` is ``error`` or ``overwrite``.
    """
    spark = matches.sparkSession
    if mode not in ("error", "overwrite"):
        raise ValueError(f"mode {mode!r}: a result is written whole, with 'error' or 'overwrite'")
    if mode == "error" and exists(spark, path):
        raise FileExistsError(path)
    writer = matches.write
    if fmt == "csv":
        writer = writer.option("header", "true")
    if fmt == "parquet":
        writer = writer.option("compression", "zstd")
    beside = f"{path.rstrip('/')}.writing-{uuid.uuid4().hex}"
    try:
        writer.format(fmt).save(beside)
        if mode == "overwrite":
            remove(spark, path)
        move(spark, beside, path)
    finally:
        remove(spark, beside)
    return path


def read_matches(spark: SparkSession, path: str, fmt: str = "parquet",
                 schema: str | None = None) -> DataFrame:
    reader = spark.read
    if schema:
        reader = reader.schema(schema)
    if fmt == "csv":
        reader = reader.option("header", "true")
    return reader.format(fmt).load(path)
