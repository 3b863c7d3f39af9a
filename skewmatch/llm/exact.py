"""Exact dedup: a tree-merge of sorted digest runs.

Every input partition pre-aggregates its documents to one sorted run of ``(digest, smallest doc_id,
rows)``. With ``R ** rounds`` slots, round ``k`` is a binomial exchange: slot ``p`` sends each entry to
the partner whose ``k``-th base-R digit is the entry's ``k``-th digest digit (all other digits stay),
so it talks to R - 1 partners only. The runs that meet in a slot are merged in sorted order and equal
digests keep the smallest identifier. The digest is the whole SHA-256 of the normalised text, and each merge
compares all 32 bytes (the sort key is the digest itself). After the last round a digest lives in one
slot; no slot ever holds more than its share, and a hot text is one entry per slot from the first step on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import SPACE, hot_join, id_text, partitions, written

RUN = "digest binary, keep_id long, rows long"


def text_digest(text) -> F.Column:
    """SHA-256 (lowercase hex) of the text with each run of white space replaced by one space."""
    return F.sha2(F.regexp_replace(text, SPACE, " ").cast("binary"), 256)


def merge_runs(batches):
    """Merge rows sorted by digest: one row per digest with the smallest identifier (null only if all
    are) and the number of rows. Holds one batch and one open entry."""
    none = np.iinfo(np.int64).max
    carry = None
    for batch in batches:
        if not batch.num_rows:
            continue
        digest = np.frombuffer(b"".join(batch["digest"].to_pylist()), "S32")
        raw = digest.view("V32")
        keep = batch["keep_id"].fill_null(none).to_numpy(zero_copy_only=False)
        rows = batch["rows"].to_numpy(zero_copy_only=False)
        new = np.concatenate(([True], raw[1:] != raw[:-1]))
        at = np.flatnonzero(new)
        keep, rows, raw = np.minimum.reduceat(keep, at), np.add.reduceat(rows, at), raw[at]
        if carry is not None:
            if carry[0] == raw[0].tobytes():
                keep[0], rows[0] = min(keep[0], carry[1]), rows[0] + carry[2]
            else:
                yield _run([carry[0]], [carry[1]], [carry[2]], none)
        carry = (raw[-1].tobytes(), int(keep[-1]), int(rows[-1]))
        if len(raw) > 1:
            yield _run([x.tobytes() for x in raw[:-1]], keep[:-1], rows[:-1], none)
    if carry is not None:
        yield _run([carry[0]], [carry[1]], [carry[2]], none)


def _run(digest, keep, rows, none):
    keep = np.asarray(keep, np.int64)
    return pa.record_batch([pa.array(digest, pa.binary()), pa.array(keep, mask=keep == none),
                            pa.array(np.asarray(rows, np.int64))], names=["digest", "keep_id", "rows"])


def tree_merge(digests: DataFrame, radix: int = 8, slots: int | None = None) -> DataFrame:
    """``(digest, keep_id, rows)`` per distinct digest of ``(digest binary, doc_id)``."""
    slots = slots or partitions(digests.sparkSession)
    rounds = 1
    while radix ** rounds < slots:
        rounds += 1
    width = radix ** rounds
    runs = (digests.select("digest", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("rows"))
                   .sortWithinPartitions("digest").mapInArrow(merge_runs, RUN)
                   .withColumn("_slot", F.pmod(F.spark_partition_id(), F.lit(width))))
    home = F.pmod(F.xxhash64("digest"), F.lit(width)).cast("int")
    for k in range(rounds):
        unit = radix ** k
        digit = F.pmod(F.floor(home / unit), F.lit(radix)).cast("int")
        own = F.pmod(F.floor(F.col("_slot") / unit), F.lit(radix)).cast("int")
        runs = (runs.withColumn("_slot", (F.col("_slot") + (digit - own) * unit).cast("int"))
                    .repartitionById(width, F.col("_slot")).sortWithinPartitions("digest")
                    .drop("_slot").mapInArrow(merge_runs, RUN)
                    .withColumn("_slot", F.spark_partition_id()))
    return runs.drop("_slot")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radix: int = 8,
                slots: int | None = None) -> DataFrame:
    """One row per input row: ``doc_id, keep_id, group_size, kept, text_sha256``.

    A null text counts as empty, an empty table gives an empty result, texts of any length are whole.
    Rows without ``doc_id`` take part in groups but stay only if no row of the group has an id (then all
    of them do, ``keep_id`` null). Rows that repeat the kept ``doc_id`` with an equal text are the same document:
    each is marked kept. Other columns are ignored.
    """
    digests = written(id_text(docs, id_col, text_col)
                      .select("doc_id", F.unhex(text_digest(F.col("text"))).alias("digest")))
    groups = written(tree_merge(digests, radix, slots))
    joined = hot_join(digests, groups, ["digest"], "inner", rows_col="rows")
    return joined.select("doc_id", "keep_id", F.col("rows").alias("group_size"),
                         F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
                         F.lower(F.hex("digest")).alias("text_sha256"))


def surplus_rows(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str = "row", **options) -> DataFrame:
    """``row`` of all rows but one of each group of equal texts. The one with the smallest ``doc_id`` stays (rows without one last), of
    rows that repeat it the one with the smallest ``row``."""
    digests = written(rows.select(F.col(row_col).alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.unhex(text_digest(
        F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("digest")))
    groups = tree_merge(digests, **options).filter("rows > 1")
    some = written(hot_join(digests, written(groups), ["digest"], "inner", rows_col="rows"))
    first = some.filter("doc_id <=> keep_id").groupBy("digest").agg(F.min("row").alias("first"))
    return hot_join(some.select("row", "digest"), written(first), ["digest"], "inner").filter("row != first").select("row")


ORACLE = r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
           FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id IS NOT DISTINCT FROM min(doc_id) OVER g AS kept, text_sha256
FROM d WINDOW g AS (PARTITION BY text_sha256)
"""
