"""Document fingerprints: one-permutation MinHash with optimal densification, low-order bits packed.

A text's five-word shingles are hashed once; the high part of a hash chooses one of ``BINS`` bins, and each bin
keeps its minimum. An empty bin borrows from the first non-empty one along its own universal-hash sequence (optimal
densification), so equal texts have equal bins. Each bin's value is hashed once more with the bin's number: bins that
borrowed one shingle then agree by chance independently, which matters for short texts. ``BITS`` low bits of each bin are packed as hex. The share of equal bins is
corrected for the 2**-BITS that agree by chance.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import id_text, mix64, partitions, shingle_hashes, word_hashes

BINS, BITS, SHINGLE = 512, 4, 5
TRIES = 512
_EMPTY = np.uint64(0xFFFFFFFFFFFFFFFF)
_SALT = mix64(np.arange(1, BINS + 1, dtype=np.uint64))


@lru_cache(maxsize=3)
def probes(tries: int) -> np.ndarray:
    """Bin number tried by each bin at each attempt."""
    grid = np.arange(BINS, dtype=np.uint64)[:, None] * np.uint64(1 << 32) + np.arange(1, tries + 1, dtype=np.uint64)
    return (mix64(grid) % np.uint64(BINS)).astype(np.int32)


def bins(shingles: np.ndarray) -> np.ndarray | None:
    """The densified minima of a shingle set, null if it is empty."""
    if not len(shingles):
        return None
    low = np.full(BINS, _EMPTY)
    # sorted hashes: the first of each bin is its minimum
    where = (shingles >> np.uint64(55)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
    low[where[first]] = mix64(shingles[first])
    empty = np.flatnonzero(low == _EMPTY)
    if len(empty):
        full = np.ones(BINS, bool)
        full[empty] = False
        source, todo = np.zeros(BINS, np.int64), empty
        table, done, wide = probes(TRIES), 0, 1
        while len(todo):
            if done == table.shape[1]:
                table = probes(done * 8)
            seen = full[table[todo, done:done + wide]]  # most bins find one at once: look at few attempts first
            hit = seen.any(axis=1)
            source[todo[hit]] = table[todo[hit], done + seen[hit].argmax(axis=1)]
            todo, done, wide = todo[~hit], done + wide, max(1, done + wide)
        low[empty] = low[source[empty]]
    return mix64(low ^ _SALT)


def packed(low: np.ndarray | None) -> str:
    """Two bins per byte as hex; an empty text has an empty fingerprint."""
    if low is None:
        return ""
    nibble = (low & np.uint64((1 << BITS) - 1)).astype(np.uint8)
    return (nibble[::2] << 4 | nibble[1::2]).tobytes().hex()


def likeness(a: str, b: str) -> float:
    """Estimated similarity of two fingerprints (0 to 1): two empty texts are alike, an empty and another not."""
    if not a or not b:
        return float(a == b)
    x, y = (np.frombuffer(bytes.fromhex(s), np.uint8) for s in (a, b))
    diff = x ^ y
    same = ((diff >> 4 == 0).sum() + (diff & 15 == 0).sum()) / BINS
    chance = 2.0 ** -BITS
    return float(max(0.0, (same - chance) / (1 - chance)))


def fingerprints(texts: list[str]) -> list[str]:
    raw = [t.encode("utf-8", "surrogatepass") for t in texts]
    out = []
    first = 0
    while first < len(raw):
        last, size = first + 1, len(raw[first])
        while last < len(raw) and size + len(raw[last]) <= 1 << 19:
            size += len(raw[last])
            last += 1
        off = np.cumsum([0, *map(len, raw[first:last])])
        words, before = word_hashes(np.frombuffer(b"".join(raw[first:last]), np.uint8), off)
        out += [packed(bins(s)) for s in shingle_hashes(words, before, SHINGLE)]
        first = last
    return out


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by the first as many (or all) of the following text."""
    half = len(text) // 2
    return text[:len(text) - half] + following[:half]


def compare(batches):
    """Rows in order, each part closed by its guest (the row that follows it): one row out for each row that is no
    guest. Holds one batch and one open row."""
    open_row = None
    for batch in batches:
        ids, texts, guests = batch["doc_id"].to_pylist(), batch["text"].to_pylist(), batch["guest"].to_pylist()
        prints = fingerprints(texts)
        rows = ([open_row] if open_row else []) + list(zip(ids, texts, guests, prints))
        open_row = rows[-1]
        ready = [(a, b) for a, b in zip(rows, rows[1:]) if not a[2]]
        changed = [edited(a[1], b[1]) for a, b in ready]
        new = fingerprints(changed)
        yield pa.record_batch(
            [pa.array([a[0] for a, _ in ready], pa.int64()), pa.array([len(a[1]) for a, _ in ready], pa.int64()),
             pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in changed], pa.string()),
             pa.array([a[3] for a, _ in ready], pa.string()), pa.array(new, pa.string()),
             pa.array([likeness(a[3], n) for (a, _), n in zip(ready, new)], pa.float64()),
             pa.array([likeness(a[3], b[3]) for a, b in ready], pa.float64())],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])


def document_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", parts: int | None = None) -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next`` per input row.

    Rows follow each other by ascending doc_id, rows without one last, ties by text (equal rows are interchangeable);
    the first row follows the last. A null text is empty. An empty table gives no rows; other columns are
    ignored. Texts are shuffled once, into ranges of doc_id; one boundary id per range reaches the driver, and a
    boundary row goes to the range before it too.
    """
    rows = id_text(docs, id_col, text_col).withColumn("none", F.col("doc_id").isNull())
    spark = docs.sparkSession
    parts = parts or partitions(spark)
    cuts = sorted(set(rows.filter("doc_id is not null").approxQuantile("doc_id", [k / parts for k in range(1, parts)], 0.2 / parts)))
    cuts = [int(c) for c in cuts]
    bucket = F.when(F.col("none"), F.lit(len(cuts) + 1)).otherwise(
        F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col("doc_id"))) if cuts else F.lit(0)).cast("int")
    rows = rows.withColumn("bucket", bucket)
    heads = {r["bucket"]: r["first"] for r in rows.groupBy("bucket").agg(F.min("doc_id").alias("first")).collect()}
    if not heads:
        return rows.withColumn("guest", F.lit(False)).select("doc_id", "text", "guest").mapInArrow(compare, SCHEMA)
    order = sorted(heads)
    before = {b: order[k - 1] for k, b in enumerate(order)}  # the range before; the last one for the first
    first_ids = [heads[b] for b in order if heads[b] is not None]
    near = rows.filter(F.col("doc_id").isin(first_ids) | F.col("none") if len(cuts) + 1 in heads else F.col("doc_id").isin(first_ids))
    least = near.groupBy("bucket").agg(F.min(F.struct("doc_id", "text")).alias("head"))
    to = F.create_map(*[F.lit(x) for b in order for x in (b, before[b])])
    guests = least.select(F.col("head.doc_id").alias("doc_id"), F.col("head.text").alias("text"),
                          to[F.col("bucket")].cast("int").alias("bucket"), F.lit(True).alias("guest"))
    dealt = rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests)
    return (dealt.repartitionById(len(cuts) + 2, F.col("bucket"))
                 .sortWithinPartitions("bucket", "guest", F.col("doc_id").asc_nulls_last(), "text")
                 .select("doc_id", "text", "guest").mapInArrow(compare, SCHEMA))


SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
