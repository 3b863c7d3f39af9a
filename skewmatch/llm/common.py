"""Shared helpers of the training-data operators."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewmatch.session import checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

#: Bytes of text that the vectorised word scan holds at once (a longer text is scanned alone).
SCAN_BYTES = 1 << 19


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only ``(doc_id, text)``; a null text is empty. Every other column is left behind, so none can clash."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def written(df: DataFrame, **options) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: later steps (and retries after a lost
    executor) read the files instead of computing it again. ``options`` go to the writer."""
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return spark.read.schema(schema).parquet(path)


def numbered(docs: DataFrame) -> DataFrame:
    """``docs`` written once as ``(doc, row)``: all its columns in one struct, so that no name of ours can clash with one of theirs,
    and a number that tells rows apart, repeated ones too."""
    return written(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.monotonically_increasing_id().alias("row")))


def without_rows(rows: DataFrame, gone: DataFrame, slots: int = 1 << 20) -> DataFrame:
    """The documents of ``rows`` (see :func:`numbered`) whose ``row`` isn't in ``gone``, with their own columns. Only rows whose hashed
    number is in a slot of ``gone`` are shuffled; the broadcast list has at most ``slots`` numbers at any size."""
    slot = F.pmod(F.xxhash64("row"), F.lit(slots)).alias("slot")
    some = F.broadcast(gone.select(slot).distinct())
    keyed = rows.withColumn("slot", slot)
    maybe = keyed.join(some, "slot", "left_semi")
    return (keyed.join(some, "slot", "left_anti").select("doc.*")
            .unionByName(maybe.join(gone.select("row").hint("merge"), "row", "left_anti").select("doc.*")))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def hot_join(big: DataFrame, small: DataFrame, keys: list[str], how: str = "left",
             salts: int = 32, total: int | None = None, rows_col: str | None = None, like: DataFrame | None = None) -> DataFrame:
    """``big`` joined with ``small`` (unique on ``keys[0]``) where a key may own a large share of ``big``.

    A key with at least 1/partitions of the rows is hot; there are at most as many of them as partitions, and
    only they reach the driver. A hot key is dealt over ``salts`` parts and its row of ``small`` is copied
    to each; without one the join is a plain one. Null keys match nothing. ``rows_col``: the column of
    ``small`` that has the rows of ``big`` per key, where the caller knows them. ``like``: a table with the keys of ``big``
    that is cheaper to read than ``big``, which would be computed once more to be counted.
    """
    (key,) = keys
    like = big if like is None else like
    total = like.count() if total is None else total
    floor = max(16, total // partitions(big.sparkSession))
    counted = (small.select(key, F.col(rows_col).alias("_rows")) if rows_col else
               like.groupBy(key).agg(F.count(F.lit(1)).alias("_rows")))
    found = [r[0] for r in counted.filter((F.col("_rows") >= floor) & F.col(key).isNotNull()).select(key).collect()]
    if not found:
        return big.join(small, keys, how)
    hot = F.col(key).isin([F.lit(bytes(x)) if isinstance(x, (bytes, bytearray)) else x for x in found])
    pick = F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", F.when(hot, pick).otherwise(F.lit(0)))
    right = small.withColumn("_salt", F.lit(0)).unionByName(
        small.filter(hot).withColumn("_salt", F.explode(F.sequence(F.lit(1), F.lit(salts - 1)))))
    return left.join(right, [key, "_salt"], how).drop("_salt")


# --- vectorised words ---------------------------------------------------------

_rng = np.random.default_rng(20_240_607)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE[65:91] = _BYTE[97:123]  # A-Z count as a-z
_COEF = _rng.integers(1, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_IS_WORD = np.ones(256, bool)
_IS_WORD[[32, 9, 10, 11, 12, 13]] = False
_BASE = 0x9E3779B97F4A7C15
_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the odd base modulo 2**64, and of its inverse, up to ``n``."""
    global _pow, _inv
    if len(_pow) <= n:
        size = max(n + 1, SCAN_BYTES + 1)
        _pow, _inv = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        _pow[0] = _inv[0] = 1
        np.multiply.accumulate(_pow, out=_pow)
        np.multiply.accumulate(_inv, out=_inv)
    return _pow, _inv


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: spreads every input bit over the 64 bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column without nulls, and the row offsets."""
    column = column if pa.types.is_large_binary(column.type) else column.cast(pa.large_string())
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)), off


def scans(column: pa.Array, limit: int | None = None):
    """``(first row, bytes, offsets from 0)`` of runs of rows of at most ``limit`` bytes (one row at least)."""
    limit = limit or SCAN_BYTES
    data, off = text_buffers(column)
    first = 0
    while first < len(off) - 1:
        last = max(first + 1, int(np.searchsorted(off, off[first] + limit, "right")) - 1)
        yield first, data[off[first]:off[last]], off[first:last + 1] - off[first]
        first = last


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the number of words before each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    is_word = _IS_WORD[data]
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    begins = is_word.copy()
    begins[1:] &= ~is_word[:-1] | edge[1:n]
    ends = is_word.copy()
    ends[:-1] &= ~is_word[1:] | edge[1:n]
    start = np.flatnonzero(begins)
    return start, np.flatnonzero(ends) + 1, np.searchsorted(start, off)


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of every word (A-Z as a-z), and the number of words before each row."""
    start, end, before = word_spans(data, off)
    if not len(start):
        return np.zeros(0, np.uint64), before
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_BYTE[data], power[:len(data)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return mix64((sums[end] - sums[start]) * inverse[start]), before


def shingle_hashes(words: np.ndarray, before: np.ndarray, size: int) -> list[np.ndarray]:
    """Per row the sorted distinct hashes of its ``size``-word shingles; a row with fewer words has its
    whole sequence as one, a row without words none."""
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)  # none if all rows together have too few words
    for k in range(size):
        total += words[k:k + len(total)] * _COEF[k]
    total = mix64(total)
    out = []
    for a, b in zip(before[:-1].tolist(), before[1:].tolist()):
        if b - a >= size:
            s = np.sort(total[a:b - size + 1])
            out.append(s[np.concatenate(([True], s[1:] != s[:-1]))])
        elif b > a:
            short = (words[a:b] * _COEF[:b - a]).sum(dtype=np.uint64, keepdims=True)
            out.append(mix64(short + np.uint64(b - a)))
        else:
            out.append(words[:0])
    return out
