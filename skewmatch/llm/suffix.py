"""Suffix-array dedup: threshold-bounded interval expansion on a Burrows-Wheeler transform.

Every byte that lies in a ``width``-byte string which also starts elsewhere is removed. To deal the work out,
each window of ``width`` bytes is assigned to its anchor, the smallest hashed 96-gram in it (leftmost on ties): equal
windows have equal anchors at equal places, so windows meet exactly where their anchors are equal. The windows of one
anchor in one text form a context (their bytes together).

1. Anchors that occur once in the corpus have no repeated window: they go first.
2. Equal contexts of an anchor form a class. All windows of a class with several members are repeated.
3. Anchors with several classes: one context per class goes to the anchor's task, which concatenates contexts,
   sorts suffixes up to ``width`` bytes, and derives longest common prefixes by breadth-first backward extension of
   intervals: values appear in increasing order, and the search stops at ``width``. A place whose value to a
   neighbour is still unset has a repeated window.
4. An anchor whose contexts exceed ``limit`` bytes is not gathered: its windows are compared by 128-bit digests
   in a shuffle (the exact way for the rest).
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import _powers, hot_join, id_text, mix64, scans, text_buffers, written

WIDTH, GRAM = 400, 96
LIMIT = 2 << 20
TASK_BYTES = 1 << 18
_rng = np.random.default_rng(5_003)
_RAW = _rng.integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def prefix_sums(data: np.ndarray, table: int = 0) -> tuple[np.ndarray, np.ndarray]:
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.multiply(_RAW[table][data], power[:len(data)], out=sums[1:])
    np.cumsum(sums[1:], out=sums[1:])
    return sums, inverse


def anchors(data: np.ndarray, off: np.ndarray, width: int = WIDTH):
    """``(text number, anchor hash, context hash, start in text, context length)`` arrays of the texts in ``data``."""
    n = len(data)
    reach = width - GRAM + 1
    sizes = np.diff(off)
    if n < width or sizes.max(initial=0) < width:
        return None
    sums, inverse = prefix_sums(data)
    grams = mix64((sums[GRAM:] - sums[:-GRAM]) * inverse[:n - GRAM + 1])
    count = len(grams)
    key = (grams & np.uint64(0xFFFFFFFF00000000)) | np.arange(count, dtype=np.uint64)
    pad = -count % reach + reach
    grid = np.concatenate((key, np.full(pad, ~np.uint64(0)))).reshape(-1, reach)
    front = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - width + 1
    where = np.minimum(back[:starts], front[reach - 1:reach - 1 + starts]) & np.uint64(0xFFFFFFFF)
    end = np.repeat(off[1:], sizes)
    text = np.repeat(np.arange(len(sizes)), sizes)
    good = np.flatnonzero(np.arange(starts) + width <= end[:starts])
    if not len(good):
        return None
    where, owner = where[good].astype(np.int64), text[good]
    new = np.concatenate(([True], (where[1:] != where[:-1]) | (owner[1:] != owner[:-1])))
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(good)) - 1
    low, high = good[first], good[last] + width
    context = mix64((sums[high] - sums[low]) * inverse[low] + (high - low).astype(np.uint64))
    return owner[first], grams[where[first]], context, low - off[owner[first]], high - low


def to_blobs(batches):
    """``(row, doc_id, n_bytes, full digest, compressed text)``; row numbers are unique."""
    next_row = TaskContext.get().partitionId() << 33
    pack = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        data, off = text_buffers(batch["text"])
        texts = [data[a:b].tobytes() for a, b in zip(off[:-1].tolist(), off[1:].tolist())]
        rows = np.arange(next_row, next_row + len(texts))
        next_row += len(texts)
        yield pa.record_batch([pa.array(rows), batch["doc_id"], pa.array([len(t) for t in texts], pa.int64()),
                               pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()),
                               pa.array([pack.compress(t) for t in texts], pa.binary())],
                              names=["row", "doc_id", "n_bytes", "digest", "blob"])


def _texts(column: pa.Array) -> list[bytes]:
    unpack = zstandard.ZstdDecompressor()
    return [unpack.decompress(b.as_py()) for b in column]


def to_anchors(width: int):
    def run(batches):
        for batch in batches:
            rows = batch["row"].to_numpy()
            column = pa.array(_texts(batch["blob"]), pa.binary()).cast(pa.large_binary())
            for first, data, off in scans(column):
                if (found := anchors(data, off, width)) is not None:
                    text, anchor, context, start, size = found
                    yield pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(context.view(np.int64)),
                                           pa.array(rows[first + text]), pa.array(start), pa.array(size)],
                                          names=["anchor", "context", "row", "start", "size"])
    return run


def to_contexts(batches):
    """Rows with a text and the contexts wanted of it: the bytes of each."""
    for batch in batches:
        out = [[], [], [], [], [], []]
        for row, blob, wanted in zip(batch["row"].to_pylist(), _texts(batch["blob"]), batch["wanted"].to_pylist()):
            for w in wanted:
                for column, value in zip(out, (w["anchor"], row, w["start"], w["several"], w["large"],
                                               blob[w["start"]:w["start"] + w["size"]])):
                    column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.binary())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["anchor", "row", "start", "several", "large", "bytes"])


def suffix_order(text: np.ndarray, width: int) -> np.ndarray:
    """Rotations of ``text`` sorted by their first ``width`` or more bytes (prefix doubling from 8 bytes)."""
    n = len(text)
    around = np.concatenate((text, text[:8])) if n >= 8 else np.resize(text, n + 8)
    key = np.zeros(n, np.uint64)
    for k in range(8):
        key = (key << np.uint64(8)) | around[k:k + n].astype(np.uint64)
    order = np.argsort(key).astype(np.int32)
    ranked = key[order]
    new = np.concatenate(([True], ranked[1:] != ranked[:-1]))
    done = 8
    while done < width:
        # rank: the first place of a suffix's group of ties; only ties are sorted again
        rank = np.empty(n, np.uint64)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n), 0)).astype(np.uint64)
        tied = np.flatnonzero(~new | np.append(~new[1:], False))
        if not len(tied):
            break
        some = order[tied]
        key = (rank[some] << np.uint64(32)) | rank[(some + done) % n]
        sort = np.argsort(key)
        order[tied] = some[sort]
        key = key[sort]
        del rank, some, sort
        new[tied[1:]] |= key[1:] != key[:-1]
        done *= 2
    return order


def short_prefixes(text: np.ndarray, order: np.ndarray, width: int) -> np.ndarray:
    """Which neighbours in suffix order share fewer than ``width`` bytes (``n + 1`` flags: place r for the pair r - 1, r).

    Interval expansion: the interval of a string is extended backwards by every byte that precedes it; the right
    end of each new interval, if still unset, has the string's length as its common prefix, and only such intervals are
    kept. Lengths therefore come in increasing order, and the search stops at ``width``.
    """
    n = len(text)
    bwt = text[order - 1]
    by_byte = np.argsort(bwt, kind="stable").astype(np.int32)
    step = np.empty(n, np.int32)
    step[by_byte] = np.arange(n, dtype=np.int32)
    same = bwt[by_byte[1:]] == bwt[by_byte[:-1]]
    before, after = np.full(n, -1, np.int32), np.full(n, n, np.int32)
    before[by_byte[1:][same]] = by_byte[:-1][same]
    after[by_byte[:-1][same]] = by_byte[1:][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    del by_byte, same
    low, high = np.array([0], np.int32), np.array([n], np.int32)
    for _ in range(width):
        size = high - low
        owner = np.repeat(np.arange(len(low), dtype=np.int32), size)
        at = np.arange(len(owner), dtype=np.int32) + np.repeat((low - (np.cumsum(size) - size)).astype(np.int32), size)
        is_first, is_last = before[at] < low[owner], after[at] >= high[owner]
        # the first and the last place of each byte in each interval, in the same order
        f, g = at[is_first], at[is_last]
        f = f[np.argsort(owner[is_first] * np.int64(256) + bwt[f])]
        g = g[np.argsort(owner[is_last] * np.int64(256) + bwt[g])]
        low, high = step[f], step[g] + 1
        new = ~known[high]
        low, high = low[new], high[new]
        if not len(low):
            break
        known[high] = True
    return known


def repeated_starts(contexts: list[bytes], width: int = WIDTH) -> list[np.ndarray]:
    """For each context the starts of its ``width``-byte strings that start at another place of the contexts too."""
    text = np.frombuffer(b"\xff".join([*contexts, b""]), np.uint8)  # 0xff is no byte of UTF-8 text
    order = suffix_order(text, width)
    known = short_prefixes(text, order, width)
    long = np.zeros(len(text), bool)
    long[order] = ~known[:-1] | ~known[1:]
    out, at = [], 0
    for c in contexts:
        out.append(np.flatnonzero(long[at:at + max(0, len(c) - width + 1)]))
        at += len(c) + 1
    return out


def _spans(starts: np.ndarray, width: int) -> list[tuple[int, int]]:
    """Runs of consecutive starts as ``(first byte, end)``."""
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > 1)
    return list(zip(starts[np.append(0, cut + 1)].tolist(), (starts[np.append(cut, len(starts) - 1)] + width).tolist()))


def find_repeats(width: int):
    """Contexts sorted by anchor: ``(row, low, high)`` of the repeated bytes of contexts that have no equal. Whole
    anchors are taken together up to ``TASK_BYTES``."""
    def solve(held):
        covered = [(row, start + a, start + b)
                   for (_, row, start, several, _), starts in zip(held, repeated_starts([h[4] for h in held], width))
                   if not several for a, b in _spans(starts, width)]
        columns = list(zip(*covered)) or [[], [], []]
        return pa.record_batch([pa.array(c, pa.int64()) for c in columns], names=["row", "low", "high"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            for item in zip(*(batch[c].to_pylist() for c in ("anchor", "row", "start", "several", "bytes"))):
                if size > TASK_BYTES and item[0] != held[-1][0]:
                    yield solve(held)
                    held, size = [], 0
                held.append(item)
                size += len(item[4])
        if held:
            yield solve(held)
    return run


def window_digests(width: int):
    """Every window of a context with its 128-bit digest (for anchors too large to gather)."""
    def run(batches):
        for batch in batches:
            for row, start, several, data in zip(*(batch[c].to_pylist() for c in ("row", "start", "several", "bytes"))):
                data = np.frombuffer(data, np.uint8)
                n = len(data) - width + 1
                pair = []
                for table in (0, 1):
                    sums, inverse = prefix_sums(data, table)
                    pair.append(mix64((sums[width:] - sums[:-width]) * inverse[:n]))
                raw = np.stack(pair, axis=1).tobytes()
                yield pa.record_batch([pa.array([raw[16 * k:16 * k + 16] for k in range(n)], pa.binary()),
                                       pa.array(np.full(n, row)), pa.array(np.arange(start, start + n)), pa.array(np.full(n, several))],
                                      names=["window", "row", "start", "several"])
    return run


def merged(spans: list[tuple[int, int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for low, high in sorted(spans):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return out


def remove(batches):
    """Texts with their covered spans: what is left of each."""
    for batch in batches:
        out = [[], [], [], [], []]
        for doc, n, blob, spans in zip(batch["doc_id"].to_pylist(), batch["n_bytes"].to_pylist(), _texts(batch["blob"]), batch["spans"].to_pylist()):
            runs = merged([(s["low"], s["high"]) for s in spans])
            digest, at = hashlib.sha256(), 0
            for low, high in runs:
                digest.update(blob[at:low])
                at = high
            digest.update(blob[at:])
            for column, value in zip(out, (doc, n, sum(b - a for a, b in runs), len(runs), digest.hexdigest())):
                column.append(value)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _slot(column) -> F.Column:
    return F.pmod(F.xxhash64(column), F.lit(1 << 20))


def _slots(rows: DataFrame) -> DataFrame:
    """At most 2**20 numbers at any size of the input: which texts may be wanted."""
    return F.broadcast(rows.select(_slot("row").alias("_slot")).distinct())


def covered_spans(blobs: DataFrame, width: int = WIDTH, limit: int = LIMIT) -> DataFrame:
    """``(row, low, high)``: spans whose union is every byte to remove."""
    found = written(blobs.select("row", "blob").mapInArrow(
        to_anchors(width), "anchor long, context long, row long, start long, size long"))
    often = written(found.groupBy("anchor").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
    shared = written(hot_join(found, often, ["anchor"], "inner", rows_col="rows").drop("rows"))
    classes = written(shared.groupBy("anchor", "context").agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct("row", "start")).alias("head"), F.first("size").alias("size"))
        .withColumn("class", F.xxhash64("anchor", "context", "size")))
    several = classes.filter("rows > 1").select("class", F.col("anchor").alias("_a"), F.col("context").alias("_c"), "rows")
    whole = (hot_join(shared.withColumn("class", F.xxhash64("anchor", "context", "size")), several, ["class"], "inner", rows_col="rows")
             .filter("anchor = _a and context = _c").select("row", F.col("start").alias("low"), (F.col("start") + F.col("size")).alias("high")))
    mixed = classes.groupBy("anchor").agg(F.count(F.lit(1)).alias("classes"), F.sum("size").alias("bytes"),
                                          F.max((F.col("rows") == 1).cast("int")).alias("open")).filter("classes > 1 and open = 1")
    asked = (hot_join(classes, written(mixed), ["anchor"], "inner", rows_col="classes")
             .select(F.col("head.row").alias("row"), F.struct(
                 "anchor", F.col("head.start").alias("start"), "size", (F.col("rows") > 1).alias("several"),
                 (F.col("bytes") > limit).alias("large")).alias("ask"))
             .groupBy("row").agg(F.collect_list("ask").alias("wanted")))
    asked = written(asked)
    near = blobs.select("row", "blob").withColumn("_slot", _slot("row")).join(_slots(asked), "_slot", "left_semi").drop("_slot")
    contexts = written(near.join(asked, "row").mapInArrow(
        to_contexts, "anchor long, row long, start long, several boolean, large boolean, bytes binary"))
    spans = "row long, low long, high long"
    parts = (contexts.filter("not large").drop("large").repartition("anchor").sortWithinPartitions("anchor")
             .mapInArrow(find_repeats(width), spans))
    out = whole.unionByName(parts)
    large = contexts.filter("large")
    if not large.isEmpty():
        windows = written(large.mapInArrow(window_digests(width), "window binary, row long, start long, several boolean"))
        twice = written(windows.groupBy("window").agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1"))
        more = hot_join(windows.filter("not several"), twice, ["window"], "inner", rows_col="rows").select(
            "row", F.col("start").alias("low"), (F.col("start") + width).alias("high"))
        out = out.unionByName(more)
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH,
                   limit: int = LIMIT) -> DataFrame:
    """One row per input row: ``doc_id, n_bytes, n_removed, n_spans, kept_sha256``.

    A null text is empty; texts shorter than ``width`` bytes keep everything; equal texts of ``width`` bytes or more
    lose everything, repeated rows and rows without ``doc_id`` included; an empty table gives no rows; other columns
    are ignored.
    """
    blobs = written(id_text(docs, id_col, text_col).mapInArrow(
        to_blobs, "row long, doc_id long, n_bytes long, digest string, blob binary"))
    lists = written(covered_spans(blobs, width, limit).groupBy("row")
                    .agg(F.collect_list(F.struct("low", "high")).alias("spans")))
    keyed = blobs.withColumn("_slot", _slot("row"))
    slots = _slots(lists)
    plain = ["doc_id", "n_bytes", F.lit(0).cast("long").alias("n_removed"), F.lit(0).cast("long").alias("n_spans"),
             F.col("digest").alias("kept_sha256")]
    apart = keyed.join(slots, "_slot", "left_anti").select(*plain)
    joined = keyed.join(slots, "_slot", "left_semi").drop("_slot").join(lists, "row", "left")
    cut = (joined.withColumn("spans", F.coalesce("spans", F.expr("array()").cast("array<struct<low:bigint,high:bigint>>")))
           .select("doc_id", "n_bytes", "blob", "spans")
           .mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"))
    return apart.unionByName(cut)


#: Every window of 400 bytes by its MD5, the bytes that repeated ones cover, and what is left.
ORACLE = """
WITH raw AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n_bytes FROM documents),
windows AS (SELECT doc_id, p, md5_number(substring(h, 2 * p + 1, 800)) AS w FROM raw, unnest(range(0, n_bytes - 399)) AS u(p)),
hits AS (SELECT doc_id, p FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
steps AS (SELECT *, coalesce(p > lag(p) OVER g + 400, true) AS new FROM hits WINDOW g AS (PARTITION BY doc_id ORDER BY p)),
numbered AS (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM steps),
spans AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS b FROM numbered GROUP BY doc_id, run),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS gone, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(n, 0) AS n_spans,
       sha256(unhex(CASE WHEN n IS NULL THEN h ELSE array_to_string(list_transform(range(1, n + 2), lambda k:
           substring(h, 2 * (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1,
                     2 * (CASE WHEN k = n + 1 THEN n_bytes ELSE starts[k] END - CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END))), '') END)) AS kept_sha256
FROM raw LEFT JOIN cuts USING (doc_id)
"""
