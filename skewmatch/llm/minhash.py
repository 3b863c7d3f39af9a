"""MinHash near-dedup: universal hash minima, banding, signature verification, exact confirmation on full
shingle sets, and connected components by alternating large-star and small-star.

1. ``signatures``: each text becomes its set of distinct ``shingle``-word shingles and 256 minima
   of multiply-add hashes modulo 2**32 (16 low bits kept). Documents with equal sets collapse to one node
   (the smallest doc_id), so copies never meet as pairs.
2. ``buckets``: 32 bands of 4 minima. Two sets of similarity 0.8 share no band with probability
   (1 - 0.8**4)**32 = 5e-8.
3. Candidates. A bucket of at most ``SMALL`` nodes gives its pairs. A larger one is cut in blocks; each block
   links its nodes to the node nearest to the block's majority signature, and those centres meet one level up, so
   the links stay linear in the bucket.
4. ``likely`` and ``confirm``: signature estimate >= the threshold minus 5 deviations, then the full sets; the
   links' components.
5. Buckets that still hold several components compare their blocks pairwise inside tasks (pairs already
   joined are skipped, only new links leave a task): the exact way for the rest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import hot_join, id_text, mix64, scans, shingle_hashes, word_hashes, written
from skewmatch.llm.components import components

HASHES, BANDS, ROWS = 256, 32, 4
SMALL = 8
BLOCK = 1024
BLOCK_SHINGLES = 1 << 20

_rng = np.random.default_rng(8_191)
_MUL = (_rng.integers(0, 1 << 31, HASHES, dtype=np.uint32) * np.uint32(2) + np.uint32(1))[:, None]
_ADD = _rng.integers(0, 1 << 32, HASHES, dtype=np.uint32)[:, None]
_TILE = 512


def minima(shingles: np.ndarray) -> np.ndarray:
    """The 256 minima (low 16 bits) of a non-empty shingle set."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    low = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), _TILE):
        tile = x[None, k:k + _TILE] * _MUL
        tile += _ADD
        np.minimum(low, tile.min(axis=1), out=low)
    return low.astype(np.uint16)


def sign(shingle: int):
    """``(doc_id, n, digest, sig)`` of ``(doc_id, text)`` batches; digest and sig are null for an empty set."""
    def run(batches):
        for batch in batches:
            n, digest, sig = [], [], []
            for _, data, off in scans(batch["text"]):
                words, before = word_hashes(data, off)
                for s in shingle_hashes(words, before, shingle):
                    n.append(len(s))
                    digest.append(hashlib.md5(s.tobytes()).digest() if len(s) else None)
                    sig.append(minima(s).tobytes() if len(s) else None)
            yield pa.record_batch([batch["doc_id"], pa.array(n, pa.int64()), pa.array(digest, pa.binary()),
                                   pa.array(sig, pa.binary())], names=["doc_id", "n", "digest", "sig"])
    return run


def shingle_sets(shingle: int):
    """``(node, shingles)``: the whole sorted set as packed 64-bit hashes."""
    def run(batches):
        for batch in batches:
            for first, data, off in scans(batch["text"]):
                words, before = word_hashes(data, off)
                out = [s.tobytes() for s in shingle_hashes(words, before, shingle)]
                yield pa.record_batch([batch["node"].slice(first, len(out)), pa.array(out, pa.binary())],
                                      names=["node", "shingles"])
    return run


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(len(column), HASHES)


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band and row: the band's four minima and its number, mixed."""
    four = np.ascontiguousarray(sig[:, :BANDS * ROWS]).view(np.uint64)
    return mix64(four + (np.arange(BANDS, dtype=np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))


def to_buckets(batches):
    for batch in batches:
        if batch.num_rows:
            keys = band_keys(_matrix(batch["sig"]))
            nodes = np.repeat(batch["node"].to_numpy(), BANDS)
            yield pa.record_batch([pa.array(keys.ravel().view(np.int64)), pa.array(nodes)], names=["bucket", "node"])


def small_pairs(batches):
    """Rows sorted by bucket (buckets of 2 to SMALL nodes): every pair of a bucket."""
    rest = None
    for batch in batches:
        frame = batch.to_pandas()
        frame = frame if rest is None else pd.concat([rest, frame], ignore_index=True)
        if not len(frame):
            continue
        last = frame["bucket"].to_numpy() == frame["bucket"].iloc[-1]
        rest, frame = frame[last], frame[~last]
        yield _pairs_of(frame)
    if rest is not None:
        yield _pairs_of(rest)


def _pairs_of(frame: pd.DataFrame) -> pa.RecordBatch:
    bucket, node = frame["bucket"].to_numpy(), frame["node"].to_numpy()
    a, b = [], []
    for k in range(1, SMALL):
        same = bucket[k:] == bucket[:-k]
        a.append(node[:-k][same] if len(node) > k else node[:0])
        b.append(node[k:][same] if len(node) > k else node[:0])
    a, b = np.concatenate(a), np.concatenate(b)
    return pa.record_batch([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def centre_links(frame: pd.DataFrame) -> pd.DataFrame:
    """One block of a large bucket: each node with the node nearest to the majority of the signatures."""
    sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(frame), HASHES)
    best, count = sig[0].copy(), np.zeros(HASHES, np.int64)
    for row in sig:  # majority vote by position
        same = row == best
        count += np.where(same, 1, -1)
        swap = count < 0
        best[swap], count[swap] = row[swap], 1
    near = (sig == best).sum(axis=1)
    node = frame["node"].to_numpy()
    centre = int(np.lexsort((node, -near))[0])
    return pd.DataFrame({"bucket": frame["bucket"], "a": node[centre], "b": node, "sig": [bytes(frame["sig"].iloc[centre])] * len(node)})


def block_links(floor: float, percent: int):
    """One pair of blocks (sides 0 and 1, or a block with itself) of a bucket that holds several
    components: links between different components. A pair is tested by signature and then on the full sets, in
    the first band that shows it; components that a link has joined are not compared again, so at
    most one link less than the number of components leaves the task."""
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        sig = np.frombuffer(b"".join(frame["sig"]), np.uint16).reshape(len(frame), HASHES)
        node, comp, side = frame["node"].to_numpy(), frame["comp"].to_numpy().copy(), frame["side"].to_numpy()
        sets = [np.frombuffer(x, np.uint64) for x in frame["shingles"]]
        size = np.array([len(x) for x in sets])
        codes = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
        parts = np.split(codes, np.cumsum(size)[:-1])
        mark = np.zeros(int(codes.max()) + 1, np.int32)
        keys, bucket = band_keys(sig), np.uint64(int(frame["bucket"].iloc[0]) % (1 << 64))
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1)
        a, b = [], []
        for i in left.tolist():
            other = right if len(right) else left[node[left] > node[i]]
            other = other[comp[other] != comp[i]]
            other = other[(sig[other] == sig[i]).mean(axis=1) >= floor] if len(other) else other
            if not len(other):
                continue
            other = other[keys[i][(keys[other] == keys[i]).argmax(axis=1)] == bucket]
            if not len(other):
                continue
            mark[parts[i]] = 1
            same = np.add.reduceat(mark[np.concatenate([parts[j] for j in other.tolist()])],
                                   np.concatenate(([0], np.cumsum(size[other])[:-1])))
            mark[parts[i]] = 0
            for j in other[100 * same >= percent * (size[other] + size[i] - same)].tolist():
                if comp[j] != comp[i]:
                    a.append(node[i])
                    b.append(node[j])
                    comp[comp == comp[j]] = comp[i]
        a, b = np.array(a, np.int64), np.array(b, np.int64)
        return pd.DataFrame({"a": np.minimum(a, b), "b": np.maximum(a, b)})
    return run


def estimates(floor: float):
    """Pairs with both signatures: keep those whose share of equal minima is at least ``floor``."""
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                good = (_matrix(batch["sig"]) == _matrix(batch["sig_b"])).mean(axis=1) >= floor
                yield batch.select(["a", "b"]).filter(pa.array(good))
    return run


def exact_links(percent: int):
    """Pairs with both full sets: keep ``100 * intersection >= percent * union``."""
    def run(batches):
        for batch in batches:
            good = []
            for x, y in zip(batch["shingles"], batch["shingles_b"]):
                x, y = (np.frombuffer(s.as_buffer(), np.uint64) for s in (x, y))
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                same = int((both[1:] == both[:-1]).sum())
                good.append(100 * same >= percent * (len(both) - same))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))
    return run


def likely(pairs: DataFrame, nodes: DataFrame, floor: float) -> DataFrame:
    """The distinct pairs ``(a, b)`` whose signatures agree in at least ``floor`` of the minima."""
    sigs = nodes.select("node", "sig")
    pairs = written(pairs.distinct())
    half = hot_join(pairs.withColumnRenamed("a", "node"), sigs, ["node"], "inner").select(
        F.col("node").alias("a"), F.col("b").alias("node"), "sig")
    both = hot_join(half, sigs.withColumnRenamed("sig", "sig_b"), ["node"], "inner", like=pairs.select(F.col("b").alias("node")))
    return both.withColumnRenamed("node", "b").mapInArrow(estimates(floor), "a long, b long")


def full_sets(texts: DataFrame, wanted: DataFrame, shingle: int, slots: int = 1 << 20) -> DataFrame:
    """``(node, shingles)`` of the wanted nodes. Before texts are shuffled, those whose hashed id is in no
    wanted slot are left out; the broadcast list has at most ``slots`` numbers at any size of the input."""
    slot = lambda c: F.pmod(F.xxhash64(c), F.lit(slots))
    some = wanted.select(slot("node").alias("_slot")).distinct()
    near = texts.withColumn("_slot", slot("doc_id")).join(F.broadcast(some), "_slot", "left_semi")
    return (near.join(wanted, near["doc_id"] == wanted["node"], "inner").select("node", "text")
                .mapInArrow(shingle_sets(shingle), "node long, shingles binary").dropDuplicates(["node"]))


def confirm(near: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` that are links on their full sets."""
    half = hot_join(near.withColumnRenamed("a", "node"), sets, ["node"], "inner").select(
        F.col("node").alias("a"), F.col("b").alias("node"), "shingles")
    both = hot_join(half, sets.withColumnRenamed("shingles", "shingles_b"), ["node"], "inner", like=near.select(F.col("b").alias("node")))
    return both.select("a", F.col("node").alias("b"), "shingles", "shingles_b").mapInArrow(
        exact_links(percent), "a long, b long")


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5,
                    percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``.

    A null text is empty; texts without words have no shingles and are linked with nothing. A row
    without ``doc_id`` is linked with nothing and kept (``component_id`` null). Rows that share a doc_id are one
    document to the graph. Equal sets are one node. An empty table gives no rows; other columns are ignored.
    """
    rows = id_text(docs, id_col, text_col)
    signed = written(rows.mapInArrow(sign(shingle), "doc_id long, n long, digest binary, sig binary"))
    nodes = written(signed.filter("digest is not null and doc_id is not null").groupBy("digest")
                    .agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")))
    share = percent / 100
    floor = share - 5 * (share * (1 - share) / HASHES) ** 0.5

    spread = nodes.select("node", "sig").mapInArrow(to_buckets, "bucket long, node long")
    sizes = written(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1"))
    members = written(hot_join(spread, sizes, ["bucket"], "inner", total=BANDS * nodes.count(), rows_col="size"))
    pairs = (members.filter(F.col("size") <= SMALL).repartition("bucket").sortWithinPartitions("bucket", "node")
             .select("bucket", "node").mapInArrow(small_pairs, "a long, b long"))

    large = written(hot_join(members.filter(F.col("size") > SMALL), nodes.select("node", "n", "sig"), ["node"], "inner"))
    block = F.pmod(F.xxhash64("node"), F.ceil(F.col("size") / BLOCK)).cast("int")
    level = large.select("bucket", "node", "sig", block.alias("block"))
    links = level.groupBy("bucket", "block").applyInPandas(centre_links, "bucket long, a long, b long, sig binary")
    links = written(links)
    pairs = pairs.unionByName(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))
    # centres of one bucket meet in larger and larger groups: the number of blocks falls by BLOCK each level
    most = members.agg(F.max("size")).first()[0] or 0
    while most > BLOCK:
        centres = links.select("bucket", F.col("a").alias("node"), "sig").distinct()
        most = -(-most // BLOCK)
        count = max(1, -(-most // BLOCK))
        links = written(centres.withColumn("block", F.pmod(F.xxhash64("node"), F.lit(count)).cast("int"))
                        .groupBy("bucket", "block").applyInPandas(centre_links, "bucket long, a long, b long, sig binary"))
        pairs = pairs.unionByName(links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))

    near = written(likely(pairs, nodes, floor))
    wanted = written(near.select(F.col("a").alias("node")).union(near.select("b")).union(large.select("node")).distinct())
    sets = written(full_sets(rows.filter("doc_id is not null"), wanted, shingle))
    links = written(confirm(near, sets, percent))
    joined = written(components(links, "a", "b"))

    if not large.isEmpty():
        placed = written(hot_join(large.select("bucket", "node", "n", "sig", "size"), joined, ["node"], "left")
                         .withColumn("comp", F.coalesce("component", "node")).drop("component"))
        split = (placed.groupBy("bucket").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.sum("n").alias("all"),
                                              F.count(F.lit(1)).alias("rows")).filter("lo != hi")
                 .select("bucket", "rows", F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("all") / BLOCK_SHINGLES))
                         .cast("int").alias("blocks")))
        still = hot_join(placed, split, ["bucket"], "inner", rows_col="rows")
        dealt = (still.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
                 .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
                 .select("bucket", "node", "comp", "sig", F.least("mine", "other").alias("i"),
                         F.greatest("mine", "other").alias("j"), (F.col("mine") > F.col("other")).cast("int").alias("side")))
        dealt = hot_join(written(dealt), sets, ["node"], "inner")
        more = written(dealt.groupBy("bucket", "i", "j").applyInPandas(block_links(floor, percent), "a long, b long"))
        if not more.isEmpty():
            known = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
            joined = written(components(known.unionByName(more), "a", "b"))

    labels = (nodes.select("digest", "node").join(joined, "node", "left")
              .select("digest", F.coalesce("component", "node").alias("component_id")))
    out = hot_join(signed.select("doc_id", "n", "digest"), written(labels), ["digest"], "left")
    comp = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), comp.alias("component_id"),
                      F.coalesce(F.col("doc_id") == comp, F.lit(True)).alias("kept"))



#: The contract of four-word shingles in SQL: all pairs that share a shingle, confirmed on their full sets, and their closure.
ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                           '[^\x20\x09-\x0D]+') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
             ELSE list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) END) AS s FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
both_hold AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM both_hold JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, e.b FROM reach r JOIN edges e ON e.a = r.b),
low AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM low LEFT JOIN sizes USING (doc_id)
"""
