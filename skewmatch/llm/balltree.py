"""Exact ranked lexical search by a sparse ball tree.

A document is a sparse vector over terms: ``(1000000000 * tf) div (1000 * tf + 12 * m)`` per term; an item is one of the
weights of its terms, and the score is their inner product. Documents are dealt over shards. Per block of items the vectors of a shard are
cut down to the block's terms (no score changes) and form a ball tree: each node has the mean of its vectors and the largest
distance from it, so no document below scores more than ``item . centre + |item| * radius``. That bound is rounded up
by more than all rounding of its doubles. Each item visits the nodes best first, from the score it has to beat, scores the documents
of a leaf exactly in whole numbers, and stops at the first bound that can't reach its k-th score. The shards of a task
follow each other, so later ones start from the k-th score of earlier ones.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewmatch.llm.common import partitions, written

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")  # in UTF-8: no ASCII but letters and digits
SLOTS = 1 << 20
LEAF = 24
SHARD = "terms array<binary>, held array<int>, ids binary, sizes binary, starts binary, codes binary, counts binary, texts long, words long, task int, place int"


def terms_of(text: bytes) -> list[bytes]:
    return TERM.findall(text.lower())  # lower() of bytes changes A-Z only


def slot_of(term: bytes) -> int:
    import zlib

    return zlib.crc32(term) % SLOTS


def item_terms(batches):
    """One row per item and term: ``item, item_id, term, times``."""
    for batch in batches:
        out = [(row, item, term, n) for row, item, text in zip(batch["item"].to_pylist(), batch["item_id"].to_pylist(), batch["text"].to_pylist())
               for term, n in Counter(terms_of((text or "").encode())).items()]
        kinds = [pa.int64(), pa.int64(), pa.binary(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*out)) or [[]] * 4, kinds)], names=["item", "item_id", "term", "times"])


def shards_of(slots: bytes, most_docs: int, most_terms: int):
    """Documents as packed sparse rows of the terms whose slot is in ``slots``, a shard at a time. Documents that hold none of
    these count in ``texts`` and ``words`` (all terms of the shard's texts) only."""
    def run(batches):
        wanted = np.unpackbits(np.frombuffer(slots, np.uint8))
        known: dict[bytes, int] = {}  # the code of a term in the present shard, -1 if it isn't wanted
        terms: list[bytes] = []
        ids, sizes, codes, counts, starts, texts, words = [], [], [], [], [0], 0, 0
        place = 0

        def shard():
            flat = np.array(codes, np.int32)
            held = np.bincount(flat, minlength=len(terms)) if len(flat) else np.zeros(len(terms), np.int64)
            missing = np.array([x is None for x in ids], bool)
            row = [terms, held.astype(np.int32).tolist(),
                   (np.array([0 if x is None else x for x in ids], np.int64).tobytes() + missing.tobytes()),
                   np.array(sizes, np.int64).tobytes(), np.array(starts, np.int64).tobytes(), flat.tobytes(),
                   np.array(counts, np.int32).tobytes(), texts, words, TaskContext.get().partitionId(), place]
            kinds = [pa.list_(pa.binary()), pa.list_(pa.int32())] + [pa.binary()] * 5 + [pa.int64()] * 2 + [pa.int32()] * 2
            return pa.record_batch([pa.array([x], t) for x, t in zip(row, kinds)],
                                   names=["terms", "held", "ids", "sizes", "starts", "codes", "counts", "texts", "words", "task", "place"])

        for batch in batches:
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                found = Counter(terms_of((text.as_py() or "").encode()))
                if not found:
                    continue
                size = found.total()
                texts, words = texts + 1, words + size
                mine = len(codes)
                for term, n in found.items():
                    code = known.get(term)
                    if code is None:
                        code = len(terms) if wanted[slot_of(term)] else -1
                        known[term] = code
                        if code >= 0:
                            terms.append(term)
                    if code >= 0:
                        codes.append(code)
                        counts.append(n)
                if len(codes) > mine:
                    ids.append(doc)
                    sizes.append(size)
                    starts.append(len(codes))
                if len(ids) >= most_docs or len(codes) >= most_terms or len(known) >= most_terms:
                    yield shard()
                    place += 1
                    known, terms = {}, []
                    ids, sizes, codes, counts, starts, texts, words = [], [], [], [], [0], 0, 0
        if texts:
            yield shard()
    return run


def pack_items(frame):
    """A block of items: its terms and, per item, codes and weights."""
    import pandas as pd

    frame = frame.sort_values(["item", "term"])
    code, term = pd.factorize(frame["term"])
    item, first = np.unique(frame["item"].to_numpy(np.int64), return_index=True)
    starts = np.append(first, len(frame)).astype(np.int64)
    missing = frame["item_id"].isna().to_numpy()[first]
    ids = frame["item_id"].fillna(0).to_numpy(np.int64)[first]
    return pd.DataFrame({"block": frame["block"].iloc[:1].to_numpy(), "terms": [list(term)], "held": [[]],
                         "ids": [ids.tobytes() + missing.tobytes()], "sizes": [item.tobytes()], "starts": [starts.tobytes()],
                         "codes": [code.astype(np.int32).tobytes()], "counts": [frame["weight"].to_numpy(np.int64).tobytes()]})


def _rows(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The places of the entries of some rows, one row after the other, and where each row begins among them."""
    size = starts[rows + 1] - starts[rows]
    begin = np.concatenate(([0], np.cumsum(size)))
    return np.repeat(starts[rows] - begin[:-1], size) + np.arange(begin[-1]), begin[:-1]


class Tree:
    """A ball tree over sparse rows; none of the rows is empty."""

    def __init__(self, starts: np.ndarray, codes: np.ndarray, values: np.ndarray, width: int, leaf: int = LEAF):
        self.starts, self.codes, self.values = starts, codes, values
        real = values.astype(np.float64)
        norm = np.add.reduceat(real * real, starts[:-1]) if len(starts) > 1 else np.zeros(0)
        self.kids, self.docs = [], []
        centres, radii = [], []
        todo = [np.arange(len(starts) - 1)]
        while todo:  # nodes in the order of their numbers
            docs = todo.pop(0)
            at, begin = _rows(starts, docs)
            code, value = codes[at], real[at]
            centre = np.bincount(code, value, width) / max(1, len(docs))

            def dot(v):
                return np.add.reduceat(value * v[code], begin)

            away = norm[docs] - 2 * dot(centre) + centre @ centre
            # rounding: each sum has at most `width` terms no larger than the norms
            slop = 1e-12 * (norm[docs] + centre @ centre)
            centres.append(centre)
            radii.append(float(np.sqrt(np.maximum(away + slop, 0)).max(initial=0.0)) * (1 + 1e-12))
            self.docs.append(docs)
            if len(docs) <= leaf:
                self.kids.append(None)
                continue
            one = self._row(docs[int(np.argmax(away))], real, width)
            far = norm[docs] - 2 * dot(one)
            other = self._row(docs[int(np.argmax(far))], real, width)
            side = np.argsort(dot(one - other), kind="stable")
            half = len(docs) // 2
            first = len(self.docs) + len(todo)
            self.kids.append((first, first + 1))
            todo += [docs[np.sort(side[:half])], docs[np.sort(side[half:])]]
        self.centres, self.radii = np.array(centres), np.array(radii)

    def _row(self, doc: int, real: np.ndarray, width: int) -> np.ndarray:
        out = np.zeros(width)
        part = slice(self.starts[doc], self.starts[doc + 1])
        out[self.codes[part]] = real[part]
        return out

    def bounds(self, items: np.ndarray) -> np.ndarray:
        """Per node and item (columns of ``items``) no less than any score below the node."""
        near = self.centres @ items
        reach = np.outer(self.radii, np.sqrt((items * items).sum(0)) * (1 + 1e-12))
        return (near + reach) * (1 + 1e-9) + 1


def nearest(tree: Tree, weights: np.ndarray, bound: np.ndarray, ids: np.ndarray, best: list, k: int) -> int:
    """Puts one item's best documents of the tree into the heap ``best`` of ``(score, -doc_id)``; gives the documents scored."""
    queue, scored = [(-bound[0], 0)], 0
    while queue:
        upper, node = heapq.heappop(queue)
        if -upper < (best[0][0] if len(best) >= k else 1):
            break
        if tree.kids[node] is not None:
            for kid in tree.kids[node]:
                heapq.heappush(queue, (-bound[kid], kid))
            continue
        docs = tree.docs[node]
        scored += len(docs)
        at, begin = _rows(tree.starts, docs)
        score = np.add.reduceat(tree.values[at] * weights[tree.codes[at]], begin)
        floor = best[0][0] if len(best) >= k else 1
        for j in np.flatnonzero(score >= floor).tolist():
            entry = (int(score[j]), -int(ids[docs[j]]))
            if len(best) < k:
                heapq.heappush(best, entry)
            else:
                heapq.heappushpop(best, entry)
    return scored


def cut_shard(row: dict, terms: dict[bytes, int], texts: int, words: int):
    """A shard's documents over a block's terms: ids and sparse rows (starts, codes, values)."""
    data = row["ids"]
    n = len(data) // 9
    ids = np.frombuffer(data, np.int64, n).copy()
    ids[np.frombuffer(data, bool, n, 8 * n)] = np.iinfo(np.int64).min + 1  # rows without an id rank first among equals
    sizes, starts = np.frombuffer(row["sizes"], np.int64), np.frombuffer(row["starts"], np.int64)
    code = np.array([terms.get(t, -1) for t in row["terms"]], np.int32)[np.frombuffer(row["codes"], np.int32)]
    tf = np.frombuffer(row["counts"], np.int32).astype(np.int64)
    doc = np.repeat(np.arange(n), np.diff(starts))
    keep = code >= 0
    m = np.array([75 + 25 * s * texts // words for s in sizes.tolist()], np.int64)
    doc, code, tf = doc[keep], code[keep], tf[keep]
    value = 1_000_000_000 * tf // (1000 * tf + 12 * m[doc])
    held = np.bincount(doc, minlength=n)
    some = held > 0
    return ids[some], np.concatenate(([0], np.cumsum(held[some]))), code, value


def search(k: int, texts: int, words: int):
    """Shards after their block of items (``kind`` 0): the best documents of every item in the task."""
    def run(batches):
        now, items, best = None, None, []

        def found():
            rows = [(items["row"][j], items["id"][j], None if doc == np.iinfo(np.int64).min + 1 else doc, score)
                    for j, heap in enumerate(best) for score, doc in ((s, -d) for s, d in heap)]
            return pa.record_batch([pa.array(c, pa.int64()) for c in (list(zip(*rows)) or [[]] * 4)],
                                   names=["item", "item_id", "doc_id", "score"])

        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                if row["kind"] == 0:
                    if now == row["block"]:
                        continue
                    if now is not None:
                        yield found()
                    now = row["block"]
                    rows = np.frombuffer(row["sizes"], np.int64)
                    n = len(rows)
                    names = np.frombuffer(row["ids"], np.int64, n).tolist()
                    gone = np.frombuffer(row["ids"], bool, n, 8 * n)
                    weights = np.zeros((n, len(row["terms"])), np.int64)
                    weights[np.repeat(np.arange(n), np.diff(np.frombuffer(row["starts"], np.int64))),
                            np.frombuffer(row["codes"], np.int32)] = np.frombuffer(row["counts"], np.int64)
                    items = {"row": rows.tolist(), "id": [None if g else x for x, g in zip(names, gone)], "weights": weights,
                             "columns": np.ascontiguousarray(weights.T.astype(np.float64)), "terms": {t: c for c, t in enumerate(row["terms"])}}
                    best = [[] for _ in range(n)]
                    continue
                if now != row["block"]:  # no item fell in this block
                    continue
                ids, starts, codes, values = cut_shard(row, items["terms"], texts, words)
                if not len(ids):
                    continue
                tree = Tree(starts, codes, values, len(items["terms"]))
                bounds = tree.bounds(items["columns"])
                for j, heap in enumerate(best):
                    nearest(tree, items["weights"][j], bounds[:, j], ids, heap, k)
        if now is not None:
            yield found()
    return run


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text: str = "text", shard_docs: int = 2048, shard_terms: int = 1 << 20, block_items: int = 256) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``k`` documents with the highest score above 0, ties to the smaller id.

    A null or empty text holds no terms: as a document it is not counted and never found, as an item it finds nothing. Texts of
    any length are read whole. Rows that repeat are documents and items of their own; rows without ``doc_id`` come first among equal
    scores. Empty tables give no rows; other columns are ignored. The weight of a term is ``floor(1000 * ln((2N + 2) /
    (2 df + 1)))`` over all documents. The driver gets two sums and a bit map of 2**20 slots of the items' terms.
    """
    spark = docs.sparkSession
    asked = written(items.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).cast("string").alias("text"))
                         .withColumn("item", F.monotonically_increasing_id()).select("item", "item_id", "text")
                         .mapInArrow(item_terms, "item long, item_id long, term binary, times long"))
    # a slot is a CRC-32, as slot_of() takes it; at most SLOTS numbers
    marks = np.zeros(SLOTS, np.uint8)
    marks[[r[0] for r in asked.select((F.crc32("term") % SLOTS).cast("int").alias("s")).distinct().collect()]] = 1
    read = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    shards = written(read.mapInArrow(shards_of(np.packbits(marks).tobytes(), shard_docs, shard_terms), SHARD))
    sums = shards.agg(F.sum("texts"), F.sum("words"), F.count(F.lit(1)), F.max("task")).first()
    texts, words, pieces, last = (x or 0 for x in sums)
    held = (shards.select(F.explode(F.arrays_zip("terms", "held")).alias("t")).groupBy(F.col("t.terms").alias("term"))
                  .agg(F.sum("t.held").alias("df")))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * texts + 2)) / (2 * F.coalesce("df", F.lit(0)) + 1))).cast("long")
    vocabulary = asked.select("term").distinct().join(held.hint("merge"), "term", "left").select("term", weight.alias("weight"))
    n_items = asked.agg(F.count_distinct("item")).first()[0]
    blocks = max(1, -(-n_items // block_items))
    packed = written(asked.join(vocabulary.hint("merge"), "term").withColumn("weight", F.col("weight") * F.col("times"))
                     .withColumn("block", F.pmod(F.xxhash64("item"), F.lit(blocks)).cast("int"))
                     .groupBy("block").applyInPandas(pack_items, "block int, " + SHARD.split(", texts")[0]))
    tasks = max(partitions(spark), pieces // 8 + 1)
    cols = ["block", "part", "kind", "terms", "ids", "sizes", "starts", "codes", "counts"]
    heads = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(tasks - 1)))).withColumn("kind", F.lit(0)).select(*cols)
    # the first shard of every task of the scan, then the second ones, ...: dealt out evenly
    follow = (shards.withColumn("part", F.pmod(F.col("place") * (last + 1) + F.col("task"), F.lit(tasks))).withColumn("kind", F.lit(1))
                    .withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(*cols))
    found = (heads.unionByName(follow).repartitionById(tasks, F.pmod(F.col("block") + F.col("part"), F.lit(tasks))).sortWithinPartitions("block", "part", "kind")
                  .mapInArrow(search(k, texts, words), "item long, item_id long, doc_id long, score long"))
    best = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                 .select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"))


_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term"""
ORACLE = f"""
WITH words AS (SELECT doc_id, {_TERMS} FROM documents),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
total AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS terms FROM size),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
asked AS (SELECT item_id, term, count(*)::BIGINT AS times FROM (SELECT item_id, {_TERMS} FROM benchmark) GROUP BY ALL),
weight AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, total),
score AS (SELECT item_id, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms))))::BIGINT AS score
          FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), total GROUP BY ALL),
place AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank FROM score WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM place WHERE rank <= 20
"""
