"""Exact top-k inner-product search by no-random-access aggregation.

The candidates are dealt over shards. In its shard each component is one sorted list of ``(vector, value)``. For a query a list
is read from the end where the query's component makes its entries largest. A round reads a further stretch of
every list and nothing else, and gives each candidate two bounds: what was read of it, plus for every list
that has not shown it yet the last entry read there (upper) or the list's far end (lower). A candidate whose upper bound is below the
k-th best lower bound cannot qualify any more. Reading stops when at most ``settle`` candidates are left (or the
lists end), and the scores of these are resolved exactly. All queries of a block read together: what a round has read of the lists,
from either end, is one matrix with zeros for the rest, and the bounds of all candidates and queries are its product with
the queries and the last entries read.

Each block of queries first meets one shard; the k-th score found there is a lower bound for all other shards. Every
shard is held once and the blocks of queries stream past it, so the work is queries times candidates, in blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewmatch.llm.common import partitions, written

#: How far a list has been read after each round, as a share of its length.
DEPTHS = (1 / 16, 1 / 4, 3 / 8, 1 / 2, 9 / 16, 5 / 8, 11 / 16, 3 / 4, 7 / 8, 1)
FOUND = "query_row long, query_id long, row long, vec_id long, score long"
PACKED = "dim int, block int, rows binary, ids binary, vectors binary, floors binary"


def scaled(batches):
    """``row, vec_id, asks, dim, vector`` (doubles ``floor(256 * x)``) of the vectors that take part."""
    for batch in batches:
        vectors = batch["vector"]
        flat = vectors.flatten()
        sizes = np.diff(np.asarray(vectors.offsets)) if len(vectors) else np.zeros(0, np.int64)
        sizes = np.where(np.asarray(vectors.is_valid()), sizes, 0)
        good = np.asarray(vectors.is_valid()) & np.asarray(batch["vec_id"].is_valid())
        values = flat.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        with np.errstate(invalid="ignore", over="ignore"):
            values = np.floor(256 * values)
        bad = np.concatenate(([0], np.cumsum(~np.isfinite(values))))
        good &= bad[ends] == bad[ends - sizes]
        at = np.flatnonzero(good)
        yield pa.record_batch([batch[c].take(pa.array(at)) for c in ("row", "vec_id", "asks")] + [
            pa.array(sizes[at], pa.int32()), pa.array([values[ends[k] - sizes[k]:ends[k]].tobytes() for k in at.tolist()], pa.binary())],
            names=["row", "vec_id", "asks", "dim", "vector"])


def pack(frame):
    """The rows of one group side by side in one row."""
    import pandas as pd

    frame = frame.sort_values("row")
    return pd.DataFrame({"dim": frame["dim"].iloc[:1].to_numpy(), "block": frame["block"].iloc[:1].to_numpy(),
                         "rows": [frame["row"].to_numpy(np.int64).tobytes()], "ids": [frame["vec_id"].to_numpy(np.int64).tobytes()],
                         "vectors": [b"".join(frame["vector"])], "floors": [np.full(len(frame), -np.inf).tobytes()]})


class Shard:
    """Candidates and their sorted lists, one per component."""

    def __init__(self, rows: bytes, ids: bytes, vectors: bytes, dim: int):
        self.rows, self.ids = np.frombuffer(rows, np.int64), np.frombuffer(ids, np.int64)
        self.vectors = np.frombuffer(vectors, np.float64).reshape(len(self.rows), dim)
        self.order = np.argsort(self.vectors, axis=0, kind="stable")  # a list per column, the smallest value first
        self.values = np.take_along_axis(self.vectors, self.order, 0)
        self.largest = float(np.abs(self.vectors).max(initial=0.0))

    def read(self, depth: float, kind) -> tuple[int, np.ndarray, np.ndarray]:
        """The lists read to ``depth``: how many entries of each, the values read from the lists' far and near ends (else 0), and a 1
        for every entry read."""
        n, dim = self.vectors.shape
        upto = min(n, max(1, int(n * depth)))
        marks = np.zeros((n, 2 * dim), kind)
        lists = np.arange(dim)
        marks[self.order[n - upto:], lists] = 1
        marks[self.order[:upto], dim + lists] = 1
        return upto, np.tile(self.vectors, 2).astype(kind) * marks, marks

    def search(self, queries: np.ndarray, own: np.ndarray, floors: np.ndarray, k: int, settle: int) -> list[list[tuple[int, int, int]]]:
        """Per query ``(score, vec_id, row)`` of the best k candidates among those that reach its floor, best first."""
        n, dim = self.vectors.shape
        out: list = [None] * len(queries)
        floors = floors.copy()
        total = self.largest * np.abs(queries).sum(1)
        kind = np.float32 if total.max(initial=0.0) < 2 ** 23 else np.float64
        slack = total * (1e-5 if kind == np.float32 else 1e-9)  # over the rounding of all sums
        both = np.hstack([np.maximum(queries, 0), np.minimum(queries, 0)])  # read from the far end, from the near end
        far = both * np.hstack([self.values[0], self.values[-1]])
        place = {row: j for j, row in enumerate(self.rows.tolist())}
        mine = np.array([place.get(int(row), -1) for row in own])
        open_ = np.arange(len(queries))
        for depth in DEPTHS:
            if n <= settle or not dim or not len(open_):
                break
            upto, values, marks = self.read(depth, kind)
            last = both[open_] * np.hstack([self.values[n - upto], self.values[upto - 1]])
            seen = values @ both[open_].T.astype(kind)
            upper = seen - marks @ last.T.astype(kind) + last.sum(1).astype(kind)
            held = np.flatnonzero(mine[open_] >= 0)
            new = np.flatnonzero(floors[open_] == -np.inf)
            if len(new) and n > k:
                low = seen[:, new] - marks @ far[open_[new]].T.astype(kind) + far[open_[new]].sum(1).astype(kind)
                hit = np.flatnonzero(mine[open_[new]] >= 0)
                low[mine[open_[new[hit]]], hit] = -np.inf
                floors[open_[new]] = np.partition(low, n - k, axis=0)[n - k] - slack[open_[new]]
            upper[mine[open_[held]], held] = -np.inf
            alive = upper >= floors[open_] - slack[open_]
            done = alive.sum(0) <= settle
            for j in np.flatnonzero(done).tolist():
                q = open_[j]
                out[q] = self.resolve(queries[q], np.flatnonzero(alive[:, j]), floors[q], k)
            open_ = open_[~done]
        for q in open_.tolist():
            out[q] = self.resolve(queries[q], np.flatnonzero(np.arange(n) != mine[q]), floors[q], k)
        return out

    def resolve(self, query: np.ndarray, alive: np.ndarray, floor: float, k: int) -> list[tuple[int, int, int]]:
        """The final scores of the candidates that are left."""
        if self.largest * float(np.abs(query).sum()) < 2 ** 52:
            scores = (self.vectors[alive] @ query).astype(np.int64)
            kept = scores >= floor
            if kept.sum() > k:  # ties at the k-th score stay
                kept = scores >= max(floor, np.partition(scores, len(scores) - k)[len(scores) - k])
            alive, scores = alive[kept], scores[kept].tolist()
        else:
            whole = [int(x) for x in query]
            scores = [sum(a * int(b) for a, b in zip(whole, self.vectors[j])) for j in alive.tolist()]
        best = sorted((-s, int(self.ids[j]), int(self.rows[j])) for s, j in zip(scores, alive.tolist()) if s >= floor)
        return [(-s, vec, row) for s, vec, row in best[:k]]


def meet(k: int, settle: int | None, first: bool):
    """Per shard (``kind`` 0) the blocks of queries that follow it. ``first``: gives the blocks with the k-th scores found as
    ``floors``, else the rows found."""
    def run(batches):
        shard = None
        for batch in batches:
            rows, ids, scores, queries, names = [], [], [], [], []
            blocks = []
            for r in batch.to_pylist():
                if r["kind"] == 0:
                    shard = ((r["dim"], r["shard"]), Shard(r["rows"], r["ids"], r["vectors"], r["dim"]))
                    continue
                if shard is None or shard[0] != (r["dim"], r["shard"]):
                    raise ValueError("a block of queries without its shard")
                own, name = np.frombuffer(r["rows"], np.int64), np.frombuffer(r["ids"], np.int64)
                query = np.frombuffer(r["vectors"], np.float64).reshape(len(own), r["dim"])
                floors = np.frombuffer(r["floors"], np.float64).copy()
                answers = shard[1].search(query, own, floors, k, settle or max(64, 8 * k, len(shard[1].rows) // 8))
                for q, got in enumerate(answers):
                    if first:
                        floors[q] = got[k - 1][0] if len(got) >= k else -np.inf
                    else:
                        queries += [int(own[q])] * len(got)
                        names += [int(name[q])] * len(got)
                        scores += [s for s, _, _ in got]
                        ids += [v for _, v, _ in got]
                        rows += [x for _, _, x in got]
                if first:
                    blocks.append((r["dim"], r["block"], r["rows"], r["ids"], r["vectors"], floors.tobytes()))
            if first:
                kinds = [pa.int32(), pa.int32()] + [pa.binary()] * 4
                yield pa.record_batch([pa.array(c, t) for c, t in zip(list(zip(*blocks)) or [[]] * 6, kinds)],
                                      names=["dim", "block", "rows", "ids", "vectors", "floors"])
            else:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in (queries, names, rows, ids, scores)],
                                      names=["query_row", "query_id", "row", "vec_id", "score"])
    return run


def _past_shards(shards: DataFrame, blocks: DataFrame, k: int, settle: int | None, first: bool, tasks: int) -> DataFrame:
    """Every block of queries (with its ``shard``) after its shard, in the shard's task."""
    cols = ["dim", "shard", "kind", "block", "rows", "ids", "vectors", "floors"]
    both = shards.select("dim", F.col("block").alias("shard"), F.lit(0).alias("kind"), F.lit(0).alias("block"), *cols[4:]).unionByName(
        blocks.withColumn("kind", F.lit(1)).select(*cols))
    # shards are numbered from 0, so this deals them evenly
    return (both.repartitionById(tasks, F.pmod("shard", F.lit(tasks))).sortWithinPartitions("dim", "shard", "kind", "block")
                .mapInArrow(meet(k, settle, first), PACKED if first else FOUND))


def top_k(table: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", settle: int | None = None,
          shard_rows: int = 2048, block_rows: int = 512) -> DataFrame:
    """``query_id, rank, vec_id, score``: for every row that ``is_query`` names, the ``k`` other rows with the highest
    inner product of the whole numbers ``floor(256 * x)``, ties to the smaller id.

    Vectors that are null or hold a null or non-finite component, and rows without an id, take no part. Only vectors of the query's
    length are its candidates. ``settle`` is by default the largest of 64, ``8 * k`` and an eighth of a shard. Rows are told apart by their place, not their id: a row that repeats another
    is a candidate for it, and a query of its own. Fewer than ``k`` candidates give all. An empty
    table gives no rows, an empty vector scores 0, and other columns are ignored. Scores outside a LONG are an error.
    """
    spark = table.sparkSession
    plain = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("vector"),
                         F.coalesce(is_query, F.lit(False)).alias("asks")).withColumn("row", F.monotonically_increasing_id())
    rows = written(plain.select("row", "vec_id", "asks", "vector")
                        .mapInArrow(scaled, "row long, vec_id long, asks boolean, dim int, vector binary"))
    counts = rows.groupBy("dim").agg(F.count(F.lit(1)).alias("_n"))

    def packed(part: DataFrame, size: int, each: int) -> DataFrame:
        """Groups of about ``each`` rows of one length."""
        n = max(1, -(-size // each))
        return written(part.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(n)).cast("int"))
                           .groupBy("dim", "block").applyInPandas(pack, PACKED))

    total = counts.agg(F.sum("_n")).first()[0] or 0
    shards = packed(rows, total, shard_rows)
    queries = rows.filter("asks")
    blocks = packed(queries, queries.count(), block_rows)
    keys = shards.select("dim", F.col("block").alias("shard"))
    tasks = max(partitions(spark), -(-total // (8 * shard_rows)))
    # one shard per block first, chosen by the block's number among those of its length
    numbered = keys.withColumn("_k", F.row_number().over(Window.partitionBy("dim").orderBy("shard")) - 1)
    many = keys.groupBy("dim").agg(F.count(F.lit(1)).alias("_many"))
    start = (blocks.join(many.hint("merge"), "dim").withColumn("_k", F.pmod("block", "_many"))
                   .join(numbered.hint("merge"), ["dim", "_k"]).drop("_k", "_many"))
    seeded = written(_past_shards(shards, start, k, settle, True, tasks))
    every = seeded.join(keys.hint("merge"), "dim")
    found = _past_shards(shards, every, k, settle, False, tasks)
    best = Window.partitionBy("query_row").orderBy(F.col("score").desc(), "vec_id", "row")
    return (found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
                 .select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"))


ORACLE = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
