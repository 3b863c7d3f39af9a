"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import hot_join, partitions, written

#: Edges that a task holds at once, and edges of a table per task.
CHUNK = 1 << 17
TASK_EDGES = 50_000


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same components as the edges ``u, v``, as ``(node, smallest node)`` of every node but the smallest ones."""
    nodes, codes = np.unique(np.concatenate((u, v)), return_inverse=True)
    a, b = codes[:len(u)], codes[len(u):]
    low = np.arange(len(nodes))
    while True:
        x, y = low[a], low[b]
        if (x == y).all():
            break
        np.minimum.at(low, np.maximum(x, y), np.minimum(x, y))  # each root but those below all their neighbours
        while not (low == low[low]).all():
            low = low[low]
    own = low == np.arange(len(nodes))
    return nodes[~own], nodes[low[~own]]


def local_stars(batches):
    """Edges ``u, v`` without nulls, at most about ``CHUNK`` at a time, replaced by the stars of their components."""
    held, n = [], 0
    for batch in batches:
        held.append((batch["u"].to_numpy(), batch["v"].to_numpy()))
        n += batch.num_rows
        if n >= CHUNK:
            yield _stars_of(held)
            held, n = [], 0
    if n:
        yield _stars_of(held)


def _stars_of(held: list) -> pa.RecordBatch:
    u, v = stars(*(np.concatenate(x) for x in zip(*held)))
    return pa.record_batch([pa.array(u), pa.array(v)], names=["u", "v"])


def _neighbour_min(edges: DataFrame) -> DataFrame:
    return edges.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("rows"))


def large_star(edges: DataFrame, total: int) -> DataFrame:
    """Every neighbour larger than ``u`` is linked to the smallest of ``u`` and its neighbours."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = _neighbour_min(both).withColumn("m", F.least("m", "u"))
    return (hot_join(both, low, ["u"], "inner", total=2 * total, rows_col="rows").filter("v > u and v != m")
            .select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())


def small_star(edges: DataFrame, total: int) -> DataFrame:
    """``u`` and its smaller neighbours are linked to the smallest of them (``u > v`` in every edge)."""
    low = _neighbour_min(edges)
    near = hot_join(edges, low, ["u"], "inner", total=total, rows_col="rows").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.unionByName(low.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """``(node, component)`` for every node of an edge: the smallest node it is connected with.

    Ends are longs. Null ends and loops are ignored; repeated and reversed edges count once; no edges give no rows.
    Each task first replaces its edges by stars, which takes most of the rounds. Each round is written to the shared folder,
    in files of about ``TASK_EDGES`` edges, so lineage stays short. The rounds end when nothing
    changes (at most about the squared logarithm of the largest component).
    """
    spark = edges.sparkSession
    edges = written(edges.filter(F.col(u).isNotNull() & F.col(v).isNotNull() & (F.col(u) != F.col(v)))
                    .select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).mapInArrow(local_stars, "u long, v long"))
    state = None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == state or not now[0]:
            break
        state = tuple(now)
        tasks = min(partitions(spark), max(spark.sparkContext.defaultParallelism, now[0] // TASK_EDGES))
        large = written(large_star(edges, now[0]).coalesce(tasks))
        edges = written(small_star(large, now[0]).coalesce(tasks))
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component"))).distinct()
