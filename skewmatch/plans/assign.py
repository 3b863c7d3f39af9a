"""Order match tasks by cost and assign them to reducers.

The assignment is the greedy rule: take tasks by falling cost (ties by task
key) and give each to the reducer with the least load so far, the lowest
reducer id on a tie. The rule is sequential, so its one task holds the loads of all
reducers as its only state, but it neither reads nor writes a row per match task. It reads
runs of equal cost, one row per distinct cost: whole blocks have
at most about ``sqrt(2 * entities)`` distinct costs, and cut blocks add at most
their bounded number of tasks. Of a run it writes progressions ``(first, step, count, reducer)``: the
reducer takes the tasks of rank ``first``, ``first + step``, ...

Within a run the picks are the merged progressions ``load + m * cost``. As long as the reducers that
have joined in are below the load of the next one they take turns in a fixed order, so a run is at most ``reducers``
phases of one progression per reducer. Spark expands the progressions and joins them to the tasks by rank.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.operators.ordinal import ordinal


def tasks_by_cost(tasks: DataFrame, key: list[str], name: str = "rank", cost: str = "comps") -> DataFrame:
    """Add ``rank``: 0 for the costliest task, ties broken by the task key."""
    return ordinal(tasks, [F.col(cost).desc()] + [F.col(k).asc() for k in key], name)


def deal_run(heap: list[tuple[int, int]], cost: int, first: int, k: int) -> list[tuple[int, int, int, int]]:
    """Deal ``k`` tasks of one cost from rank ``first`` on; ``heap`` has ``(load, reducer)`` and is brought up to date.
    Gives ``(first, step, count, reducer)``."""
    out = []
    if cost == 0:  # nobody's load rises
        return [(first, 1, k, heap[0][1])] if k else out
    # the first few picks one by one: they bring most reducers together
    for _ in range(min(k, 2 * len(heap))):
        load, r = heap[0]
        heapq.heapreplace(heap, (load + cost, r))
        out.append((first, 1, 1, r))
        first, k = first + 1, k - 1
    if not k:
        return out
    waiting = sorted(heap)
    turns = [waiting.pop(0)]  # by (load, reducer): the order in which those that have joined in take turns
    while k:
        if waiting:
            load, r = waiting[0]
            picks = [max(0, -((mine - load) // cost)) + (mine <= load and (load - mine) % cost == 0 and who < r) for mine, who in turns]
            total = min(k, sum(picks))
        else:
            total = k
        step = len(turns)
        counts = [max(0, -((at - total) // step)) for at in range(step)]
        out += [(first + at, step, n, who) for at, (n, (_, who)) in enumerate(zip(counts, turns)) if n]
        turns = sorted((mine + n * cost, who) for n, (mine, who) in zip(counts, turns))
        first, k = first + total, k - total
        if waiting:
            turns = sorted([*turns, waiting.pop(0)])
    heap[:] = sorted([*turns, *waiting])
    return out


def _dealer(reducers: int, piece: int = 100_000):
    """Greedy over runs ``(cost, first, k)`` by falling cost, as a ``mapInPandas`` function. A progression has at most ``piece`` ranks."""
    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        heap = [(0, r) for r in range(reducers)]
        for batch in batches:
            out = []
            for cost, first, k in zip(batch["cost"].tolist(), batch["first"].tolist(), batch["k"].tolist()):
                for at, step, count, r in deal_run(heap, int(cost), first, k):
                    out += [(at + step * done, step, min(piece, count - done), r) for done in range(0, count, piece)]
            yield pd.DataFrame(out, columns=["first", "step", "count", "reducer"])
    return deal


def assign_reducers(tasks: DataFrame, reducers: int, key: list[str], cost: str = "comps") -> DataFrame:
    """Add ``rank`` and ``reducer`` (0..reducers-1) to every task."""
    ranked = tasks_by_cost(tasks, key, cost=cost)
    runs = ranked.groupBy(F.col(cost).alias("cost")).agg(F.min("rank").alias("first"), F.count(F.lit(1)).alias("k"))
    dealt = (runs.repartition(1).sortWithinPartitions(F.col("cost").desc())
                 .mapInPandas(_dealer(reducers), "first long, step long, count long, reducer int"))
    last = F.col("first") + F.col("step") * (F.col("count") - 1)
    n = int(tasks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    picks = dealt.repartition(n, "first").select(F.explode(F.sequence("first", last, "step")).alias("rank"), "reducer")
    return ranked.join(picks, "rank")


def reducer_load(assigned: DataFrame, cost: str = "comps") -> DataFrame:
    """Comparisons (or the sum of another cost) and tasks per reducer: ``(reducer, comps, tasks)``."""
    return assigned.groupBy("reducer").agg(F.sum(cost).alias(cost),
                                           F.count(F.lit(1)).alias("tasks"))
