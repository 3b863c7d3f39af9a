"""Routing: copy each entity to the match tasks it takes part in, and place
every task on the partition of its reducer.

Each entity looks up its block once, a many-to-one join on ``block`` against a
table with one row per block. The rows of a hot block are dealt over salts and
its table row is repeated per salt (:func:`plan_lookup`), so no task holds a
whole hot block.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.operators.distribution import with_totals
from skewmatch.operators.ordinal import positions


def plan_lookup(keyed: DataFrame, blocks: DataFrame, sizes: DataFrame, partitions: int | None = None,
                key: list[str] | None = None, salt_by: str = "id") -> DataFrame:
    """Every entity joined with the row of its block (statistics and tasks).

    ``sizes`` gives ``(block, n)``. A block with more than ``1 / partitions`` of
    all entities is hot: there are fewer than ``partitions`` of these, so their
    table is broadcast. A hot block gets one salt per partition's worth of
    entities, at most ``2 * partitions`` extra table rows in all. ``key`` names other key columns than ``block``.
    """
    key = key or ["block"]
    width = partitions or int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = sizes.agg(F.sum("n").alias("_total"))
    hot = (with_totals(sizes.select(*key, "n"), total)
           .withColumn("_salts", F.ceil(F.col("n") * F.lit(float(width)) / F.col("_total")).cast("long"))
           .filter(F.col("_salts") > 1).select(*key, "_salts"))
    salts = F.coalesce(F.col("_salts"), F.lit(1).cast("long"))
    rows = (keyed.join(F.broadcast(hot), key, "left")
                 .withColumn("_salt", F.pmod(F.xxhash64(salt_by), salts)).drop("_salts"))
    table = (blocks.join(F.broadcast(hot), key, "left")
                   .withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("_salts"))
    return rows.join(table, [*key, "_salt"]).drop("_salt")


def split_tasks_by_block(stats: DataFrame, assigned: DataFrame) -> DataFrame:
    """One row per block: ``(block, oversized, tasks ARRAY<(i, j, reducer)>)``.

    A block has at most ``parts * (parts + 1) / 2`` tasks, so each list is
    bounded by the plan, not by the data.
    """
    tasks = assigned.groupBy("block").agg(
        F.collect_list(F.struct("i", "j", "reducer")).alias("tasks"))
    return stats.select("block", "oversized").join(tasks, "block")


def split_route(keyed: DataFrame, stats: DataFrame, assigned: DataFrame, carry: tuple = ("id", "text")) -> DataFrame:
    """``(reducer, block, i, j, part, oversized, id, text)`` for every (entity, task); ``carry`` names other columns to take along.

    A block that is not oversized sends each entity once, to ``(block, 0, 0)``;
    in an oversized block an entity of part ``p`` goes to every task with
    ``i = p`` or ``j = p``.
    """
    info = split_tasks_by_block(stats, assigned)
    mine = F.filter("tasks", lambda t: ~F.col("oversized") | (t["i"] == F.col("part"))
                    | (t["j"] == F.col("part")))
    return (plan_lookup(keyed, info, stats)
            .select("block", "part", "oversized", *carry, F.explode(mine).alias("t"))
            .select(F.col("t.reducer").alias("reducer"), "block", F.col("t.i").alias("i"),
                    F.col("t.j").alias("j"), "part", "oversized", *carry))


def entity_positions(keyed: DataFrame) -> DataFrame:
    """Add ``pos``: the place of each entity in its block (0..n-1), by id."""
    return positions(keyed, ["block"], "id", "pos")


def slice_tasks_by_block(assigned: DataFrame) -> DataFrame:
    """One row per block: ``(block, slices ARRAY<(slice, start, u, reducer)>)``."""
    return assigned.groupBy("block").agg(
        F.collect_list(F.struct("slice", "start", "u", "reducer")).alias("slices"))


def slice_route(positioned: DataFrame, stats: DataFrame, assigned: DataFrame) -> DataFrame:
    """``(reducer, block, slice, pos, replicated, id, text)`` for every (entity, slice).

    In slice ``s`` the positions ``[start, start + u)`` are its own, later ones
    are copies (``replicated``), earlier ones are absent. Slice 0 holds the
    last ``rem`` entities, all its own.
    """
    info = slice_tasks_by_block(assigned)
    mine = F.filter("slices", lambda s: F.col("pos") >= s["start"])
    return (plan_lookup(positioned, info, stats)
            .select("block", "pos", "id", "text", F.explode(mine).alias("s"))
            .select(F.col("s.reducer").alias("reducer"), "block", F.col("s.slice").alias("slice"), "pos",
                    (F.col("pos") >= F.col("s.start") + F.col("s.u")).alias("replicated"),
                    "id", "text"))


def slice_copies(positioned: DataFrame, stats: DataFrame, assigned: DataFrame, carry: tuple = ("id", "text")) -> DataFrame:
    """``(reducer, block, pos, own, ...)``: every entity once per reducer that has a slice it takes part in.

    The slices of a block that land on one reducer are merged: ``own`` says that the entity's own slice is one of them. The
    reducer then owes every pair of an own entity and a later one (own or not), which are the pairs of its slices: of two entities the
    earlier one's slice has the pair. An entity has at most ``reducers`` copies, however many slices its block has.
    """
    info = slice_tasks_by_block(assigned)
    pos = F.col("pos")
    mine = F.filter("slices", lambda s: pos >= s["start"])
    owner = F.filter("slices", lambda s: (pos >= s["start"]) & (pos < s["start"] + s["u"]))[0]["reducer"]
    return (plan_lookup(positioned, info, stats)
            .select("block", "pos", *carry, owner.alias("owner"), F.explode(F.array_distinct(F.transform(mine, lambda s: s["reducer"]))).alias("reducer"))
            .select("reducer", "block", "pos", (F.col("reducer") == F.col("owner")).alias("own"), *carry))


def place_by_reducer(routed: DataFrame, reducers: int) -> DataFrame:
    """Put every row on the partition numbered by its reducer (one partition per reducer)."""
    return routed.repartitionById(reducers, F.col("reducer"))
