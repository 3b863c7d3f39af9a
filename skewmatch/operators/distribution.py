"""Block statistics as tables (the block distribution matrix and what follows).

The matrix is kept long, one row per (block, part) with a count, and every
derived number is an aggregate of it: nothing is collected to the driver.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType

from skewmatch.functions.keys import resolve_key, source_partition
from skewmatch.operators.ordinal import ordinal, positions


PAIRS = "decimal(38,0)"  # pair counts, which outgrow a LONG from 4.3e9 entities in a block


def entity_part(kind: DataType, id_col: str, parts: int) -> Column:
    """The source partition of an entity with an id of this type: ``pmod(id, parts)``, of a composite id that of the sum of its fields."""
    number = F.col(id_col)
    if isinstance(kind, StructType):
        number = functools.reduce(lambda a, b: a + b, [F.col(id_col)[f].cast("long") for f in kind.names])
    return source_partition(number, parts)


def keyed_entities(entities: DataFrame, key="prefix", parts: int = 4, id_col: str = "id",
                   text_col: str = "text", part_col: Column | None = None) -> DataFrame:
    """``(id, text, block, part)``: the blocking key and the source partition.

    ``part`` is ``pmod(id, parts)`` unless a column is given; of a composite id
    (a struct of integers) the fields are added up first.
    """
    key_fn = resolve_key(key)
    part = part_col if part_col is not None else entity_part(entities.schema[id_col].dataType, id_col, parts)
    return entities.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"),
                           key_fn(F.col(text_col)).alias("block"), part.cast("int").alias("part"))


def comparisons(n: Column) -> Column:
    """``n(n-1)/2``, exact for every LONG ``n``."""
    # one of n and n - 1 is even: halve that one first
    n = n.cast("long")
    even = n % 2 == 0
    return (F.when(even, F.shiftright(n, 1)).otherwise(F.shiftright(n - 1, 1)).cast(PAIRS)
            * F.when(even, n - 1).otherwise(n).cast(PAIRS)).cast(PAIRS)


def block_partition_counts(keyed: DataFrame) -> DataFrame:
    """Entities per (block, part): ``(block, part, size)``.

    A partial count runs before the shuffle, so a hot block costs one row per
    map task, not one per entity.
    """
    return keyed.groupBy("block", "part").agg(F.count(F.lit(1)).alias("size"))


def block_distribution_matrix(counts: DataFrame) -> DataFrame:
    """One row per block: ``(block, sizes MAP<part, size>, n, comps)``.

    The map has at most one entry per part, so each group is bounded by the
    number of parts, not by the block size.
    """
    return (counts.groupBy("block")
                  .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("part", "size"))))
                        .alias("sizes"),
                       F.sum("size").alias("n"))
                  .withColumn("comps", comparisons(F.col("n"))))


def sizes_text(sizes: Column) -> Column:
    """Render a sizes map as ``part:size,...`` in part order (for inspection/compare)."""
    return F.array_join(F.transform(F.map_entries(sizes),
                                    lambda e: F.concat(e["key"].cast("string"), F.lit(":"),
                                                       e["value"].cast("string"))), ",")


def block_partition_size(bdm: DataFrame, parts: int) -> DataFrame:
    """Dense ``(block, part, size)`` for every part 0..parts-1, 0 where absent."""
    return (bdm.select("block", "sizes", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
               .select("block", "part",
                       F.coalesce(F.element_at("sizes", F.col("part")), F.lit(0)).cast("long").alias("size")))


def block_sizes(counts: DataFrame) -> DataFrame:
    """Entities and comparisons per block: ``(block, n, comps)``."""
    return (counts.groupBy("block").agg(F.sum("size").alias("n"))
                  .withColumn("comps", comparisons(F.col("n"))))


def block_totals(sizes: DataFrame, reducers: int) -> DataFrame:
    """One row: ``(n_blocks, n_entities, total_comps, reducers, target)``.

    ``target = ceil(total_comps / reducers)``, the comparisons each reducer
    should get.
    """
    total = F.coalesce(F.sum("comps"), F.lit(0)).cast(PAIRS)
    above = F.col("total_comps") + F.col("reducers") - 1
    return (sizes.agg(F.count(F.lit(1)).alias("n_blocks"),
                      F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n_entities"),
                      total.alias("total_comps"))
                 .withColumn("reducers", F.lit(reducers).cast("long"))
                 .withColumn("target", ((above - above % F.col("reducers")) / F.col("reducers")).cast(PAIRS)))


def with_totals(df: DataFrame, totals: DataFrame) -> DataFrame:
    """Attach the columns of a one-row table to every row.

    The row is a scalar subquery: computed once, shipped as a value, no join.
    """
    packed = totals.select(F.struct(*totals.columns).alias("_t")).scalar()
    return (df.withColumn("_t", packed)
              .select("*", *[F.col("_t")[c].alias(c) for c in totals.columns])
              .drop("_t"))


def block_stats(keyed: DataFrame, reducers: int) -> DataFrame:
    """Everything the planners need, one row per block:
    ``(block, sizes, n, comps, total_comps, target, reducers, oversized)``.

    ``oversized`` is ``comps > target`` (strict).
    """
    bdm = block_distribution_matrix(block_partition_counts(keyed))
    totals = block_totals(bdm.select("n", "comps"), reducers)
    return (with_totals(bdm, totals.select("total_comps", "target", "reducers"))
            .withColumn("oversized", F.col("comps") > F.col("target")))


def oversized_blocks(stats: DataFrame) -> DataFrame:
    """Blocks whose comparisons exceed the per-reducer target."""
    return stats.filter(F.col("oversized"))


def block_index(blocks: DataFrame, name: str = "block_index") -> DataFrame:
    """Number the blocks 0..B-1 in key order (distributed ordinal, no single-task window)."""
    return ordinal(blocks, [F.col("block")], name)


def block_members(keyed: DataFrame, chunk: int = 1024) -> DataFrame:
    """Gather the ids of each block, in id order, in lists of at most ``chunk``.

    ``(block, chunk, ids, n)``. A block never becomes one unbounded list: its
    members are numbered (without a per-block task) and cut into chunks.
    """
    pos = positions(keyed.select("block", "id"), ["block"], "id", "pos")
    return (pos.withColumn("chunk", F.floor(F.col("pos") / chunk).cast("long"))
               .groupBy("block", "chunk")
               .agg(F.array_sort(F.collect_list("id")).alias("ids"))
               .withColumn("n", F.size("ids")))


def block_cogroup(left: DataFrame, right: DataFrame, member: str = "word", chunk: int = 1024,
                  block: str = "block") -> DataFrame:
    """The members of both sources side by side, also of blocks in one source only:
    ``(block, chunk, left, right, n_left, n_right)``.

    Chunk ``c`` holds the members ``c * chunk`` and up of either source, in
    sorted order and with their repeats, so no list is longer than ``chunk``.
    One numbering of the union of both; a row id splits the ties of a
    frequent member.
    """
    both = (left.select(F.col(block).alias("block"), F.col(member).alias("_m"), F.lit(0).alias("_side"))
                .unionByName(right.select(F.col(block).alias("block"), F.col(member).alias("_m"),
                                          F.lit(1).alias("_side")))
                .withColumn("_tie", F.monotonically_increasing_id()))
    placed = positions(both, ["block", "_side"], ["_m", "_tie"], "_pos").withColumn(
        "chunk", F.floor(F.col("_pos") / chunk).cast("long"))

    def members(side: int, name: str) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("_side") == side, F.col("_m")))).alias(name)

    return (placed.groupBy("block", "chunk").agg(members(0, "left"), members(1, "right"))
                  .withColumn("n_left", F.size("left").cast("long"))
                  .withColumn("n_right", F.size("right").cast("long")))
