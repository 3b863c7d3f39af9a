"""Ranks and positions without a single-task window.

Two tools:

* :func:`ordinal` gives a rank in a total order, for tables of aggregated size (one row per block or per
  task). The rows are range-partitioned and sorted and get a row id that
  holds the partition number; each partition counts its rows; a table with
  one row per partition gives the offsets. Range bounds come from sampling,
  so the tagged table is written once to the shared checkpoint folder and
  read back: both uses see the same ids, also after a lost executor, and the
  input is computed only once.

* :func:`positions` numbers the rows of each group of a large table, by the
  same written, range-partitioned sort: a group that spans partitions gets an
  offset per partition, so no task holds more than one range of it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewmatch.session import run_dir
from skewmatch.sources.paths import new_output_path

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def _partitions(df: DataFrame, partitions: int | None) -> int:
    if partitions:
        return partitions
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to a fresh folder of the run and read it back; see :func:`skewmatch.session.run_dir`."""
    path = new_output_path(run_dir(df.sparkSession), name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def _sorted_tagged(df: DataFrame, order: list, partitions: int | None) -> DataFrame:
    n = _partitions(df, partitions)
    tagged = (df.repartitionByRange(n, *order)
                .sortWithinPartitions(*order)
                .withColumn("_rid", F.monotonically_increasing_id()))
    tagged = materialize(tagged, "ordinal")
    return (tagged.withColumn("_pid", F.shiftright(F.col("_rid"), _ROW_BITS))
                  .withColumn("_local", F.col("_rid") - F.shiftleft(F.col("_pid"), _ROW_BITS)))


def _offsets(tagged: DataFrame, value) -> DataFrame:
    per_part = tagged.groupBy("_pid").agg(F.sum(value).alias("_part_total"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition: this single-task window is bounded by the partition count.
    return per_part.select(
        "_pid", F.coalesce(F.sum("_part_total").over(before), F.lit(0)).cast("long").alias("_offset"))


def ordinal(df: DataFrame, order: list, name: str = "ordinal",
            partitions: int | None = None) -> DataFrame:
    """Add the 0-based position of each row in the order of ``order`` (a total order)."""
    tagged = _sorted_tagged(df, order, partitions)
    offsets = _offsets(tagged, F.lit(1))
    return (tagged.join(F.broadcast(offsets), "_pid")
                  .withColumn(name, F.col("_offset") + F.col("_local"))
                  .drop("_rid", "_pid", "_local", "_offset"))


def positions(df: DataFrame, group: list[str], order: str | list[str], name: str = "pos",
              partitions: int | None = None) -> DataFrame:
    """0-based position of each row in its group, by ``order`` (one column or several).

    The rows are range-partitioned and sorted by ``(group, order)``, so a large
    group spans several partitions and no task holds it whole. The position is
    the row's place in its partition's run of the group plus the rows of the
    group in earlier partitions. It does not depend on the partition count.
    Rows that tie in ``order`` are numbered in any order; give a further
    column where many rows tie, so that they can be split.
    """
    order = [order] if isinstance(order, str) else list(order)
    tagged = _sorted_tagged(df, [F.col(c) for c in [*group, *order]], partitions)
    runs = tagged.groupBy("_pid", *group).agg(F.min("_local").alias("_first"),
                                              F.count(F.lit(1)).alias("_c"))
    # at most one row per partition and group
    before = Window.partitionBy(*group).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    shifts = runs.select("_pid", *group, (F.coalesce(F.sum("_c").over(before), F.lit(0))
                                          - F.col("_first")).alias("_shift"))
    return (tagged.join(shifts, ["_pid", *group])
                  .withColumn(name, (F.col("_local") + F.col("_shift")).cast("long"))
                  .drop("_rid", "_pid", "_local", "_shift"))
