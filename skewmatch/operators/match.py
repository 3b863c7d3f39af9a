"""The matchers: pairs inside a block with similarity >= threshold.

All return ``(id_a, id_b, text_a, text_b, similarity)`` with ``id_a < id_b``
(the two-source matcher returns words instead of ids). Every pair of a block
is a candidate. The one-source matchers score each distinct text once
(:mod:`skewmatch.operators.distinct`), compare the groups of their plan inside tasks
(:mod:`skewmatch.operators.pairs`), and expand the matches to the entities:

* :func:`basic_match` deals a hot block over salts and compares it per pair of
  salts, so no task holds it whole.
* :func:`split_match` and :func:`slice_match` plan the work: blocks above the
  per-reducer target are cut into tasks, the tasks are assigned to reducers
  by load, and each reducer's tasks are placed on one partition. ``split_match``
  weighs tasks by edit-distance cells, or by pairs as the block statistics do.
  The three take ``bring``, for short texts with many matches each: texts then take their ids and texts to the tasks that
  compare them, which costs each copy of a text a few more bytes, and their pairs are not shuffled.
* the tagged ``split_match`` keeps the task of each entity pair, taken from the plan by pairs;
  :func:`two_source_match` joins distinct words on a salted grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.functions.keys import key_first_char, mark_empty, resolve_key
from skewmatch.functions.similarity import (DEFAULT_THRESHOLD, is_match, match_similarity,
                                            with_match_features)
from skewmatch.operators.distinct import length_band, member_pairs, representatives, with_members
from skewmatch.operators.distribution import block_stats, entity_part, keyed_entities, with_totals
from skewmatch.operators.ordinal import materialize
from skewmatch.operators.pairs import FEW, FOUND, LEFT, OWN, RIGHT, WITHOUT_MEMBERS, matching_members, matching_pairs
from skewmatch.operators.route import (entity_positions, place_by_reducer, plan_lookup, slice_copies, split_route,
                                       split_tasks_by_block)
from skewmatch.plans.assign import assign_reducers
from skewmatch.plans.slicer import TASK_KEY as SLICE_KEY
from skewmatch.plans.slicer import slice_plan
from skewmatch.plans.split import TASK_KEY as SPLIT_KEY
from skewmatch.plans.split import split_plan
from skewmatch.plans.work import TASK_KEY as WORK_KEY
from skewmatch.plans.work import work_plan, work_route, work_units

MATCH_COLUMNS = ["id_a", "id_b", "text_a", "text_b", "similarity"]


def _scored(joined: DataFrame, threshold: float) -> DataFrame:
    sim = match_similarity("_a", "_b", threshold)
    return joined.withColumn("similarity", sim).filter(is_match(F.col("similarity"), threshold))


def _oriented(df: DataFrame, extra: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Order each pair so that ``id_a < id_b``; swap the paired columns with it."""
    swap = F.col("id_a") > F.col("id_b")
    cols = [F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"),
            F.when(swap, F.col("text_b")).otherwise(F.col("text_a")).alias("text_a"),
            F.when(swap, F.col("text_a")).otherwise(F.col("text_b")).alias("text_b"),
            F.col("similarity")]
    for name, (a, b) in (extra or {}).items():
        cols.append(F.col(name))
        cols.append(F.when(swap, F.col(b)).otherwise(F.col(a)).alias(a))
        cols.append(F.when(swap, F.col(a)).otherwise(F.col(b)).alias(b))
    return df.select(*cols)


def _placed(df: DataFrame, keys: list[str], partitions: int | None) -> DataFrame:
    """Hash-place rows on their task key with a fixed partition count.

    The pair work is quadratic while the bytes are small, so adaptive
    coalescing (by bytes) would squeeze the join into a few tasks; a fixed
    count keeps it spread, and the join on the same keys reuses the placement.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, *keys)


def _keyed(entities: DataFrame, key) -> DataFrame:
    return entities.select("id", "text", resolve_key(key)(F.col("text")).alias("block")).filter("block is not null")


def _as_entities(reps: DataFrame, parts: int) -> DataFrame:
    """Representatives in the columns of :func:`keyed_entities`, with what the comparison needs."""
    return reps.select(F.col("rep").alias("id"), "block", F.pmod(F.xxhash64("rep"), F.lit(parts)).cast("int").alias("part"), *_payload(reps))


PAYLOAD = ("rep", "n", "low", "len")


def _payload(reps: DataFrame) -> tuple:
    return (*PAYLOAD, "members") if "members" in reps.columns else PAYLOAD


def _texts(keyed: DataFrame, bring: bool) -> tuple[DataFrame, DataFrame]:
    """The distinct texts and their members; with ``bring`` each text of at most ``FEW`` has its members with it, too."""
    reps, members = representatives(keyed)
    return (with_members(reps, members) if bring else reps), members


def _entity_pairs(placed: DataFrame, keys: list[str], reps: DataFrame, members: DataFrame, threshold: float) -> DataFrame:
    """The matches of the groups of ``placed`` as entity pairs.

    Texts that bring their members leave the task that compares them as complete pairs: the shuffles before grow with the entities, and
    the pairs, which grow with their square, are in none. Pairs with a text of more than ``FEW`` members, and the members of one text,
    go through :func:`member_pairs`, which spreads them over many tasks; so do all if no members are brought.
    """
    if "members" not in reps.columns:
        return _oriented(member_pairs(matching_pairs(placed, keys, threshold), reps, members, threshold))
    found = matching_members(placed, keys, threshold)
    most = reps.agg(F.max("n")).first()[0] or 0
    if most > 1:
        rest = (matching_pairs(placed, keys, threshold, WITHOUT_MEMBERS) if most > FEW
                else reps.sparkSession.createDataFrame([], FOUND))
        found = found.unionByName(member_pairs(rest, reps, members, threshold))
    return _oriented(found)


def basic_match(entities: DataFrame, key="prefix_lower", threshold: float = DEFAULT_THRESHOLD,
                partitions: int | None = None, bring: bool = False) -> DataFrame:
    """All pairs inside a block, scored and filtered.

    A hot block is salted into ``S`` groups by a hash of the text and the pairs
    are computed per pair of salts ``x <= y``. ``S`` follows from the block's
    share of all work, of the pairs or of the edit-distance cells (a pair costs
    about the product of its lengths), whichever is larger: ``S = ceil(sqrt(2 *
    partitions * share))``, so that its ``S(S+1)/2`` tasks hold about one
    partition's work each. A text has at most ``sqrt(2 * partitions) + 2``
    copies. Fewer than ``4 * partitions`` blocks have ``S > 1``: their table is
    broadcast, and all others stay one task each.
    """
    reps, members = _texts(_keyed(entities, key), bring)
    width = partitions or int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    work = (reps.groupBy("block").agg(F.count(F.lit(1)).cast("double").alias("texts"),
                                      F.sum("llen").cast("double").alias("chars"))
                .filter(F.col("texts") > 1)
                .select("block", (F.col("texts") * (F.col("texts") - 1)).alias("pairs"),
                        (F.col("chars") * F.col("chars")).alias("cells")))
    total = work.agg(F.sum("pairs").alias("_pairs"), F.sum("cells").alias("_cells"))
    share = F.greatest(F.try_divide("pairs", "_pairs"), F.try_divide("cells", "_cells"))
    hot = (with_totals(work, total)
           .select("block", F.ceil(F.sqrt(F.lit(2.0 * width) * share)).cast("int").alias("salts"))
           .filter(F.col("salts") > 1))
    salted = (reps.join(F.broadcast(hot), "block", "left")
                  .withColumn("salts", F.coalesce("salts", F.lit(1)))
                  .withColumn("salt", F.pmod(F.xxhash64("rep"), F.col("salts")).cast("int")))

    def task(other):
        """A text with salt s is on the left of (s, y > s), on the right of (x < s, s), and on both sides of (s, s)."""
        salt = F.col("salt")
        return F.struct(F.least(salt, other).alias("x"), F.greatest(salt, other).alias("y"),
                        F.when(salt == other, OWN).when(salt < other, LEFT).otherwise(RIGHT).alias("side"),
                        (salt > other).cast("int").alias("place"))

    tasks = F.explode(F.transform(F.sequence(F.lit(0), F.col("salts") - 1), task)).alias("t")
    keys = ["block", "x", "y"]
    placed = _placed(salted.select("block", *_payload(reps), tasks).select("block", "t.*", *_payload(reps)), keys, partitions)
    return _entity_pairs(placed, keys, reps, members, threshold)


def planned_stats(keyed: DataFrame, reducers: int) -> DataFrame:
    """Block statistics, written once to the shared checkpoint folder.

    One row per block: small next to the entities. Every planning step and
    the routing join read this table instead of scanning the entities again,
    and its lineage is cut before the (sequential) planning starts.
    """
    return materialize(block_stats(keyed, reducers), "block-stats")


def split_plan_assigned(keyed: DataFrame, reducers: int):
    """Block statistics and the split tasks with their reducers."""
    stats = planned_stats(keyed, reducers)
    return stats, assign_reducers(split_plan(stats), reducers, SPLIT_KEY)


def work_plan_assigned(reps: DataFrame, reducers: int, threshold: float = DEFAULT_THRESHOLD, grain: int = 8):
    """``(banded, units, tasks)``: the representatives with their length band, the units, and the tasks by cells with their reducers."""
    banded = reps.withColumn("band", length_band(F.col("llen"), threshold))
    units = work_units(banded, reducers, grain)
    tasks = materialize(assign_reducers(work_plan(banded, units), reducers, WORK_KEY, cost="cells"), "tasks")
    return banded, units, tasks


def split_match(entities: DataFrame, key="prefix", parts: int = 4, reducers: int = 4,
                threshold: float = DEFAULT_THRESHOLD, tagged: bool = False, work: str = "cells",
                bring: bool = False) -> DataFrame:
    """BlockSplit matching. ``work`` says how tasks are cut and weighed: by ``"cells"`` (length bands, as many parts as a band of a block needs) or
    by ``"pairs"`` (``parts`` parts of every block above the target). With ``tagged`` the plan is by pairs of
    entities and the task of each match is kept: ``reducer, block, i, j, part_a, part_b``."""
    if tagged:
        return _tagged_match(entities, key, parts, reducers, threshold)
    reps, members = _texts(_keyed(entities, key), bring)
    if work == "cells":
        keys = ["reducer", "rank"]
        placed = place_by_reducer(work_route(*work_plan_assigned(reps, reducers, threshold)), reducers)
    else:
        keys = ["reducer", "block", "i", "j"]
        keyed = _as_entities(reps, parts)
        stats, assigned = split_plan_assigned(keyed, reducers)
        routed = split_route(keyed, stats, assigned, _payload(reps))
        side = (F.when(~F.col("oversized") | (F.col("i") == F.col("j")), OWN)
                 .when(F.col("part") == F.col("i"), LEFT).otherwise(RIGHT))
        placed = place_by_reducer(routed.withColumn("side", side).withColumn("place", (side == RIGHT).cast("int")), reducers)
    return _entity_pairs(placed, keys, reps, members, threshold)


def distinct_match(reps: DataFrame, reducers: int = 4, threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """Matching pairs of distinct texts, ``block, low_a, low_b, similarity, n_a, n_b``, planned by cells; ``low_a`` is the smaller text (of
    equal ones with two lengths before lower-casing, the shorter one's). With the members of each text (:func:`representatives`) this says the same as
    the entity pairs, in a size that copies do not square."""
    placed = place_by_reducer(work_route(*work_plan_assigned(reps, reducers, threshold)), reducers)
    found = matching_pairs(placed, ["reducer", "rank"], threshold).select("rep_a", "rep_b", "similarity")
    for side in "ab":
        mine = reps.select(F.col("rep").alias(f"rep_{side}"), F.struct("low", "len", "n").alias(side), *(["block"] if side == "a" else []))
        found = found.join(mine.hint("merge"), f"rep_{side}")
    low, high = F.least("a", "b"), F.greatest("a", "b")
    return found.select("block", low["low"].alias("low_a"), high["low"].alias("low_b"), "similarity", low["n"].alias("n_a"), high["n"].alias("n_b"))


def _tagged_match(entities: DataFrame, key, parts: int, reducers: int, threshold: float) -> DataFrame:
    """The matches of distinct texts are found by the plan by cells, on as many partitions as the session has, and expanded with the tasks
    of their block; the source parts of both ids then say which of these (at most ``parts * (parts + 1) / 2``) the pair is in."""
    stats, assigned = split_plan_assigned(keyed_entities(entities, key, parts), reducers)
    reps, members = representatives(_keyed(entities, key))
    width = max(reducers, int(entities.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = place_by_reducer(work_route(*work_plan_assigned(reps, width, threshold)), width)
    tasks = ("block", "oversized", "tasks")
    known = plan_lookup(reps, split_tasks_by_block(stats, assigned), stats, salt_by="rep")
    pairs = member_pairs(matching_pairs(placed, ["reducer", "rank"], threshold), known, members, threshold, carry=tasks)
    kind = entities.schema["id"].dataType
    parted = pairs.withColumns({f"part_{x}": entity_part(kind, f"id_{x}", parts) for x in "ab"}).withColumn("_t", F.struct(*tasks))
    found = _oriented(parted, {"_t": ("part_a", "part_b")}).filter("id_a != id_b")
    cut = F.col("_t.oversized")
    i, j = (F.when(~cut, F.lit(0)).when(F.col("part_a").isNotNull() & F.col("part_b").isNotNull(), f("part_a", "part_b")) for f in (F.greatest, F.least))
    task = F.filter("_t.tasks", lambda t: (t["i"] == i) & (t["j"] == j))
    return (found.withColumn("_one", F.explode(task))
                 .select(*MATCH_COLUMNS, "_one.reducer", "_t.block", "_one.i", "_one.j", "part_a", "part_b"))


def slice_plan_assigned(keyed: DataFrame, reducers: int):
    """Block statistics and the slices with their reducers."""
    stats = planned_stats(keyed, reducers)
    return stats, assign_reducers(slice_plan(stats), reducers, SLICE_KEY)


def slice_match(entities: DataFrame, key="prefix", parts: int = 4, reducers: int = 4,
                threshold: float = DEFAULT_THRESHOLD, show_empty: bool = False, bring: bool = False) -> DataFrame:
    """BlockSlicer matching: own texts of a reducer's slices against every later
    text of them (own or copied), each text copied once per reducer. With ``show_empty`` an empty entity
    is compared and returned as ``<><><>``, in the block of its empty text."""
    keyed = _keyed(entities, key)
    if show_empty:
        keyed = keyed.withColumn("text", mark_empty("text"))
    reps, members = _texts(keyed, bring)
    keyed = _as_entities(reps, parts)
    stats, assigned = slice_plan_assigned(keyed, reducers)
    pos = entity_positions(keyed.select("id", "block"))
    placed = keyed.join(pos.select("id", "pos").hint("merge"), "id")
    copies = slice_copies(placed, stats, assigned, _payload(reps))
    rows = copies.withColumn("side", F.when(F.col("own"), OWN).otherwise(RIGHT)).withColumnRenamed("pos", "place")
    return _entity_pairs(place_by_reducer(rows, reducers), ["reducer", "block"], reps, members, threshold)


def source_words(words: DataFrame, name: str) -> DataFrame:
    """``word, n, block``: the distinct words of one source, written once; repeats are counted before the shuffle."""
    return materialize(words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).withColumn("block", key_first_char("word")), name)


def two_source_grid(left: DataFrame, right: DataFrame, reducers: int, grain: int = 8) -> DataFrame:
    """``block, rows, columns``: into how many parts the words of each source are cut in a block, so that its cells (part by part) have about
    ``1 / grain`` of a reducer's share of all pairs; written once, one row per block of both sources."""
    per_block = (left.groupBy("block").agg(F.count(F.lit(1)).alias("l")).join(
        right.groupBy("block").agg(F.count(F.lit(1)).alias("r")).hint("merge"), "block").withColumn("pairs", F.col("l") * F.col("r")))
    total = per_block.agg(F.sum("pairs").alias("_total"))
    cells = F.ceil(F.col("pairs") * F.lit(float(reducers * grain)) / F.col("_total"))
    # as square as the sides allow: parts of about equal size on both
    return materialize(with_totals(per_block, total)
                       .withColumn("rows", F.least(F.col("l"), F.greatest(F.lit(1), F.ceil(F.sqrt(cells * F.col("l") / F.col("r"))))))
                       .withColumn("columns", F.least(F.col("r"), F.greatest(F.lit(1), F.ceil(cells / F.col("rows")))))
                       .select("block", F.col("rows").cast("int").alias("rows"), F.col("columns").cast("int").alias("columns")), "grid")


def two_source_plan(left: DataFrame, right: DataFrame, grid: DataFrame, reducers: int) -> DataFrame:
    """``block, x, y, comps, cells, rank, reducer``: the cells of every block's grid, with exact pair counts and edit-distance cells, assigned by
    falling cells."""
    def parts(words: DataFrame, cut: str, part: str) -> DataFrame:
        dealt = _dealt(words.select("block", "word"), grid, cut, part)
        return dealt.groupBy("block", part).agg(F.count(F.lit(1)).alias(f"n_{part}"), F.sum(F.length("word") + 1).alias(f"c_{part}"))

    cells = parts(left, "rows", "x").join(parts(right, "columns", "y").hint("merge"), "block")
    product = lambda a, b: (F.col(a).cast("decimal(38,0)") * F.col(b).cast("decimal(38,0)")).cast("decimal(38,0)")
    plan = cells.select("block", "x", "y", product("n_x", "n_y").alias("comps"), product("c_x", "c_y").alias("cells"))
    return materialize(assign_reducers(plan, reducers, ["block", "x", "y"], cost="cells"), "tasks")


def _dealt(words: DataFrame, grid: DataFrame, cut: str, part: str) -> DataFrame:
    """``words`` of blocks that both sources have, with their part. A block is a character, so the broadcast grid has at most as many rows
    as there are characters (about 1.1 million, 30 bytes each), whatever the words."""
    looked = words.join(F.broadcast(grid.select("block", cut)), "block")
    return looked.withColumn(part, F.pmod(F.xxhash64("word"), F.col(cut)).cast("int")).drop(cut)


def two_source_match(left_words: DataFrame, right_words: DataFrame, reducers: int = 4,
                     threshold: float = DEFAULT_THRESHOLD, partitions: int | None = None) -> DataFrame:
    """Every word of one source against every word of the other with the same
    first character: ``(word_a, word_b, similarity, occurrences)``, one row per
    pair of distinct words; ``occurrences`` is the number of occurrence pairs.

    A block (one letter) is cut into a grid of cells on both sides, the cells are
    assigned to ``reducers`` by load and placed on their partitions (``partitions``
    is the older name of that number).
    """
    reducers = partitions or reducers
    left, right = source_words(left_words, "left"), source_words(right_words, "right")
    grid = two_source_grid(left, right, reducers)
    tasks = two_source_plan(left, right, grid, reducers).select("block", "x", "y", "reducer", "rank")
    # per part the cells it is in: at most as many as the other side has parts
    a = (_dealt(left, grid, "rows", "x").withColumnsRenamed({"word": "text_a", "n": "n_a"})
         .join(tasks.hint("merge"), ["block", "x"]).select("reducer", "rank", "text_a", "n_a"))
    b = (_dealt(right, grid, "columns", "y").withColumnsRenamed({"word": "text_b", "n": "n_b"})
         .join(tasks.hint("merge"), ["block", "y"]).select("reducer", "rank", "text_b", "n_b"))
    a = with_match_features(place_by_reducer(a, reducers), "text_a", "_a")
    b = with_match_features(place_by_reducer(b, reducers), "text_b", "_b")
    scored = _scored(a.hint("merge").join(b, ["reducer", "rank"]), threshold)
    return scored.select(F.col("text_a").alias("word_a"), F.col("text_b").alias("word_b"), "similarity",
                         (F.col("n_a") * F.col("n_b")).alias("occurrences"))
