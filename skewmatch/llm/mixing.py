"""Mixing sources to target weights by blocks.

Each source is one stream of words (documents in a fixed pseudorandom order), cut in blocks of ``block`` words.
A source's target words become a quota of slots. The slots of the output are split over shards by binomial draws
down a binary tree of shards, and within each of its nodes down a binary tree of sources to groups of ``GROUP`` of them
(every draw is seeded by its node, so each task computes the paths of its group and shards alone, reruns agree, and the
counts of all shards add up to the quotas): a multinomial draw of source counts per shard, conditioned on the quotas.
Slot k of a source is block ``perm(k mod blocks)`` of a pseudorandom permutation (Feistel rounds with cycle walking) of
pass ``k div blocks``; blocks are joined by index. Sources are a table throughout: none of it reaches the driver but sums.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewmatch.llm.common import hot_join, mix64, numbered, partitions, scans, word_spans, written
from skewmatch.operators.ordinal import ordinal

WEIGHTS = (5.0, 2.0, 1.0)
GROUP = 1024  # sources whose counts are drawn together, as one vector


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sources`` (``source_no`` from 0, ``size``) with ``target`` words: ``share`` times all words by the repeating weights; a source
    over ``most`` times its size stops there, and the excess goes to the others by weight.

    The words per unit of weight rise until no further source stops. Each turn is one aggregate; two rows per weight reach the
    driver, sums of whole numbers, so reruns agree. An empty table stays empty; a source of size 0 has target 0."""
    kind = F.pmod("source_no", F.lit(len(weights))).cast("int")
    weight = F.element_at(F.array(*map(F.lit, weights)), kind + 1)
    unit, stopped = 0.0, -1
    while True:
        full = weight * unit > most * F.col("size")
        sums = sorted(sources.groupBy(kind.alias("kind"), full.alias("full")).agg(
            F.count(F.lit(1)).alias("n"), F.sum("size").alias("size")).collect())
        free = sum(weights[r["kind"]] * r["n"] for r in sums if not r["full"])
        now = sum(r["n"] for r in sums if r["full"])
        if not free or now <= stopped:
            return sources.withColumn("target", F.least(weight * unit, most * F.col("size")))
        unit = (share * sum(r["size"] for r in sums) - most * sum(r["size"] for r in sums if r["full"])) / free
        stopped = now


def permuted(index: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of ``range(n)`` chosen by ``key``, at the given indexes."""
    half = max(1, -(-max(1, (n - 1).bit_length()) // 2))
    mask = np.uint64((1 << half) - 1)
    x = index.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            salt = np.uint64((key * 4 + r + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
            left, right = right, left ^ (mix64(right + salt) & mask)
        x[todo] = (left << np.uint64(half)) | right
        todo &= x >= np.uint64(n)
    return x.astype(np.int64)


def split_draw(quota: np.ndarray, left: int, rng: np.random.Generator) -> np.ndarray:
    """How many of each source's slots fall in the first ``left`` of all slots."""
    total = int(quota.sum())
    drawn = rng.binomial(quota, left / total if total else 0.0)
    off = left - int(drawn.sum())
    order = rng.permutation(len(quota))
    room = (quota - drawn if off > 0 else drawn)[order]
    step = np.clip(abs(off) - (np.cumsum(room) - room), 0, room)
    drawn[order] += step if off > 0 else -step
    return drawn


def group_share(node: tuple[int, int], group: int, own: int, others: list[int], left: int, seed: int) -> list[int]:
    """Of the first ``left`` slots of a node of shards, those of the ``others`` (the sibling of each node on the group's path down
    the tree of sources) and, last, of the group itself, which has ``own`` slots in the node. Each draw is seeded by the parent and made
    for its even child, so that all groups below agree."""
    rest, out = own + sum(others), []
    for depth, other in enumerate(others):
        level = len(others) - 1 - depth
        mine = rest - other
        even = (group >> level) % 2 == 0
        a, b = (mine, other) if even else (other, mine)
        rng = np.random.default_rng((seed, *node, level, group >> (level + 1)))
        drawn = int(rng.binomial(a, left / rest)) if rest else 0
        drawn = min(max(drawn, left - b, 0), a, left)
        here = drawn if even else left - drawn
        out.append(left - here)
        rest, left = mine, here
    return [*out, left]


def shard_counts(group: int, quota: np.ndarray, others: list[int], first: int, last: int, shards: int, per: int, seed: int):
    """``(shard, counts, counts before)`` of a group's sources in each of the shards from ``first`` up to ``last`` with any."""
    todo = [(0, shards, quota, np.zeros_like(quota), list(others))]
    while todo:
        low, high, quota, before, others = todo.pop()
        own = int(quota.sum())
        if high <= first or low >= last or not own:
            continue
        if high - low == 1:
            yield low, quota, before
            continue
        mid = (low + high) // 2
        left = group_share((low, high), group, own, others, min((mid - low) * per, own + sum(others)), seed)
        drawn = split_draw(quota, left[-1], np.random.default_rng((seed, low, high, len(others), group)))
        todo.append((mid, high, quota - drawn, before + drawn, [n - x for n, x in zip(others, left)]))
        todo.append((low, mid, drawn, before, left[:-1]))


def draw_blocks(shards: int, per: int, seed: int):
    """For each group of sources and range of shards ``(source_no, block)`` of every slot there."""
    def run(frames):
        for frame in frames:
            for r in frame.itertuples(index=False):
                walk = shard_counts(r.grp, np.array(r.quotas, np.int64), [int(x) for x in r.others], r.first, r.last, shards, per, seed)
                for _, count, before in walk:
                    source, index = [], []
                    for s in np.flatnonzero(count).tolist():
                        n, number = int(r.blocks[s]), int(r.numbers[s])
                        slot = np.arange(before[s], before[s] + count[s])
                        turn = slot // n
                        got = np.empty(len(slot), np.int64)
                        for t in np.unique(turn).tolist():
                            got[turn == t] = permuted(slot[turn == t] % n, n, seed * 1_000_003 + number * 64 + t)
                        source.append(np.full(len(slot), number, np.int64))
                        index.append(got)
                    yield pd.DataFrame({"source_no": np.concatenate(source), "block": np.concatenate(index)})
    return run


def drawn_blocks(sources: DataFrame, per_shard: int, seed: int) -> DataFrame:
    """``(source_no, block, copies)`` of the blocks that the mix holds, from ``source_no, blocks, quota`` per source."""
    spark = sources.sparkSession
    last, slots = sources.agg(F.max("source_no"), F.sum("quota")).first()
    levels = max(1, ((last or 0) // GROUP).bit_length())
    shards = max(1, -(-(slots or 0) // per_shard))
    tasks = min(shards, 4 * partitions(spark))
    groups = (sources.filter("quota > 0").withColumn("grp", F.floor(F.col("source_no") / GROUP))
              .groupBy("grp").agg(F.sum("quota").alias("slots"), F.sort_array(F.collect_list(F.struct("source_no", "blocks", "quota"))).alias("of")))
    ways = groups.select("grp", "slots", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    nodes = ways.groupBy("level", F.expr("shiftright(grp, level)").alias("node")).agg(F.sum("slots").alias("slots"))
    others = (ways.select("grp", "level", F.expr("shiftright(grp, level) ^ 1").alias("node")).join(nodes, ["level", "node"], "left")
              .groupBy("grp").agg(F.sort_array(F.collect_list(F.struct((-F.col("level")).alias("down"), F.coalesce("slots", F.lit(0)).alias("slots"))))
                                  .alias("others")))
    cuts = F.least(F.lit(tasks), F.ceil(F.col("slots") / per_shard))
    work = (groups.join(others, "grp").withColumn("cuts", cuts).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
            .select("grp", F.col("of.source_no").alias("numbers"), F.col("of.blocks").alias("blocks"), F.col("of.quota").alias("quotas"),
                    F.col("others.slots").alias("others"), F.expr(f"k * {shards}L div cuts").alias("first"),
                    F.expr(f"(k + 1) * {shards}L div cuts").alias("last")))
    return (work.repartition(max(1, min(shards, partitions(spark)))).mapInPandas(draw_blocks(shards, per_shard, seed), "source_no long, block long")
            .groupBy("source_no", "block").agg(F.count(F.lit(1)).alias("copies")))


def count_words(batches):
    for batch in batches:
        size = np.zeros(batch.num_rows, np.int64)
        for first, data, off in scans(batch["text"]):
            size[first:first + len(off) - 1] = np.diff(word_spans(data, off)[2])
        names = [c for c in batch.schema.names if c != "text"]
        yield pa.record_batch([*[batch[c] for c in names], pa.array(size)], names=[*names, "size"])


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", row_col: str | None = None,
             block: int = 128, per_shard: int = 8192, bucket_rows: int = 1 << 16, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """``(rows, takes)``. rows: ``row, doc_id, content, size, source_size, target`` per input row; takes:
    ``row, low, high, copies``, the word ranges of a row that the mix takes and how often. ``row`` is ``row_col``, which
    must tell rows apart, or a number given here.

    A null text has no words, a null source is a source of its own (the last); rows that repeat are rows of
    their own; an empty table gives no rows; other columns are ignored. There may be any number of sources, and one may hold
    most rows: its rows are dealt over as many buckets as the table has ``bucket_rows`` rows (1,024 at least).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.col(source_col).cast("string")
    counted = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.concat(F.lit("="), name), F.lit("")).alias("name"),
                          F.xxhash64(text).alias("content"), text.alias("text"),
                          (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row"))
    rows = written(counted.mapInArrow(count_words, "doc_id long, name string, content long, row long, size long"))
    sums = rows.groupBy("name").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n_rows"))
    order = [F.col("name") == "", F.col("name")]  # the null source, which has no name, is the last
    blocks = F.ceil(F.col("size") / block)
    quota = F.when(F.col("size") > 0, F.least(2 * blocks, F.round(F.col("target") * blocks / F.col("size")).cast("long"))).otherwise(F.lit(0))
    sources = written(with_targets(written(ordinal(sums, order, "source_no")))
                      .withColumn("blocks", blocks).withColumn("quota", quota))
    total = sources.agg(F.sum("n_rows")).first()[0] or 0
    buckets = max(1024, -(-total // bucket_rows))
    found = sources.select("name", "n_rows", "source_no", F.col("size").alias("source_size"), "target")
    rows = written(hot_join(rows, found, ["name"], "inner", total=total, rows_col="n_rows").drop("name", "n_rows")
                   .withColumn("bucket", F.pmod(F.xxhash64("doc_id", "content"), F.lit(buckets)).cast("int")))

    spot = ["source_no", "bucket"]
    part = rows.groupBy(*spot).agg(F.sum("size").alias("words"))
    over = "sum(words) over (partition by source_no order by bucket) - words"
    starts = part.select(*spot, F.expr(over).alias("start"))
    place = "sum(size) over (partition by source_no, bucket order by doc_id, content, row rows unbounded preceding) - size"
    placed = rows.filter("size > 0").withColumn("at", F.expr(place)).join(starts.hint("merge"), spot).withColumn(
        "at", F.col("at") + F.col("start"))
    spans = placed.select("row", "source_no", "size", "at", F.explode(F.expr(
        f"sequence(at div {block}, (at + size - 1) div {block})")).alias("block"))

    # merge hints: the sizes of drawn rows can't be told from the plan, and they grow with the input
    taken = drawn_blocks(sources.select("source_no", "blocks", "quota"), per_shard, seed)
    takes = spans.join(taken.hint("merge"), ["source_no", "block"]).select(
        "row", F.greatest(F.lit(0), F.col("block") * block - F.col("at")).alias("low"),
        F.least("size", (F.col("block") + 1) * block - F.col("at")).alias("high"), "copies")
    return rows.select("row", "doc_id", "content", "size", "source_size", "target"), takes


def mix(docs: DataFrame, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` per input row; see :func:`mix_plan`."""
    rows, takes = mix_plan(docs, **options)
    words = takes.groupBy("row").agg(F.sum((F.col("high") - F.col("low")) * F.col("copies")).alias("taken"))
    return rows.join(words.hint("merge"), "row", "left").select("doc_id", "size", "source_size", "target",
                                                  F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def cut_texts(names: list[str], text_col: str, chars_col: str):
    """Rows ``doc, takes`` (sorted word ranges and copies): one row per copy, its text the ranges taken. Holds a scan's texts."""
    def run(batches):
        for batch in batches:
            docs, takes = batch["doc"], batch["takes"]
            text = docs.field(names.index(text_col))
            for first, data, off in scans(text.fill_null("")):
                start, end, before = word_spans(data, off)
                pick, texts = [], []
                for k, ranges in enumerate(takes.slice(first, len(off) - 1).to_pylist()):
                    for copy in range(max(t["copies"] for t in ranges)):
                        runs: list[list[int]] = []
                        for t in ranges:
                            if t["copies"] > copy:
                                if runs and runs[-1][1] == t["low"]:
                                    runs[-1][1] = t["high"]
                                else:
                                    runs.append([t["low"], t["high"]])
                        word = before[k]
                        pick.append(k)
                        texts.append("\n".join(data[start[word + a]:end[word + b - 1]].tobytes().decode() for a, b in runs))
                some = docs.slice(first, len(off) - 1)
                out = {c: some.field(j).take(pa.array(pick, pa.int64())) for j, c in enumerate(names) if c != text_col}
                out[text_col] = pa.array(texts, pa.string())
                if chars_col in names:
                    out[chars_col] = pa.array([len(t) for t in texts], pa.int64()).cast(docs.field(names.index(chars_col)).type)
                yield pa.record_batch([out[c] for c in names], names=names)
    return run


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str = "n_chars",
                    **options) -> DataFrame:
    """The mix itself: every row once per copy, with the columns of ``docs`` and the words that the copy takes
    (``chars_col``, if there, is counted anew). Every row has its own ranges, also one that repeats another."""
    rows = numbered(docs)
    _, takes = mix_plan(rows.select("row", *[F.col(f"doc.`{c}`").alias(c) for c in dict.fromkeys((id_col, text_col, source_col))]),
                        id_col=id_col, text_col=text_col, source_col=source_col, row_col="row", **options)
    lists = takes.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("low", "high", "copies"))).alias("takes"))
    return (rows.join(lists.hint("merge"), "row").select("doc", "takes")
                .mapInArrow(cut_texts(docs.columns, text_col, chars_col), docs.schema))
