"""Batch distances, representatives, length bands, the plan by cells, greedy progressions and slice copies."""

import heapq
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import entities
from skewmatch.functions import distance
from skewmatch.operators import match
from skewmatch.operators.distinct import length_band, member_pairs, representatives
from skewmatch.operators.distribution import keyed_entities
from skewmatch.operators.pairs import Texts, Work, compare, compared_pairs, limits_of
from skewmatch.operators.route import entity_positions, place_by_reducer, slice_copies
from skewmatch.plans.assign import deal_run, reducer_load
from skewmatch.plans.work import cut_units, work_route
from skewmatch.sources.tables import document_lines
from test_match import _brute, _lev, _py_sim, _set


def _texts(n=40, longest=70, letters="abcß "):
    rng = random.Random(n)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n)]
    return texts + ["", "", texts[0][:-1], "x" * 200]


@pytest.mark.parametrize("bits", [1, 64, 1 << 14])
def test_distances_equal_plain_dynamic_programming(bits):
    texts = _texts()
    points, starts = distance.code_points(texts)
    counts = distance.letter_counts(points, starts)
    for tile in distance.tiles(points, starts, np.arange(len(texts)), bits):
        for k, text in enumerate(texts):
            want = np.array([_lev(text, texts[j]) for j in tile.rows])
            mine = points[starts[k]:starts[k + 1]]
            assert tile.distances(mine, np.full(len(want), 1 << 20)).tolist() == want.tolist()
            assert (distance.count_bound(counts[k], counts[tile.rows]) <= want).all()
            limit = limits_of(np.maximum(tile.size, len(text)), 0.7)
            got = tile.distances(mine, limit)  # may stop early: right up to the limit, above it only larger than it
            assert ((got == want) | ((want > limit) & (got > limit))).all()


def test_bounds_remove_pairs_but_no_match():
    texts = sorted(set(_texts(120, 90, "abcdefghijklmnop ")), key=len)
    rows = {"side": [3] * len(texts), "place": [0] * len(texts), "rep": list(range(len(texts))), "n": [1] * len(texts), "low": texts,
            "len": [len(t) for t in texts]}
    group, work = Texts(rows), Work()
    packed = distance.tiles(group.points, group.starts, np.arange(len(texts)))
    got = {tuple(sorted((int(a), r))) for left, right, _ in compare(group, group, packed, 0.7, work) for a, r in zip(group.rep[left], group.rep[right].tolist())}
    want = {(a, b) for a in range(len(texts)) for b in range(a + 1, len(texts)) if _py_sim(texts[a], texts[b]) >= 0.7}
    assert got == want
    assert work.pairs == len(texts) * (len(texts) - 1) // 2
    assert work.after_letters < work.after_lengths < work.pairs


def test_bands_part_no_matching_lengths(spark):
    lengths = spark.range(0, 400).select(F.col("id").cast("int").alias("l"))
    for threshold in (0.3, 0.7, 0.95, 1.0):
        a = lengths.select(F.col("l").alias("x"), length_band(F.col("l"), threshold).alias("p"))
        b = lengths.select(F.col("l").alias("y"), length_band(F.col("l"), threshold).alias("q"))
        near = a.crossJoin(b).filter((F.col("x") <= F.col("y")) & (F.col("y") - F.col("x") <= F.floor((1 - threshold) * F.col("y") + 1e-9)))
        assert near.filter(~(F.col("q") - F.col("p")).isin(0, 1)).count() == 0
    assert lengths.select(length_band(F.col("l"), 0.0).alias("b")).distinct().count() == 1


def test_members_of_a_hot_text(spark):
    texts = ["the same text"] * 60 + ["The Same Text"] * 5 + ["the same tent", "another one"]
    ents = entities(spark, texts)
    reps, members = representatives(ents.withColumn("block", F.lit("k")))
    assert sorted(r.n for r in reps.collect()) == [1, 1, 65] and members.count() == len(texts)
    want = [(a, b, _py_sim(texts[a], texts[b])) for a in range(67) for b in range(a + 1, 67) if _py_sim(texts[a], texts[b]) >= 0.7]
    assert _set(match.split_match(ents)) == sorted(want)
    assert match.distinct_match(reps).select("low_a", "low_b", "n_a", "n_b").collect() == [("the same tent", "the same text", 1, 65)]


def test_member_groups_are_cut(spark, monkeypatch):
    from skewmatch.operators import distinct

    monkeypatch.setattr(distinct, "MEMBERS", 7)
    reps, members = representatives(entities(spark, ["abcdefgh"] * 40 + ["abcdefgx"] * 9).withColumn("block", F.lit("k")))
    n = {r.rep: r.n for r in reps.collect()}
    a, b = sorted(n)
    found = spark.createDataFrame([(a, b, n[a], n[b], 0.875)], "rep_a long, rep_b long, n_a long, n_b long, similarity double")
    pairs = member_pairs(found, reps, members).select("id_a", "id_b").collect()
    assert len(pairs) == len({frozenset(p) for p in pairs}) == 49 * 48 // 2



def test_pooled_pairs_find_what_tiles_find():
    from skewmatch.operators.pairs import Pool, collect

    rng = random.Random(11)
    texts = ["", "z"]
    for k in range(150):
        base = [rng.choice("abcé") for _ in range(rng.choice([1, 20, 63, 64, 65, 128, 190, 700, 5000 if k < 3 else 90]))]
        for _ in range(2):
            texts.append("".join(c for c in base if rng.random() > 0.1) + rng.choice(["", "a" * len(base), "\U0001f600"]))
    rows = {"rep": list(range(len(texts))), "n": [1] * len(texts), "place": [0] * len(texts), "len": [len(t) for t in texts], "side": [3] * len(texts), "low": texts}
    group, work, again = Texts(rows), Work(), Work()
    packed = distance.tiles(group.points, group.starts, np.arange(len(texts)))
    want = {(int(group.rep[a]), int(group.rep[b]), s) for left, right, score in compare(group, group, packed, 0.7, work) for a, b, s in zip(left, right, score)}
    for pairs in (1, 500, 1 << 16):
        pool = Pool(0.7, pairs)
        again = Work()
        found = [*collect(group, group, pool, again), *pool.matches()]
        got = [(int(a), int(b), s) for rep_a, rep_b, _, _, score in found for a, b, s in zip(rep_a, rep_b, score)]
        assert len(got) == len(set(got)) and set(got) == want and vars(again) == vars(work) and len(want) > 150


@pytest.mark.parametrize("reducers", [1, 5, 64])
def test_plan_by_cells_covers_every_pair_once(spark, sf_dir, reducers):
    reps, _ = representatives(keyed_entities(document_lines(spark, sf_dir)))
    banded, units, tasks = match.work_plan_assigned(reps, reducers)
    routed = work_route(banded, units, tasks)
    got = compared_pairs(place_by_reducer(routed, reducers), ["reducer", "rank"], 0.7).first()
    rows = reps.select("rep", "block", "len", "llen").collect()
    by_block = {}
    for r in rows:
        by_block.setdefault(r.block, []).append(r)
    close = sum(1 for b in by_block.values() for i, x in enumerate(b) for y in b[:i]
                if abs(x.llen - y.llen) <= int((0.3 * max(x.len, y.len)) * (1 + 1e-12) + 1e-9))
    total = sum(len(b) * (len(b) - 1) // 2 for b in by_block.values())
    assert got.after_lengths == close and close <= got.pairs < total and got.after_letters <= close
    assert tasks.agg(F.sum("comps")).first()[0] == got.pairs


@pytest.mark.parametrize("reducers", [64, 512])
def test_cells_are_even(spark, reducers):
    reps, _ = representatives(keyed_entities(document_lines(spark, "/root/testdata/sf0.01")))
    banded, units, tasks = match.work_plan_assigned(reps, reducers)
    loads = [float(r.cells) for r in reducer_load(tasks, "cells").collect()]
    largest = float(tasks.agg(F.max("cells")).first()[0])
    assert max(loads) <= 1.1 * max(sum(loads) / reducers, largest)  # a pair of long lines can be more than a reducer's share
    parts = cut_units(banded, units).groupBy("block", "band").agg(F.max("part").alias("p")).join(units, ["block", "band"])
    assert parts.filter("p >= parts").count() == 0


def test_split_by_pairs_gives_the_same(spark, sf_dir):
    ents = document_lines(spark, sf_dir)
    assert _set(match.split_match(ents, parts=3, reducers=5, work="pairs")) == _set(_brute(spark, ents))


def test_greedy_progressions():
    rng = random.Random(2)
    for _ in range(400):
        n = rng.randint(1, 9)
        heap = [(rng.choice([0, rng.randint(0, 300)]), r) for r in range(n)]
        heapq.heapify(heap)
        plain, first = list(heap), 0
        for cost in sorted({rng.randint(0, rng.choice([3, 50, 1000])) for _ in range(5)}, reverse=True):
            k, want = rng.choice([0, 1, 3, 20, 300]), {}
            for rank in range(first, first + k):
                load, r = plain[0]
                heapq.heapreplace(plain, (load + cost, r))
                want[rank] = r
            rows = deal_run(heap, cost, first, k)
            assert {a + s * m: r for a, s, c, r in rows for m in range(c)} == want and sum(c for _, _, c, _ in rows) == k
            assert sorted(heap) == sorted(plain)
            first += k


def test_greedy_writes_no_row_per_task():
    heap = [(r * 10 ** 9, r) for r in range(16)]
    rows = deal_run(heap, 3, 0, 10 ** 12)
    assert len(rows) <= 2 * 16 + 16 * 17 and sum(c for _, _, c, _ in rows) == 10 ** 12
    assert max(heap)[0] - min(heap)[0] <= 3


def test_slice_copies_at_most_one_per_reducer(spark):
    ents = entities(spark, ["abc%03d" % k for k in range(200)] + ["xyz1", "xyz2"])
    keyed = keyed_entities(ents)
    stats, assigned = match.slice_plan_assigned(keyed, 3)
    assert assigned.filter("block = 'ABC'").count() > 3  # more slices than reducers
    copies = slice_copies(entity_positions(keyed), stats, assigned)
    each = copies.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("reducer").alias("r"), F.sum(F.col("own").cast("int")).alias("own"))
    assert each.filter("n > 3 or n != r or own != 1").count() == 0
    a, b = copies.filter("own").alias("a"), copies.alias("b")
    pairs = a.join(b, ["reducer", "block"]).filter("a.pos < b.pos").select(F.col("a.id").alias("x"), F.col("b.id").alias("y")).collect()
    assert len(pairs) == len(set(pairs)) == 200 * 199 // 2 + 1


def test_members_of_few_bytes_are_expanded_by_many_tasks(spark):
    reps, members = representatives(entities(spark, [f"text number {k % 3}" for k in range(90)]).withColumn("block", F.lit("k")))
    rows = {r.rep: r.n for r in reps.collect()}
    found = spark.createDataFrame([(a, b, rows[a], rows[b], 0.9) for a in rows for b in rows if a < b], "rep_a long, rep_b long, n_a long, n_b long, similarity double")
    pairs = member_pairs(found, reps, members)
    assert pairs.rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert pairs.count() == pairs.select("id_a", "id_b").distinct().count() == 90 * 89 // 2


def test_members_come_in_bounded_batches():
    import pyarrow as pa

    from skewmatch.operators.pairs import OWN, WITH_MEMBERS, Pool, Texts, Work, collect

    kind = pa.list_(pa.struct([("id", pa.int64()), ("text", pa.string())]))
    low = [f"the same words {k}" for k in range(40)]
    members = list(pa.array([[{"id": 10 * k + c, "text": t} for c in range(1 + k % 4)] for k, t in enumerate(low)], kind))
    texts = Texts({"rep": list(range(40)), "low": low, "n": [1 + k % 4 for k in range(40)], "place": [0] * 40, "len": [len(t) for t in low],
                   "side": [OWN] * 40, "members": members})
    want = sorted((10 * i + a, 10 * j + b) for i in range(40) for j in range(i) for a in range(1 + i % 4) for b in range(1 + j % 4))
    for limits in ({"most": 50}, {"room": 2000}, {}):
        pool, got, largest = Pool(0.7, which=WITH_MEMBERS, **limits), [], 0
        for batch in [*collect(texts, texts, pool, Work()), *pool.matches()]:
            ids = [c.to_pylist() for c in batch[:2]]
            got += [(max(p), min(p)) for p in zip(*ids)]
            assert [low[i // 10] for i in ids[0]] == batch[2].to_pylist()
            largest = max(largest, len(ids[0]))
        assert sorted(got) == want and largest <= 50 + 16 or not limits


def _plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
    return row[-1]


def test_a_large_left_side_does_not_empty_the_pool_at_every_row(monkeypatch):
    """Distances are pooled over many right rows, however many characters the left side has; the matches are those of a plain scan."""
    from skewmatch.operators import pairs

    rng = np.random.default_rng(8)
    words = ["the", "and", "tion", "of", "er", "los", "é", "zu"]
    texts = [" ".join(rng.choice(words, rng.integers(6, 14))) for _ in range(260)]
    texts += [t[:7] + "x" + t[9:] for t in texts[:30]]
    rows = lambda some, first: {"rep": list(range(first, first + len(some))), "n": [1] * len(some), "place": [int(first > 0)] * len(some),
                                "len": [len(t) for t in some], "side": [1] * len(some), "low": some}
    left, right = pairs.Texts(rows(texts[:220], 0)), pairs.Texts(rows(texts[220:], 220))
    calls, distances = [], pairs.pair_distances
    monkeypatch.setattr(pairs, "pair_distances", lambda *a: (calls.append(len(a[1])), distances(*a))[1])
    pool, work = pairs.Pool(0.7, characters=1000), pairs.Work()
    found = [*pairs.collect(left, right, pool, work), *pool.matches()]
    got = {(int(a), int(b)) for f in found for a, b in zip(f[0], f[1])}
    want = {(a, b) for a in range(220) for b in range(220, 290)
            if _plain_distance(texts[a], texts[b]) <= int(0.3 * max(len(texts[a]), len(texts[b])) + 1e-9)}
    assert got == want and want and work.pairs == 220 * 70
    assert len(calls) <= 2


def test_letters_to_come_rule_out_no_match():
    """Long texts, some near to each other, some with letters that stand only at one end: every distance within its limit is exact."""
    from skewmatch.functions.distance import BOUNDED, LETTERS, Letters, code_points, letter_counts, pair_distances

    rng = np.random.default_rng(4)
    base = ["".join(rng.choice(list("abcde éß\t"), rng.integers(90, 200))) for _ in range(14)]
    texts = []
    for t in base:
        cut = list(t)
        for _ in range(int(rng.integers(5, 60))):
            at = int(rng.integers(0, len(cut)))
            cut[at:at + int(rng.integers(0, 2))] = ["z"] * int(rng.integers(0, 2))
        texts += [t, "".join(cut), t[40:] + "q" * 20, "w" * 25 + t]
    points, starts = code_points(texts)
    size = np.diff(starts)
    a, b = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    limit = np.floor(0.3 * np.maximum(size[a], size[b]) + 1e-9).astype(np.int64)
    got = pair_distances(points, starts[a], size[a], starts[b], size[b], limit)
    for x, y, k, d in zip(a.tolist(), b.tolist(), limit.tolist(), got.tolist()):
        if x < y:
            real = _plain_distance(texts[x], texts[y])
            assert d == real if real <= k else d > k
    assert size.max() > BOUNDED and ((got <= limit) & (a < b)).sum() > 10

    table = Letters(points, starts[:-1], size)
    whole = letter_counts(points, starts)
    assert (table.counts[table.base + table.blocks] - table.counts[table.base] == whole).all() and whole.shape[1] == len(LETTERS) + 1
    one, two = np.array([0, 5]), np.array([1, 9])
    row = np.array([32, 17])
    for k, lacks in enumerate(table(one, two, table.wholes(one, two), row, 48).tolist()):
        rest = letter_counts(*code_points([texts[one[k]][-(-row[k] // 16) * 16:], texts[two[k]][48:]]))
        assert lacks == np.maximum(rest[0] - rest[1], 0).sum()
