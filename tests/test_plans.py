"""Planning invariants: BDM numbers, split and slice plans, assignment."""

from pyspark.sql import functions as F

from conftest import entities
from skewmatch.operators import distribution as dist
from skewmatch.operators.ordinal import ordinal, positions
from skewmatch.operators.route import plan_lookup
from skewmatch.plans.assign import assign_reducers, reducer_load
from skewmatch.plans.slicer import slice_plan
from skewmatch.plans.split import split_plan
from skewmatch.sources.tables import document_lines


def _stats(spark, sf_dir, reducers=4, parts=4):
    keyed = dist.keyed_entities(document_lines(spark, sf_dir), "prefix", parts)
    return dist.block_stats(keyed, reducers)


def test_split_costs_add_up(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    total = stats.agg(F.sum("comps")).first()[0]
    plan = split_plan(stats)
    assert plan.agg(F.sum("comps")).first()[0] == total


def test_slice_plan_invariants(spark, sf_dir):
    for reducers in (2, 4, 9):
        stats = _stats(spark, sf_dir, reducers)
        total = stats.agg(F.sum("comps")).first()[0]
        target = stats.first().target
        plan = slice_plan(stats)
        assert plan.agg(F.sum("comps")).first()[0] == total
        # Cut slices stay within the target; the slices of a block tile it.
        assert plan.filter((F.col("slice") >= 1) & (F.col("comps") > target)).count() == 0
        per_block = plan.groupBy("block").agg(F.sum("u").alias("own"))
        joined = per_block.join(stats.select("block", "n"), "block")
        assert joined.filter(F.col("own") != F.col("n")).count() == 0


def test_unsliced_block(spark):
    # 10 entities in one block, W large enough that target < n - 1: u = 0 at
    # once, so the block stays one slice of 45 comparisons.
    texts = ["abc%d" % i for i in range(10)] + ["x%02d%s" % (i, "y") for i in range(30)]
    keyed = dist.keyed_entities(entities(spark, texts), "prefix", 4)
    stats = dist.block_stats(keyed, 12)
    target = stats.first().target
    assert target < 9
    plan = slice_plan(stats).filter(F.col("block") == "ABC").collect()
    assert [(r.slice, r.comps) for r in plan] == [(0, 45)]


def test_one_reducer(spark, sf_dir):
    stats = _stats(spark, sf_dir, reducers=1)
    assert stats.filter("oversized").count() == 0
    assert stats.first().target == stats.agg(F.sum("comps")).first()[0]


def test_greedy_is_balanced_and_exact(spark, sf_dir):
    stats = _stats(spark, sf_dir)
    plan = split_plan(stats)
    assigned = assign_reducers(plan, 4, ["block", "i", "j"])
    tasks = sorted(((-r.comps, r.block, r.i, r.j) for r in plan.collect()))
    loads = [0] * 4
    want = {}
    for c, b, i, j in tasks:
        r = loads.index(min(loads))
        loads[r] += -c
        want[(b, i, j)] = r
    got = {(r.block, r.i, r.j): r.reducer for r in assigned.collect()}
    assert got == want
    load = {r.reducer: r.comps for r in reducer_load(assigned).collect()}
    assert max(load.values()) <= float(stats.first().target) * 1.05


def test_greedy_of_many_tasks(spark):
    # More than 10,000 tasks, many of equal cost and many of cost 0: plain greedy, task by task.
    tasks = spark.range(25_000).select(F.format_string("b%05d", "id").alias("block"),
                                       (F.pmod(F.xxhash64("id"), F.lit(700)) * F.pmod("id", F.lit(3))).alias("comps"))
    loads = [0] * 7
    want = {}
    for cost, block in sorted((-r.comps, r.block) for r in tasks.collect()):
        pick = loads.index(min(loads))
        loads[pick] -= cost
        want[block] = pick
    got = {r.block: r.reducer for r in assign_reducers(tasks, 7, ["block"]).collect()}
    assert got == want


def test_ordinal_is_stable_across_plans(spark, sf_dir):
    keyed = dist.keyed_entities(document_lines(spark, sf_dir), "prefix", 4)
    blocks = dist.block_sizes(dist.block_partition_counts(keyed))
    o = ordinal(blocks, [F.col("block")], "ix")
    a = {r.block: r.ix for r in o.select("block", "ix").collect()}
    b = {r.block: r.ix for r in o.select("block", "ix", "n").collect()}
    want = {k: i for i, k in enumerate(sorted(a))}
    assert a == b == want


def test_positions_do_not_depend_on_partitions(spark, sf_dir):
    keyed = dist.keyed_entities(document_lines(spark, sf_dir), "prefix", 4)
    by_block = {}
    for r in keyed.collect():
        by_block.setdefault(r.block, []).append(r.id)
    want = {(b, i): p for b, ids in by_block.items() for p, i in enumerate(sorted(ids))}
    for partitions in (1, 7, 40):
        pos = positions(keyed, ["block"], "id", "pos", partitions).collect()
        assert {(r.block, r.id): r.pos for r in pos} == want
        assert len(pos) == len(want)


def test_plan_lookup_keeps_every_entity(spark, sf_dir):
    # A block with most of the entities is dealt over salts; every entity still finds its row.
    texts = ["hot%d" % i for i in range(300)] + ["c%02dx" % i for i in range(50)]
    keyed = dist.keyed_entities(entities(spark, texts))
    stats = dist.block_stats(keyed, 4)
    got = plan_lookup(keyed, stats.select("block", "n"), stats, partitions=16).collect()
    assert sorted(r.id for r in got) == list(range(350))
    assert {r.n for r in got if r.block == "HOT"} == {300}


def test_slice_size_exact_for_huge_blocks(spark):
    from decimal import Decimal
    from skewmatch.plans.slicer import slice_size
    cases = [(10, 4), (114, 2294), (92, 2294), (63, 2294), (5, 10), (10**8, 10**15),
             (3 * 10**9, 10**18), (123456789, 987654321098765), (2 * 10**9, 123456789012345678)]
    df = spark.createDataFrame(cases, "n long, t long")
    got = {(r.n, r.t): r.u for r in df.select("n", "t", slice_size(F.col("n"), F.col("t")).alias("u")).collect()}
    for n, t in cases:
        u = got[(n, t)]
        b = 2 * n - 1
        if b * b - 8 * t < 0:
            assert u == 0
            continue
        # largest u <= n - 1 with u(b - u) <= 2t, in exact integers
        assert Decimal(u) * (b - u) <= 2 * t and u <= n - 1
        assert u + 1 > n - 1 or Decimal(u + 1) * (b - u - 1) > 2 * t
    # the first slice of the fixture block (114 entities, target 2,294) takes 22
    assert got[(114, 2294)] == 22 and got[(92, 2294)] == 29


def test_pair_counts_of_huge_blocks(spark):
    sizes = [3 * 10**9 + 1, 10**12, 7, 1]
    counts = spark.createDataFrame([("b%d" % i, 0, n) for i, n in enumerate(sizes)], "block string, part int, size long")
    totals = dist.block_totals(dist.block_sizes(counts), 3).first()
    want = sum(n * (n - 1) // 2 for n in sizes)
    assert (int(totals.total_comps), int(totals.target)) == (want, -(-want // 3))
