"""Matchers: fixtures, equivalence of the three strategies, edge cases."""

import pytest
from pyspark.sql import functions as F

from conftest import entities
from skewmatch.functions.keys import key_prefix
from skewmatch.operators import match
from skewmatch.operators.distribution import keyed_entities
from skewmatch.operators.route import entity_positions, slice_route
from skewmatch.sources.tables import document_lines, tokenize_words

# Every stem with every ending: two blocks under the default key, near and far pairs, one non-ASCII letter.
SAMPLE = [stem + end for stem in ("harbor ", "Harbour l", "haR.b", "Gr") for end in ("ight", "igth ", "", "\u00e9toile", "ights of")]


def _lev(a, b):
    """Plain dynamic-programming edit distance (test oracle)."""
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def _py_sim(a, b):
    longer = max(len(a), len(b))
    return 1.0 if longer == 0 else (longer - _lev(a.lower(), b.lower())) / longer


def _py_key(t):
    return ">>>" if len(t) < 3 else t[:3].replace(".", ",").upper()


def _set(df):
    return sorted((r.id_a, r.id_b, r.similarity) for r in df.select("id_a", "id_b", "similarity").collect())


def _brute(spark, ents, key=key_prefix, threshold=0.7):
    from skewmatch.functions.similarity import similarity
    k = ents.select("id", "text", key("text").alias("block"))
    a = k.select("block", F.col("id").alias("id_a"), F.col("text").alias("ta"))
    b = k.select("block", F.col("id").alias("id_b"), F.col("text").alias("tb"))
    pairs = a.join(b, "block").filter("id_a < id_b").withColumn("similarity", similarity("ta", "tb"))
    return pairs.filter(F.col("similarity") >= threshold)


def test_sample_lines_against_python(spark):
    ents = entities(spark, SAMPLE)
    pairs = [(i, j, _py_sim(SAMPLE[i], SAMPLE[j])) for i in range(len(SAMPLE)) for j in range(i + 1, len(SAMPLE))
             if _py_key(SAMPLE[i]) == _py_key(SAMPLE[j])]
    assert len(pairs) > len(SAMPLE)
    assert _set(_brute(spark, ents, threshold=0.0)) == sorted(pairs)
    want = sorted(p for p in pairs if p[2] >= 0.7)
    assert _set(match.split_match(ents)) == want
    assert _set(match.slice_match(ents)) == want


def test_two_source_sample(spark):
    lines = spark.createDataFrame([(t,) for t in SAMPLE], "line string")
    words = tokenize_words(lines.distinct())
    got = sorted((r.word_a, r.word_b, r.similarity) for r in match.two_source_match(words, words).collect()
                 for _ in range(r.occurrences))
    ws = [w for t in SAMPLE for w in t.split(" ") if w]
    want = sorted((a, b, _py_sim(a, b)) for a in ws for b in ws
                  if a[:1].lower() == b[:1].lower() and _py_sim(a, b) >= 0.7)
    assert got == want
    assert len(got) > len(ws)  # more than the equal pairs


def test_two_source_keeps_multiplicity(spark):
    left = spark.createDataFrame([("abc",), ("abc",), ("abd",)], "word string")
    right = spark.createDataFrame([("abc",), ("abc",)], "word string")
    got = match.two_source_match(left, right, reducers=3).collect()
    # 2 x 2 for abc-abc; abd-abc scores 0.67
    assert [(r.word_a, r.word_b, r.similarity, r.occurrences) for r in got] == [("abc", "abc", 1.0, 4)]


def test_two_source_counts_a_hot_word(spark):
    hot = spark.range(50_000).select(F.lit("word").alias("word"))
    got = match.two_source_match(hot, hot).collect()
    assert [(r.word_a, r.word_b, r.occurrences) for r in got] == [("word", "word", 50_000 ** 2)]


@pytest.mark.parametrize("parts,reducers", [(1, 1), (4, 4), (3, 7), (5, 2)])
def test_split_and_slice_equal_brute_force(spark, sf_dir, parts, reducers):
    ents = document_lines(spark, sf_dir)
    want = _set(_brute(spark, ents))
    assert len(want) == 1112
    assert _set(match.split_match(ents, parts=parts, reducers=reducers)) == want
    assert _set(match.slice_match(ents, parts=parts, reducers=reducers)) == want


def test_basic_match_uses_lower_key(spark, sf_dir):
    from skewmatch.functions.keys import key_prefix_lower
    ents = document_lines(spark, sf_dir)
    assert _set(match.basic_match(ents)) == _set(_brute(spark, ents, key_prefix_lower))


def test_every_pair_compared_once(spark):
    # Threshold 0 keeps every pair: the matchers must then return all pairs of
    # every block, each exactly once, even for a block cut into many tasks.
    texts = ["abc%d" % i for i in range(40)] + ["xyz%d" % i for i in range(7)] + ["q"]
    ents = entities(spark, texts)
    n_pairs = 40 * 39 // 2 + 7 * 6 // 2
    for fn in (match.split_match, match.slice_match):
        got = fn(ents, parts=4, reducers=5, threshold=0.0)
        rows = got.select("id_a", "id_b").collect()
        assert len(rows) == n_pairs
        assert len(set(rows)) == n_pairs


@pytest.mark.parametrize("texts,expected", [
    (["", ""], 1),                      # empty texts: block >>>, similarity 1.0
    (["ab", "AB", ">>>x"], 1),          # all in >>>; ab-AB = 1.0
    (["abc.<*>", "abc.<*>"], 1),        # a replica mark inside a text is just text
    (["aaa", "bbb", "ccc"], 0),         # singletons: no task, no rows
])
def test_edge_cases(spark, texts, expected):
    ents = entities(spark, texts)
    for fn in (match.basic_match, match.split_match, match.slice_match):
        assert fn(ents).count() == expected


def test_dot_key(spark):
    ents = entities(spark, ["a.bc", "a,bc"])
    # One block with the default key (A,B), two with the basic key.
    assert match.split_match(ents).count() == 1
    assert match.basic_match(ents).count() == 0


def test_tagged_split_match(spark, sf_dir):
    ents = document_lines(spark, sf_dir)
    tagged = match.split_match(ents, tagged=True)
    assert set(tagged.columns) >= {"reducer", "block", "i", "j", "part_a", "part_b"}
    rows = tagged.collect()
    assert len(rows) == 1112
    for r in rows:
        if r.i != r.j:  # cross task: one side from each part
            assert {r.part_a, r.part_b} == {r.i, r.j}
        elif r.i != 0:  # self task of an oversized block
            assert r.part_a == r.part_b == r.i


def test_tagged_matches_are_not_left_to_the_planned_reducers(spark):
    texts = ["the same text"] * 30 + ["the same tent"] * 20 + ["another text", "ab", "AB"]
    ents = entities(spark, texts)
    tagged = match.split_match(ents, tagged=True, parts=3, reducers=2)
    assert tagged.rdd.getNumPartitions() > 2
    plan = {(r.block, r.i, r.j): r.reducer for r in match.split_plan_assigned(match.keyed_entities(ents, "prefix", 3), 2)[1].collect()}
    rows = tagged.collect()
    assert len(rows) == 50 * 49 // 2 + 1
    for r in rows:
        a, b = r.id_a % 3, r.id_b % 3
        cut = r.block == "THE"
        assert r.id_a < r.id_b and (r.part_a, r.part_b) == (a, b) and (r.i, r.j) == ((max(a, b), min(a, b)) if cut else (0, 0))
        assert r.reducer == plan[r.block, r.i, r.j]


def test_basic_match_salted_hot_blocks(spark, sf_dir):
    # Many partitions salt many blocks into groups: same pairs.
    from skewmatch.functions.keys import key_prefix_lower
    ents = document_lines(spark, sf_dir)
    assert _set(match.basic_match(ents, partitions=97)) == _set(_brute(spark, ents, key_prefix_lower))


def test_task_keys_never_collide(spark):
    # Two oversized blocks cut into 12 parts each: tasks such as (block 1,
    # i 11, j 0) and (block 11, i 1, j 0) exist side by side on few reducers.
    # Typed task keys keep the blocks apart: every result pair is in-block.
    texts = ["aaa%03d" % i for i in range(60)] + ["bbb%03d" % i for i in range(60)]
    ents = entities(spark, texts)
    want = _set(_brute(spark, ents, threshold=0.0))
    for fn in (match.split_match, match.slice_match):
        got = fn(ents, parts=12, reducers=2, threshold=0.0)
        assert _set(got) == want


def test_more_reducers_than_tasks(spark):
    texts = ["abcd%d" % i for i in range(12)] + ["wxyz%d" % i for i in range(5)]
    ents = entities(spark, texts)
    want = _set(_brute(spark, ents, threshold=0.0))
    for fn in (match.split_match, match.slice_match):
        assert _set(fn(ents, parts=3, reducers=50, threshold=0.0)) == want


def test_composite_ids(spark):
    # The same entities under a plain id and under (record, line).
    plain = entities(spark, SAMPLE)
    pair = plain.select(F.struct(F.floor(F.col("id") / 3).alias("record"), (F.col("id") % 3).alias("line")).alias("id"), "text")
    for fn in (match.basic_match, match.split_match, match.slice_match):
        got = sorted((r.id_a.record * 3 + r.id_a.line, r.id_b.record * 3 + r.id_b.line, r.similarity)
                     for r in fn(pair).select("id_a", "id_b", "similarity").collect())
        assert got == _set(fn(plain))


def test_slice_match_shows_empty_entities(spark):
    ents = entities(spark, ["", "", "abc"])
    got = match.slice_match(ents, show_empty=True).collect()
    assert [(r.text_a, r.text_b, r.similarity) for r in got] == [("<><><>", "<><><>", 1.0)]


def test_hot_block_is_never_grouped_whole(spark, sf_dir):
    # With broadcasts off, no window or aggregate of the slice plan sits on rows
    # placed by block alone, and the lookups join on a salt as well.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        keyed = keyed_entities(document_lines(spark, sf_dir))
        stats, assigned = match.slice_plan_assigned(keyed, 4)
        routed = slice_route(entity_positions(keyed), stats, assigned)
        plan = routed._jdf.queryExecution().executedPlan().toString()
        assert routed.count() > 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    joins = [line for line in plan.split("\n") if "SortMergeJoin" in line]
    assert joins and not [j for j in joins if "SortMergeJoin [block" in j and "_salt" not in j]


def _above(df):
    """What stands above the comparison in the plan, from the result down."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan[:plan.index("MapInArrow")]


@pytest.mark.parametrize("find", [match.basic_match, match.split_match, match.slice_match])
def test_pairs_of_distinct_texts_are_not_shuffled(spark, find):
    # The pairs grow with the square of the texts: they leave the tasks that compare them as rows of the result.
    got = find(entities(spark, ["some text %03d" % i for i in range(60)]), bring=True)
    above = _above(got)
    assert "Exchange" not in above and "Join" not in above
    assert got.count() == 60 * 59 // 2


@pytest.mark.parametrize("kind", ["plain", "struct"])
def test_texts_with_few_and_with_many_members(spark, kind):
    # Copies within and beyond what travels with a text, in both cases of the letters, and one text alone.
    from skewmatch.operators.pairs import FEW

    texts = []
    for k, copies in enumerate([1, 2, FEW, FEW + 1, 3 * FEW, 1]):
        texts += [("Member of a text %d" if c % 2 else "member of a TEXT %d") % k for c in range(copies)]
    texts += ["quite another line"] + ["xy"] * (FEW + 2) + ["xz", ""]
    ents = entities(spark, texts)
    want = sorted((i, j, texts[i], texts[j], _py_sim(texts[i], texts[j])) for i in range(len(texts)) for j in range(i + 1, len(texts))
                  if _py_key(texts[i]) == _py_key(texts[j]) and _py_sim(texts[i], texts[j]) >= 0.7)
    field = lambda c: F.col(c)
    if kind == "struct":
        ents = ents.select(F.struct(F.lit("r").alias("record"), F.col("id").alias("line")).alias("id"), "text")
        field = lambda c: F.col(c)["line"]
    for find, more in ((match.split_match, {}), (match.slice_match, {}), (match.split_match, {"work": "pairs"})):
        got = find(ents, bring=True, **more).select(field("id_a"), field("id_b"), "text_a", "text_b", "similarity")
        assert sorted(tuple(r) for r in got.collect()) == want
