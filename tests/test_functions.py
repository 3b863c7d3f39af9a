"""Keys, text shaping and similarity against fixed golden values."""

import pytest
from pyspark.sql import functions as F

from skewmatch.functions.keys import key_first_char, key_prefix, key_prefix_lower, mark_empty
from skewmatch.functions.similarity import is_match, match_similarity, similarity, with_match_features
from skewmatch.functions.text import split_lines, split_words

# The 14 worked examples of the original tool with their similarity.
GOLDEN = [
    ("", "", 1.0),
    ("1234567890", "1", 0.1),
    ("1234567890", "123", 0.3),
    ("1234567890", "1234567", 0.7),
    ("1234567890", "1234567890", 1.0),
    ("1234567890", "1234567980", 0.8),
    ("47/2010", "472010", 0.8571428571428571),
    ("47/2010", "472011", 0.7142857142857143),
    ("47/2010", "AB.CDEF", 0.0),
    ("47/2010", "4B.CDEFG", 0.125),
    ("47/2010", "AB.CDEFG", 0.0),
    ("The quick fox jumped", "The fox jumped", 0.7),
    ("The quick fox jumped", "The fox", 0.35),
    ("kitten", "sitting", 0.5714285714285714),
]


def test_golden_similarity(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in GOLDEN], "a string, b string")
    got = df.select("a", "b", similarity("a", "b").alias("s")).collect()
    assert [(r.a, r.b, r.s) for r in got] == GOLDEN


def test_pruned_similarity_equals_exact_on_matches(spark):
    df = spark.createDataFrame([(a, b) for a, b, _ in GOLDEN], "a string, b string")
    df = with_match_features(with_match_features(df, "a", "_a"), "b", "_b")
    got = df.select("a", "b", match_similarity("_a", "_b").alias("s")).filter(is_match(F.col("s"))).collect()
    assert sorted((r.a, r.b, r.s) for r in got) == sorted(g for g in GOLDEN if g[2] >= 0.7)


def test_case_insensitive_distance_uses_original_lengths(spark):
    df = spark.createDataFrame([("ab", "AB"), ("ABC", "abd")], "a string, b string")
    got = [r.s for r in df.select(similarity("a", "b").alias("s")).collect()]
    assert got == [1.0, 2 / 3]


@pytest.mark.parametrize("text,k4,k5", [
    ("", ">>>", ">>>"),
    ("ab", ">>>", ">>>"),
    (">>>x", ">>>", ">>>"),
    ("a.bc", "A,B", "a.b"),
    ("a,bc", "A,B", "a,b"),
    ("Märzwind", "MÄR", "mär"),
    ("The fox", "THE", "the"),
])
def test_block_keys(spark, text, k4, k5):
    row = spark.createDataFrame([(text,)], "t string").select(
        key_prefix("t").alias("k4"), key_prefix_lower("t").alias("k5"), key_first_char("t").alias("k1")).first()
    assert (row.k4, row.k5) == (k4, k5)
    assert row.k1 == text[:1].lower()


def test_mark_empty(spark):
    got = [r.m for r in spark.createDataFrame([("",), ("x",)], "t string").select(mark_empty("t").alias("m")).collect()]
    assert got == ["<><><>", "x"]


@pytest.mark.parametrize("text,lines", [
    ("a\nb", ["a", "b"]),
    ("a\n\nb\n\n", ["a", "", "b"]),
    ("", [""]),
    ("\n\n", []),
    ("a\r\nb", ["a\r", "b"]),
])
def test_split_lines_like_java(spark, text, lines):
    got = spark.createDataFrame([(text,)], "t string").select(split_lines("t").alias("l")).first().l
    assert got == lines


def test_split_words_drops_empty(spark):
    got = spark.createDataFrame([("a  b ",)], "t string").select(split_words("t").alias("w")).first().w
    assert got == ["a", "b"]


@pytest.mark.parametrize("threshold", [0.7, 0.5, 0.9, 0.75, 0.0])
def test_distance_limit_never_cuts_a_match(spark, threshold):
    from skewmatch.functions.similarity import distance_limit
    lengths = spark.range(1, 5001).select(F.col("id").cast("int").alias("L"))
    got = {r.L: r.lim for r in lengths.select("L", distance_limit(F.col("L"), threshold).alias("lim")).collect()}
    for length, lim in got.items():
        # the largest distance whose similarity, computed in doubles, still passes
        best = max(d for d in range(length + 1) if (length - d) / length >= threshold)
        assert lim >= best, (length, lim, best)
        assert lim <= best + 1, (length, lim, best)
