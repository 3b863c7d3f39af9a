"""Normalised edit similarity as Spark column expressions (no UDF).

``similarity(a, b) = (L - lev(lower a, lower b)) / L`` with ``L`` the larger
length of the texts as given (before lower-casing), and ``1.0`` when both are
empty. A pair matches when the similarity is at least the threshold.

Fixed value: the default threshold is 0.7.

For matching, :func:`match_similarity` gives the same value for every
matching pair but skips the quadratic distance where it can: the distance is
at least the difference of the lower-cased lengths, it is 0 for equal texts,
and otherwise it runs with a limit (the largest distance that can still
match), which confines it to a diagonal band.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_THRESHOLD = 0.7

def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def similarity(a, b) -> Column:
    """Exact normalised edit similarity of two string columns (DOUBLE)."""
    a, b = _col(a), _col(b)
    longer = F.greatest(F.length(a), F.length(b))
    dist = F.levenshtein(F.lower(a), F.lower(b))
    return F.when(longer == 0, F.lit(1.0)).otherwise((longer - dist).cast("double") / longer)


def score_pairs(pairs: DataFrame, left: str, right: str, name: str = "similarity") -> DataFrame:
    """Add the similarity of two text columns to a table of given pairs."""
    return pairs.withColumn(name, similarity(left, right))


def filter_similar(scored: DataFrame, threshold: float = DEFAULT_THRESHOLD,
                   name: str = "similarity") -> DataFrame:
    """Keep scored pairs whose similarity is at least ``threshold``."""
    return scored.filter(F.col(name) >= F.lit(threshold))


# --- matching with exact pruning -------------------------------------------

def with_match_features(df: DataFrame, text: str = "text", suffix: str = "") -> DataFrame:
    """Per-entity values the pair test reuses: the length, the lower-cased
    text and its length (lower-casing may change the length outside ASCII).

    Computed once per entity row, not once per pair.
    """
    return (df.withColumn(f"len{suffix}", F.length(F.col(text)))
              .withColumn(f"low{suffix}", F.lower(F.col(text)))
              .withColumn(f"llen{suffix}", F.length(F.col(f"low{suffix}"))))


def distance_limit(longer: Column, threshold: float) -> Column:
    """The largest distance a pair with similarity >= threshold can have.

    ``(L - d) / L >= t`` means ``d <= (1 - t) * L``; the product is rounded
    down after a tiny upward nudge that covers floating error, so the bound is
    never below the true one. The exact test on the similarity value is still
    applied afterwards.
    """
    return F.floor(F.lit(1.0 - threshold) * longer * F.lit(1 + 1e-12) + F.lit(1e-9)).cast("int")


def match_similarity(a: str, b: str, threshold: float = DEFAULT_THRESHOLD) -> Column:
    """Similarity for a candidate pair whose sides carry the columns of
    :func:`with_match_features` under suffixes ``a`` and ``b``.

    Equal to :func:`similarity` whenever that is >= threshold; for a pair
    that cannot match the value is negative, so one comparison with the
    threshold (:func:`is_match`) keeps exactly the matches.
    """
    longer = F.greatest(F.col(f"len{a}"), F.col(f"len{b}"))
    limit = distance_limit(longer, threshold)
    low_a, low_b = F.col(f"low{a}"), F.col(f"low{b}")
    # -1 means "above the limit" (the limited distance returns it too).
    dist = (F.when(F.abs(F.col(f"llen{a}") - F.col(f"llen{b}")) > limit, F.lit(-1))
             .when(low_a == low_b, F.lit(0))
             .otherwise(F.call_function("levenshtein", low_a, low_b, limit)))
    # pmod keeps a real distance (<= limit < L + 2) and turns -1 into L + 1,
    # a negative similarity: the distance is referenced once, so it runs once.
    return F.when(longer == 0, F.lit(1.0)).otherwise(
        (longer - F.pmod(dist, longer + 2)).cast("double") / longer)


def is_match(sim: Column, threshold: float = DEFAULT_THRESHOLD) -> Column:
    return sim >= F.lit(threshold)
