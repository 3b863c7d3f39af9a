"""Skew-aware entity matching on Spark DataFrames.

Entities are rows ``(id, text)``. They are grouped into blocks by a cheap key,
pairs inside a block are scored with a normalised edit distance, and pairs at
or above a threshold are kept. Large blocks are cut into match tasks (by
partition pairs, or by slices of equal pair count) that are assigned to
reducers by load, so every Spark task gets a similar number of comparisons.
"""

from skewmatch.functions.keys import (
    key_first_char,
    key_prefix,
    key_prefix_lower,
    mark_empty,
    source_partition,
)
from skewmatch.functions.similarity import (
    DEFAULT_THRESHOLD,
    filter_similar,
    score_pairs,
    similarity,
)

__all__ = [
    "DEFAULT_THRESHOLD",
    "filter_similar",
    "key_first_char",
    "key_prefix",
    "key_prefix_lower",
    "mark_empty",
    "score_pairs",
    "similarity",
    "source_partition",
]
