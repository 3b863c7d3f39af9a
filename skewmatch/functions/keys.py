"""Blocking keys and entity tags, as Spark column expressions.

Fixed values that must equal the original tool's for the same blocks:
  * texts shorter than 3 characters all go to the block ``>>>``;
  * the default key takes the first 3 characters, replaces ``.`` by ``,``
    and upper-cases (in that order);
  * the basic key lower-cases first, then takes the first 3 characters;
  * the two-source key is the first lower-cased character;
  * an empty entity is shown as ``<><><>`` when marking is asked for.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SHORT_KEY = ">>>"
EMPTY_MARK = "<><><>"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def key_prefix(text) -> Column:
    """Default key: ``>>>`` below 3 characters, else ``upper(replace(first 3, '.', ','))``."""
    t = _col(text)
    return (F.when(F.length(t) < 3, F.lit(SHORT_KEY))
            .otherwise(F.upper(F.replace(F.substring(t, 1, 3), F.lit("."), F.lit(",")))))


def key_prefix_lower(text) -> Column:
    """Basic key: ``>>>`` below 3 characters, else the first 3 of the lower-cased text."""
    t = _col(text)
    return F.when(F.length(t) < 3, F.lit(SHORT_KEY)).otherwise(F.substring(F.lower(t), 1, 3))


def key_first_char(word) -> Column:
    """Two-source key: first character of the lower-cased word."""
    return F.substring(F.lower(_col(word)), 1, 1)


def source_partition(id_col, parts: int) -> Column:
    """Deterministic source partition of an entity: ``pmod(id, parts)``.

    The original tool used the physical input split, which changes with the
    plan; a function of the id gives the same partition on every run.
    """
    return F.pmod(_col(id_col), F.lit(parts)).cast("int")


def mark_empty(text) -> Column:
    """Show an empty entity as ``<><><>`` (apply after the key is computed)."""
    t = _col(text)
    return F.when(t == "", F.lit(EMPTY_MARK)).otherwise(t)


KEYS = {
    "prefix": key_prefix,
    "prefix_lower": key_prefix_lower,
    "first_char": key_first_char,
}


def resolve_key(key):
    """Accept a key name from :data:`KEYS` or a column function."""
    if callable(key):
        return key
    return KEYS[key]
