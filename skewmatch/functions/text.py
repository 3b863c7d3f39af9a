"""Text shaping: lines and words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def split_lines(text) -> Column:
    """Split on newline like Java's ``String.split("\\n")``.

    Trailing empty pieces are dropped, a text without newline stays one
    piece (also when empty), and a text made only of newlines gives none.
    """
    t = _col(text)
    return (F.when(t.rlike("^\n+$"), F.array().cast("array<string>"))
            .otherwise(F.split(F.regexp_replace(t, "\n+$", ""), "\n")))


def split_words(line) -> Column:
    """Split a line on single spaces and drop empty words."""
    return F.filter(F.split(_col(line), " "), lambda w: w != "")
