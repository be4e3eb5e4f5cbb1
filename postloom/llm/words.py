"""Words and word shingles, as Spark expressions and on UTF-8 bytes.

A word is a run of bytes other than space and \\x09 to \\x0D, so ``bytes.split()`` and the
pattern below agree on every text.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = "[\\x20\\x09-\\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded(text: Column) -> Column:
    """A-Z in lower case, all else unchanged."""
    return F.translate(text, UPPER, LOWER)


def word_list(text: Column) -> Column:
    """The words of a text, without empty ones; null gives none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")
