"""Character n-grams as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# One pattern per gram length. The look-ahead takes overlapping grams in one pass, and the dot
# behind it steps over whole characters, not over halves of those outside the first plane.
GRAM_PATTERNS = ("(?s)(.)", "(?s)(?=(..)).", "(?s)(?=(...)).")
LONGEST_GRAMS = "(?s)(?=(.{1,3}))."


def char_grams(text: Column) -> Column:
    """All 1-, 2- and 3-character grams of a text, repeats included."""
    return F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in GRAM_PATTERNS])


def longest_grams(text: Column) -> Column:
    """The gram of up to 3 characters that begins at each position."""
    return F.regexp_extract_all(text, F.lit(LONGEST_GRAMS), F.lit(1))
