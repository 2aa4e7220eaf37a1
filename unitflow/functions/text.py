"""Text semantics as native column expressions: strip, split, normalise, script counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- Fixed values ------------------------------------------------------------------------------
# White space that a strip removes (Spark's trim knows U+0020 only).
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x20\x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# Line ends of a text file, and those of them that Spark's text source does not split on.
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"
RARE_LINE_BREAKS = "[\\x0B\\f\\x1C-\\x1E\\x85\\u2028\\u2029]"

# Characters that become an ASCII apostrophe, quote, hyphen or space.
APOSTROPHES = "\u02bb\u02bc\u02bd\u2018\u2019\u201b\u2032\u0060\u00b4\u02b9\u02c8\ufffd"
QUOTES = "\u201c\u201d\u201e\u00ab\u00bb"
DASHES = "\u2013\u2014"
NO_BREAK_SPACE = "\u00a0"

# A question mark that stands for a lost apostrophe.
LOST_AFTER_O_OR_G = "(?<=[OoGg])\\?(?=[A-Za-z'])"
LOST_BETWEEN_LETTERS = "(?<=[A-Za-z])\\?(?=[A-Za-z])"
# Either of them in one pass, the question mark found first: neither looks at what the other has put in.
LOST_APOSTROPHE = "\\?(?:(?<=[OoGg]\\?)(?=[A-Za-z'])|(?<=[A-Za-z]\\?)(?=[A-Za-z]))"

# Characters that end a sentence where white space follows.
SENTENCE_ENDS = ".!?…"

CYRILLIC = "[\\u0400-\\u04FF]+"
LATIN = "[A-Za-z]+"

# First tokens that are language tags, and the word mark of sentence-piece tokens.
LANGUAGE_TAG = "^(eng_|rus_|uzn_|__)"
WORD_MARK = "▁"
# ------------------------------------------------------------------------------------------------


def strip_ws(text: Column) -> Column:
    """Remove Unicode white space from both ends."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and all-white-space text."""
    return strip_ws(F.coalesce(text, F.lit(""))) == ""


def normalize_uz(text: Column) -> Column:
    """ASCII apostrophes, quotes, hyphens and spaces; lost apostrophes restored. Idempotent.

    Only texts with a question mark pay for the pattern.
    """
    mapped = F.translate(
        text,
        APOSTROPHES + QUOTES + DASHES + NO_BREAK_SPACE,
        "'" * len(APOSTROPHES) + '"' * len(QUOTES) + "-" * len(DASHES) + " ",
    )
    restored = F.regexp_replace(mapped, LOST_APOSTROPHE, "'")
    return F.when(F.contains(text, F.lit("?")), restored).otherwise(mapped)


def letters(text: Column, runs: str) -> Column:
    """Number of characters that lie in runs of the given class."""
    return F.length(text) - F.length(F.regexp_replace(text, runs, ""))


def script_counts(text: Column) -> Column:
    """struct<cyr, lat>: Cyrillic and Latin letters in ``text``."""
    return F.struct(letters(text, CYRILLIC).alias("cyr"), letters(text, LATIN).alias("lat"))


def split_lines(text: Column, breaks: str = "\n") -> Column:
    """The paragraphs of a text, blank ones included."""
    return F.split(text, breaks)


def final_text(translated: Column, text: Column) -> Column:
    """The translation, or the original where there is none; normalised."""
    return normalize_uz(F.coalesce(F.nullif(translated, F.lit("")), text, F.lit("")))


def tokens_to_text(tokens: Column) -> Column:
    """Drop a leading language tag, join sentence pieces, strip, normalise."""
    # each step names what it works on once: Spark evaluates an expression with a lambda in it again at every place
    kept = F.filter(
        tokens, lambda t, i: ~((i == 0) & F.coalesce(t.rlike(LANGUAGE_TAG), F.lit(False)))
    )
    joined = F.replace(F.array_join(kept, ""), F.lit(WORD_MARK), F.lit(" "))
    stripped = F.transform(F.array(joined), strip_ws)
    return F.get(F.transform(stripped, normalize_uz), F.lit(0))


def paragraph_text(runs: Column) -> Column:
    return F.array_join(runs, "")


def replace_runs(runs: Column, new_text: Column) -> Column:
    """Put ``new_text`` into the first run that has text (else the first run), empty the rest.

    A paragraph without runs gets one run when there is text to place.
    """
    with_text = F.transform(runs, lambda r: F.coalesce(r, F.lit("")) != "")
    target = F.greatest(F.array_position(with_text, F.lit(True)), F.lit(1)) - 1
    placed = F.transform(runs, lambda r, i: F.when(i == target, new_text).otherwise(""))
    fresh = F.when(new_text != "", F.array(new_text)).otherwise(F.array().cast("array<string>"))
    return F.when(F.size(runs) > 0, placed).otherwise(fresh)


def side_by_side(source: Column, translated: Column) -> Column:
    """One report line: source, arrow, translation, separated by tabs."""
    from unitflow.options import SIDE_BY_SIDE_ARROW

    return F.concat_ws("\t", source, F.lit(SIDE_BY_SIDE_ARROW), translated)
