"""Line-first quality rules, in column expressions only.

Each line is judged by navigation, symbol, punctuation and boilerplate rules and failing lines are taken
out; a document that loses too large a share of its characters that way, or that fails the base
rules on its whole text, is rejected. All work is inside the document's row: no shuffle.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import count_of, let, text_of, words_of

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
MAX_LOST_PERCENT = 50

#: Fixed values of the line rules.
SYMBOLS = r"[#*$%&|<>]"
SEPARATORS = r"[|>»•]"
SHOUTS = r"[!?]{2,}"
SENTENCE_MARK = r"[.!?:;,]"
BOILERPLATE = (
    "all rights reserved",
    "terms of use",
    "terms of service",
    "privacy policy",
    "cookie policy",
    "cookie settings",
    "accept cookies",
    "accept all cookies",
    "enable javascript",
    "skip to content",
    "skip to main content",
    "sign up for our newsletter",
    "click here to",
    "subscribe now",
    "subscribe to our",
    "licensed under the ",
)


def repeated_words(words: Column) -> Column:
    """Words that stand in a window of five words which the text has twice or more.

    Windows are compared by a 64-bit hash of word hashes, inside one text only. They are sorted only
    where a hash set has shown that one repeats.
    """

    def windows(h: Column) -> Column:
        last = F.size(h) - WINDOW
        parts = lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(WINDOW)])
        return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), parts))

    def found_again(ordered: Column) -> Column:
        same = lambda e, i: F.coalesce(F.get(ordered, i)["h"] == e["h"], F.lit(False))
        marked = F.transform(
            ordered,
            lambda e, i: F.when(same(e, i - 1) | same(e, i + 1), e["i"]),
        )
        return F.array_sort(F.filter(marked, lambda i: i.isNotNull()))

    def covered(starts: Column) -> Column:
        gap = lambda s, i: F.coalesce(F.get(starts, i + 1) - s, F.lit(WINDOW))
        each = F.transform(starts, lambda s, i: F.least(F.lit(WINDOW), gap(s, i)).cast("long"))
        return F.aggregate(each, F.lit(0).cast("long"), lambda a, x: a + x)

    def count(w: Column) -> Column:
        ordered = F.sort_array(F.transform(w, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        long_way = let(ordered, lambda o: let(found_again(o), covered))
        return F.when(F.size(F.array_distinct(w)) < F.size(w), long_way)

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.coalesce(let(let(hashes, windows), count), F.lit(0).cast("long"))


def line_passes(line: Column) -> Column:
    """True for a line that stays; a line without a word stays."""

    def rules(n: Column) -> Column:
        navigation = (count_of(line, SEPARATORS) >= 2) & (count_of(line, SEPARATORS) * 4 >= n)
        symbols = count_of(line, SYMBOLS) * 4 >= n
        shouting = (count_of(line, SHOUTS) >= 2) & (count_of(line, SHOUTS) * 4 >= n)
        unpunctuated = (n >= 40) & (count_of(line, SENTENCE_MARK) * 40 < n)
        boilerplate = let(
            F.lower(line), lambda low: reduce(or_, [F.contains(low, F.lit(p)) for p in BOILERPLATE])
        )
        return ~(navigation | symbols | shouting | unpunctuated | boilerplate)

    return let(F.size(words_of(line)), lambda n: (n == 0) | rules(n))


def judge(docs: DataFrame, max_lost_percent: int = MAX_LOST_PERCENT) -> DataFrame:
    """All columns of ``docs`` plus the counts, ``clean_text``, ``base_failed`` and ``kept``.

    Counts (long): ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines`` (lines with a word that
    equal an earlier line), ``n_repeat_words``, ``n_lines_removed``, ``lost_chars`` (code points of
    removed lines). ``base_failed``: fewer than ten words, or over 20 % of the words repeated in windows.
    ``kept``: not ``base_failed``, and removed lines hold at most ``max_lost_percent`` of the characters.
    ``clean_text``: the lines that pass, joined by \\n. Input columns of these names are replaced.
    A null or empty text has no words and fails; an empty table gives none; a row is judged alone,
    whatever its id and however often it is repeated.
    """

    def measures(t: Column) -> Column:
        lines = F.split(t, "\n")
        counts = let(
            words_of(t),
            lambda w: F.struct(
                F.size(w).cast("long").alias("n_words"),
                F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
                repeated_words(w).alias("n_repeat_words"),
            ),
        )
        worded = F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        dup = let(worded, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        verdicts = F.transform(
            lines, lambda x: F.struct(x.alias("line"), line_passes(x).alias("ok"))
        )
        clean = let(
            verdicts,
            lambda v: F.struct(
                F.array_join(
                    F.transform(F.filter(v, lambda x: x["ok"]), lambda x: x["line"]), "\n"
                ).alias("clean_text"),
                F.size(F.filter(v, lambda x: ~x["ok"])).cast("long").alias("n_lines_removed"),
                F.aggregate(
                    F.filter(v, lambda x: ~x["ok"]),
                    F.lit(0).cast("long"),
                    lambda a, x: a + F.length(x["line"]),
                ).alias("lost_chars"),
            ),
        )
        return F.struct(
            counts.alias("words"),
            count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            dup.alias("n_dup_lines"),
            clean.alias("clean"),
            F.length(t).alias("length"),
        )

    m, found = F.col("__measured"), let(text_of(), measures)
    # explode of one element: a barrier, so that the measures are not computed once for each use
    rows = docs.withColumn("__measured", F.explode(F.array(found)))
    base = (m["words"]["n_words"] < MIN_WORDS) | (
        100 * m["words"]["n_repeat_words"] > MAX_REPEAT_PERCENT * m["words"]["n_words"]
    )
    lost = m["clean"]["lost_chars"] * 100 > F.lit(max_lost_percent) * m["length"]
    return rows.withColumns(
        {
            **{k: m["words"][k] for k in ("n_words", "word_chars", "n_repeat_words")},
            **{k: m[k] for k in ("n_symbols", "n_dup_lines")},
            **{k: m["clean"][k] for k in ("clean_text", "n_lines_removed", "lost_chars")},
            "base_failed": base,
            "kept": ~base & ~lost,
        }
    ).drop("__measured")
