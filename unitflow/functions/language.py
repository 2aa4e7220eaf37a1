"""Source-language rules as native column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitflow.functions.text import CYRILLIC, LATIN, is_blank, letters, split_lines, strip_ws
from unitflow.options import ENGLISH, RUSSIAN, SUPPORTED_SOURCES, VOTE_HEAD, pinned_source

# --- Fixed values ------------------------------------------------------------------------------
CYRILLIC_LEAD = 1.2  # Cyrillic must outnumber Latin by this factor ...
CYRILLIC_LEAST = 3  # ... and reach this count to decide on its own
SHORT_TEXT = 20  # texts under this length are decided by script alone
LATIN_LABELS = ("en", "uz", "tr", "de", "fr", "es", "it")  # detector labels taken as English
RUSSIAN_LABEL = "ru"
# ------------------------------------------------------------------------------------------------


def stripped_profile(body: Column) -> Column:
    """struct<n, cyr, lat, lettered>: all that the language rule asks of a stripped text.

    Latin letters only matter against Cyrillic ones. A text without Cyrillic is scanned, not
    counted, and has both counts 0.
    """
    mixed = body.rlike(CYRILLIC)
    return F.struct(
        F.length(body).alias("n"),
        F.when(mixed, letters(body, CYRILLIC)).otherwise(0).alias("cyr"),
        F.when(mixed, letters(body, LATIN)).otherwise(0).alias("lat"),
        body.rlike("\\p{L}").alias("lettered"),
    )


def text_profile(text: Column) -> Column:
    """Profile of a text as it is.

    Counting once and deciding on the struct keeps each regular expression to one pass.
    """
    return stripped_profile(strip_ws(F.coalesce(text, F.lit(""))))


def mostly_cyrillic(profile: Column) -> Column:
    """Cyrillic leads clearly enough to decide without a detector."""
    cyr, lat = profile["cyr"], profile["lat"]
    return (cyr > lat * F.lit(CYRILLIC_LEAD)) & (cyr >= CYRILLIC_LEAST)


def needs_detector(profile: Column) -> Column:
    """Only these texts can be decided differently by a detector label."""
    return (
        (profile["n"] >= SHORT_TEXT) & ~mostly_cyrillic(profile) & profile["lettered"]
    )


def source_of(profile: Column, default: str = ENGLISH, detected: Column | None = None) -> Column:
    """Source code from a ``text_profile`` and, where given, a detector's label."""
    by_script = F.when(profile["cyr"] > profile["lat"], RUSSIAN)
    rule = (
        F.when(profile["n"] == 0, default)
        .when(mostly_cyrillic(profile), RUSSIAN)
        .when(profile["n"] < SHORT_TEXT, by_script.otherwise(ENGLISH))
        .when(~profile["lettered"], by_script.otherwise(default))
    )
    if detected is not None:
        rule = rule.when(detected == RUSSIAN_LABEL, RUSSIAN).when(
            detected.isin(*LATIN_LABELS), ENGLISH
        )
    return rule.otherwise(by_script.otherwise(ENGLISH))


def detect_source(text: Column, default: str = ENGLISH, detected: Column | None = None) -> Column:
    """Source code of one text."""
    return source_of(text_profile(text), default, detected)


def effective_source(text: Column, option: str | None = "auto") -> Column:
    """The pinned source, or the detected one when the option is empty or 'auto'."""
    pinned = pinned_source(option)
    return F.lit(pinned) if pinned else detect_source(text)


def is_supported(source: Column) -> Column:
    return F.coalesce(source.isin(*SUPPORTED_SOURCES), F.lit(False))


def winner(russian: Column, english: Column, default: str = ENGLISH) -> Column:
    """Russian needs a strict majority; else English if it has a vote; else the default."""
    return (
        F.when(russian > english, RUSSIAN).when(english > 0, ENGLISH).otherwise(F.lit(default))
    )


def head_units(text: Column, head: int = VOTE_HEAD, breaks: str = "\n") -> Column:
    """The first ``head`` paragraphs that are not blank, as they are."""
    return F.slice(F.filter(split_lines(text, breaks), lambda t: ~is_blank(t)), 1, head)


def winner_of(votes: Column, default: str = ENGLISH) -> Column:
    """The winner among an array of source codes: one fold, however often they are counted."""
    return F.aggregate(
        votes,
        F.struct(F.lit(0).alias("ru"), F.lit(0).alias("en")),
        lambda n, v: F.struct(
            (n["ru"] + (v == RUSSIAN).cast("int")).alias("ru"),
            (n["en"] + (v == ENGLISH).cast("int")).alias("en"),
        ),
        lambda n: winner(n["ru"], n["en"], default),
    )


def document_source_of(
    text: Column, head: int = VOTE_HEAD, default: str = ENGLISH, breaks: str = "\n"
) -> Column:
    """Vote of a document held as one text, taken inside the row: no shuffle.

    Same result as ``operators.voting.document_source`` over the exploded units.
    """
    kept = F.filter(F.transform(split_lines(text, breaks), strip_ws), lambda t: t != "")
    votes = F.transform(
        F.transform(F.slice(kept, 1, head), stripped_profile), lambda p: source_of(p, default)
    )
    return winner_of(votes, default)
