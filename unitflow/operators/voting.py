"""Source language of units, documents and line files; rejects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.functions.language import (
    document_source_of,
    effective_source,
    head_units,
    is_supported,
    needs_detector,
    source_of,
    text_profile,
    winner,
    winner_of,
)
from unitflow.functions.text import is_blank
from unitflow.operators.detector import Profile, detected_label, detected_labels
from unitflow.options import ENGLISH, FILE_HEAD, RUSSIAN, VOTE_HEAD, Options, pinned_source


def _with_rule(
    rows: DataFrame, text: str, out: str, default: str, detector: Profile | None
) -> DataFrame:
    """Add ``out``, the source code of ``text``; a detector sees only texts that it can decide."""
    rows = rows.withColumn("_profile", text_profile(F.col(text)))
    label = None
    if detector is not None:
        asked = F.when(needs_detector(F.col("_profile")), F.col(text))
        rows = rows.withColumn("_label", detected_label(asked, detector))
        label = F.col("_label")
    return rows.withColumn(out, source_of(F.col("_profile"), default, label)).drop("_profile", "_label")


def with_unit_source(
    units: DataFrame, option: str | None = "auto", detector: Profile | None = None
) -> DataFrame:
    """Add ``src_lang``: pinned, or detected for each unit on its own."""
    if pinned_source(option):
        return units.withColumn("src_lang", effective_source(F.col("text"), option))
    return _with_rule(units, "text", "src_lang", ENGLISH, detector)


def document_source(
    units: DataFrame,
    head: int = VOTE_HEAD,
    default: str = ENGLISH,
    detector: Profile | None = None,
) -> DataFrame:
    """(doc_id, src_lang, votes_ru, votes_en): vote of the first ``head`` units of each document.

    ``unit_idx`` is gapless by contract (``ordinals.renumber`` restores that), so the head is a
    filter: no sort, and only two counters per document are shuffled.
    """
    voters = units.filter((F.col("unit_idx") < head) & ~is_blank(F.col("text")))
    cast = _with_rule(voters.select("doc_id", "text"), "text", "_vote", default, detector)
    votes = cast.groupBy("doc_id").agg(
        F.count_if(F.col("_vote") == RUSSIAN).alias("votes_ru"),
        F.count_if(F.col("_vote") == ENGLISH).alias("votes_en"),
    )
    return votes.select(
        "doc_id",
        winner(F.col("votes_ru"), F.col("votes_en"), default).alias("src_lang"),
        "votes_ru",
        "votes_en",
    )


def with_document_source(docs: DataFrame, opts: Options, text: str = "text") -> DataFrame:
    """Add ``src_lang`` to documents held as one text each, inside the row.

    With a detector the head paragraphs go to Python as one array a document and come back as labels.
    """
    pinned = pinned_source(opts.source)
    if pinned:
        return docs.withColumn("src_lang", F.lit(pinned))
    if opts.profiles is None:
        return docs.withColumn("src_lang", document_source_of(F.col(text), opts.vote_head))
    told = F.transform(
        head_units(F.coalesce(F.col(text), F.lit("")), opts.vote_head),
        lambda t: F.struct(t.alias("text"), text_profile(t).alias("profile")),
    )
    asked = F.transform("_head", lambda h: F.when(needs_detector(h["profile"]), h["text"]))
    votes = F.zip_with(
        "_head", "_labels", lambda h, label: source_of(h["profile"], detected=label)
    )
    return (
        docs.withColumn("_head", told)
        .withColumn("_labels", detected_labels(asked, opts.profiles))
        .withColumn("src_lang", winner_of(votes))
        .drop("_head", "_labels")
    )


def file_source(
    lines: DataFrame,
    head: int = FILE_HEAD,
    file: str = "path",
    idx: str = "line_idx",
    detector: Profile | None = None,
) -> DataFrame:
    """One source code per line file, from its first ``head`` lines joined by a space.

    Lines are numbered without gaps, so the head is a filter.
    """
    joined = (
        lines.filter(F.col(idx) < head)
        .groupBy(file)
        .agg(F.array_sort(F.collect_list(F.struct(idx, "text"))).alias("_head"))
    )
    sample = F.array_join(F.transform(F.col("_head"), lambda x: x["text"]), " ")
    sampled = joined.select(file, sample.alias("_sample"))
    return _with_rule(sampled, "_sample", "src_lang", ENGLISH, detector).drop("_sample")


def split_supported(df: DataFrame, source: str = "src_lang", strict: bool = False):
    """(supported, rejected) by source code; ``strict`` fails the job on the first bad code."""
    ok = is_supported(F.col(source))
    if strict:
        message = F.concat(F.lit("unsupported source: "), F.coalesce(F.col(source), F.lit("null")))
        checked = F.when(ok, F.col(source)).otherwise(F.raise_error(message).cast("string"))
        return df.withColumn(source, checked), df.limit(0)
    return df.filter(ok), df.filter(~ok)


def empty_documents(docs: DataFrame, units: DataFrame) -> DataFrame:
    """Documents without any unit. Units are cut to distinct keys before they are shuffled."""
    return docs.join(units.select("doc_id").distinct(), "doc_id", "left_anti")


def language_groups(units: DataFrame) -> DataFrame:
    """(doc_id, src_lang, n_units, first_idx)."""
    return units.groupBy("doc_id", "src_lang").agg(
        F.count("*").alias("n_units"), F.min("unit_idx").alias("first_idx")
    )
