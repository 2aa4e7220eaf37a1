"""The whole job: documents in, translated documents out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.functions.text import WHITESPACE, final_text, is_blank, normalize_uz
from unitflow.operators.inference import Factory, own_in_table, translate_distinct, translate_units
from unitflow.operators.joins import join_copies
from unitflow.operators.placement import layout_plan
from unitflow.operators.units import explode_lines, explode_spans, paragraph_units
from unitflow.operators.voting import (
    document_source,
    file_source,
    with_document_source,
    with_unit_source,
)
from unitflow.operators.writeback import assemble_document, assemble_pages, write_back
from unitflow.options import Options, pinned_source
from unitflow.session import materialise


def translate_paragraphs(
    docs: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    batch: str | None = None,
) -> DataFrame:
    """(doc_id, para_idx, src_lang, text, translated): all paragraphs of documents.

    The source is voted inside the document's row. Blank paragraphs run along untranslated, so
    putting the document together again needs no join.
    """
    return translate_units(_sourced_lines(docs, opts), make_translator, opts, batch=batch)


def _sourced_lines(docs: DataFrame, opts: Options) -> DataFrame:
    if opts.mode == "vote":
        return explode_lines(with_document_source(docs, opts))
    return with_unit_source(explode_lines(docs), opts.source, opts.profiles)


def translate_corpus(
    spark: SparkSession,
    docs: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    batch: str | None = None,
) -> DataFrame:
    """(doc_id, part, n_pieces, text) of documents given as (doc_id, text).

    Documents without text give no row; ``document_outcomes`` lists them. ``batch`` names what a translation
    memory (``opts.memory``) learns from these documents.
    """
    given = docs.select("doc_id", "text").filter(~is_blank(F.col("text")))
    # Translations come normalised. Blank paragraphs keep their own text, so that the layout of
    # the document stays.
    if own_in_table(opts):
        lines = _sourced_lines(given, opts).withColumns(_ends(F.col("text")))
        done = translate_distinct(lines, make_translator, opts, own=True)
        own = F.concat("_lead", F.coalesce("_own", F.lit("")), "_trail")
    else:
        done = translate_paragraphs(given, make_translator, opts, batch)
        text = F.col("text")
        own = F.when(is_blank(text), text).otherwise(normalize_uz(text))
    placed = done.select(
        "doc_id",
        "para_idx",
        F.when(F.col("translated") != "", F.col("translated")).otherwise(own).alias("text"),
    )
    return assemble_document(placed, part_units=opts.part_units)


def _ends(text: Column) -> dict[str, Column]:
    """A paragraph's white space before and after its body, normalised; a blank one is all lead, as it is.

    With these, a paragraph goes to its translation without its text.
    """
    space = F.lit(WHITESPACE)
    before = F.length(text) - F.length(F.ltrim(text, space))
    lead = normalize_uz(F.substr(text, F.lit(1), before))
    trail = normalize_uz(F.substr(text, F.length(F.rtrim(text, space)) + 1))
    blank = is_blank(text)
    return {"_lead": F.when(blank, text).otherwise(lead), "_trail": F.when(blank, "").otherwise(trail)}


def counted_documents(rows: DataFrame, table: DataFrame) -> DataFrame:
    """A table of one row per document with ``_copies``, the number of its ``rows``; written."""
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("_copies"))
    return materialise(counts.join(table, "doc_id"), "documents")


def with_document_columns(rows: DataFrame, table: DataFrame) -> DataFrame:
    """Join a table of one row per document to rows of any kind.

    Each document's row count travels with its row of the table, so that a document with a large
    share of all rows is salted. Rows of documents that the table does not list are dropped.
    """
    return join_copies(rows, counted_documents(rows, table), ["doc_id"])


def voted_documents(units: DataFrame, opts: Options = Options(), table: DataFrame | None = None) -> DataFrame | None:
    """(doc_id, _copies, src_lang, ...) of each document by its vote, written; None where the job takes no vote."""
    if pinned_source(opts.source) or opts.mode == "per_unit":
        return None
    votes = document_source(units, opts.vote_head, detector=opts.profiles).select("doc_id", "src_lang")
    return counted_documents(units, votes if table is None else votes.join(table, "doc_id"))


def with_voted_source(
    units: DataFrame,
    opts: Options = Options(),
    table: DataFrame | None = None,
    voted: DataFrame | None = None,
) -> DataFrame:
    """Units with ``src_lang`` by the job's mode; a vote is joined back per document.

    ``table``: one row per document, whose columns come along in the same join. ``voted``: their ``voted_documents``,
    where the caller has them.
    """
    voted = voted_documents(units, opts, table) if voted is None else voted
    if voted is not None:
        return join_copies(units, voted, ["doc_id"])
    given = units if table is None else with_document_columns(units, table)
    return with_unit_source(given, opts.source, opts.profiles)


def document_outcomes(docs: DataFrame, done: DataFrame, opts: Options = Options()) -> DataFrame:
    """(doc_id, src_lang, n_parts, reject_reason): one row for each row of ``docs``, whatever became of it.

    ``done`` is the written result of ``translate_corpus``, ``docs`` what it was given. A document without text has no
    source, no parts and a reason; one whose id repeats has the parts of all its rows.
    """
    sourced = with_document_source(docs.select("doc_id", "text"), opts)
    blank = is_blank(F.col("text"))
    told = sourced.select(
        "doc_id",
        F.when(~blank, F.col("src_lang")).alias("src_lang"),
        F.when(blank, "no text").alias("reject_reason"),
    )
    parts = done.groupBy("doc_id").agg(F.count("*").alias("_parts"))
    n_parts = F.when(F.col("reject_reason").isNull(), F.coalesce("_parts", F.lit(0))).otherwise(0)
    joined = told.join(parts, "doc_id", "left")
    return joined.select("doc_id", "src_lang", n_parts.alias("n_parts"), "reject_reason")


def written_once(paras: DataFrame, label: str) -> DataFrame:
    """A table that is read more than once: as it is where ``materialise`` has made it, else written now."""
    return paras if hasattr(paras, "written_to") else materialise(paras, label)


def translate_paras(
    paras: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    batch: str | None = None,
    units: DataFrame | None = None,
    voted: DataFrame | None = None,
) -> DataFrame:
    """Paragraph table (doc_id, para_idx, loc, runs) with translated runs.

    Numbering and write-back both read the paragraphs, so a scan of DOCX files is written first and parsed once.
    ``units``: their written ``paragraph_units``, and ``voted`` the ``voted_documents`` of these, where the caller has
    them.
    """
    paras = written_once(paras, "paras")
    units = materialise(paragraph_units(paras), "units") if units is None else units
    units = with_voted_source(units, opts, voted=voted)
    if own_in_table(opts):
        # a paragraph goes to its translation without its text, and on to its runs without being written
        place = units.select("doc_id", "para_idx", "text", "src_lang").withColumns(_ends(F.col("text")))
        done = translate_distinct(place, make_translator, opts, own=True)
        own = F.concat("_lead", F.coalesce("_own", F.lit("")), "_trail")
        new = F.when(F.col("translated") != "", normalize_uz(F.col("translated"))).otherwise(own)
        return write_back(paras, done, new)
    done = materialise(translate_units(units, make_translator, opts, batch=batch), "units")
    return write_back(paras, done)


def translate_layout(
    layout: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    batch: str | None = None,
) -> DataFrame:
    """Page layouts to translated span units.

    Units and results are written once each: votes, copies and the way back all read the first,
    the plans behind read the second.
    """
    units = with_voted_source(materialise(explode_spans(layout), "units"), opts)
    return materialise(translate_units(units, make_translator, opts, batch=batch), "spans")


def layout_to_spans(
    layout: DataFrame, make_translator: Factory, opts: Options = Options()
) -> DataFrame:
    """Placement table of the translated spans of page layouts."""
    return layout_plan(translate_layout(layout, make_translator, opts))


def layout_to_pages(
    layout: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    images: DataFrame | None = None,
    batch: str | None = None,
) -> DataFrame:
    """Flowing text of the translated pages, every page of each document listed.

    Spans are cut to what a page shows before they are written, and written again with their final text alone.
    """
    pages = layout.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))
    place = ["doc_id", "unit_idx", "kind", "page", "bbox"]
    units = with_voted_source(materialise(explode_spans(layout).select(*place, "text"), "units"), opts)
    if own_in_table(opts):
        done = translate_distinct(units, make_translator, opts, own=True)
        final = F.coalesce(F.nullif("translated", F.lit("")), "_own", F.lit(""))
    else:
        done = translate_units(units, make_translator, opts, batch=batch)
        final = final_text(F.col("translated"), F.col("text"))
    none = F.lit(None).cast("string")
    shown = materialise(done.select(*place, none.alias("text"), final.alias("translated")), "spans")
    return assemble_pages(shown, images, pages)


def translate_lines(
    lines: DataFrame, make_translator: Factory, opts: Options = Options(), file: str = "path"
) -> DataFrame:
    """Line files: one source per file from its first lines unless pinned, then translated."""
    pinned = pinned_source(opts.source)
    if pinned:
        sourced = lines.withColumn("src_lang", F.lit(pinned))
    else:
        counts = lines.groupBy(file).agg(F.count("*").alias("_copies"))
        sources = counts.join(file_source(lines, file=file, detector=opts.profiles), file)
        sourced = join_copies(lines, materialise(sources, "file-sources"), [file])
    return translate_units(sourced, make_translator, opts)
