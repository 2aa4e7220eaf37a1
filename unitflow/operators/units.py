"""From documents and page layouts to ordered text units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from unitflow.functions.text import is_blank, paragraph_text, split_lines
from unitflow.operators.ordinals import ordinal, running_sum
from unitflow.options import (
    DEFAULT_FONT_SIZE,
    KIND_PARAGRAPH,
    KIND_SPAN,
    PREVIEW_EXTRACT_CHARS,
    PREVIEW_RESULT_CHARS,
    PREVIEW_ROWS,
)


def explode_lines(docs: DataFrame, doc: str = "doc_id", text: str = "text", breaks: str = "\n"):
    """All paragraphs of each document, blank ones too: doc, para_idx, text."""
    others = [c for c in docs.columns if c not in (doc, text)]
    return docs.select(
        doc, *others, F.posexplode(split_lines(F.col(text), breaks)).alias("para_idx", "text")
    ).withColumn("para_idx", F.col("para_idx").cast("bigint"))


def explode_paragraphs(
    docs: DataFrame, doc: str = "doc_id", text: str = "text", breaks: str = "\n"
) -> DataFrame:
    """One unit per non-blank paragraph.

    ``para_idx`` counts all paragraphs, ``unit_idx`` the kept ones. Both are numbered inside the
    document's row, so nothing is shuffled or sorted. Other columns of ``docs`` are carried.
    """
    others = [c for c in docs.columns if c not in (doc, text)]
    numbered = F.transform(
        split_lines(F.col(text), breaks),
        lambda t, i: F.struct(i.cast("bigint").alias("para_idx"), t.alias("text")),
    )
    kept = F.filter(numbered, lambda p: ~is_blank(p["text"]))
    return docs.select(doc, *others, F.posexplode(kept).alias("unit_idx", "_p")).select(
        doc,
        F.col("unit_idx").cast("bigint").alias("unit_idx"),
        F.concat(F.lit("docx-"), F.col("_p.para_idx")).alias("uid"),
        F.lit(KIND_PARAGRAPH).alias("kind"),
        F.lit("body").alias("loc"),
        F.col("_p.para_idx").alias("para_idx"),
        F.col("_p.text").alias("text"),
        *others,
    )


def paragraph_units(paras: DataFrame) -> DataFrame:
    """Units of a paragraph table (doc_id, para_idx, loc, runs), blank paragraphs dropped."""
    texts = paras.select(
        "doc_id", "para_idx", "loc", paragraph_text(F.col("runs")).alias("text")
    ).filter(~is_blank(F.col("text")))
    return ordinal(texts, ["doc_id"], "para_idx", "unit_idx").select(
        "doc_id",
        "unit_idx",
        F.concat(F.lit("docx-"), F.col("para_idx")).alias("uid"),
        F.lit(KIND_PARAGRAPH).alias("kind"),
        "loc",
        "para_idx",
        "text",
    )


PAGE_BLOCK = 4096  # pages per block of a document's running span count


def explode_spans(layout: DataFrame, page_block: int = PAGE_BLOCK) -> DataFrame:
    """Span units of page layouts (doc_id, page, blocks): blank spans and non-text blocks dropped.

    Spans are filtered and numbered inside the page row. Across pages only a running count is
    needed, so one shuffle of page rows numbers all spans.
    """
    # a missing list holds nothing; flatten would lose the whole page over it
    text_blocks = F.filter("blocks", lambda b: (b["type"] == 0) & b["lines"].isNotNull())
    lines = F.flatten(F.transform(text_blocks, lambda b: b["lines"]))
    filled = F.filter(lines, lambda x: x["spans"].isNotNull())
    spans = F.flatten(F.transform(filled, lambda x: x["spans"]))
    kept = F.filter(F.coalesce(spans, F.array()), lambda s: ~is_blank(s["text"]))
    pages = layout.select("doc_id", "page", kept.alias("_spans"))
    placed = running_sum(pages, ["doc_id"], "page", F.size("_spans"), "_first", page_block)
    listed = placed.select("doc_id", "page", "_first", F.posexplode("_spans").alias("_i", "_s"))
    return listed.select(
        "doc_id",
        (F.col("_first") + F.col("_i")).alias("unit_idx"),
        F.concat(F.lit("pdf-"), F.col("_first") + F.col("_i")).alias("uid"),
        F.lit(KIND_SPAN).alias("kind"),
        "page",
        F.col("_s.bbox").alias("bbox"),
        F.coalesce(F.nullif(F.col("_s.size"), F.lit(0.0)), F.lit(DEFAULT_FONT_SIZE)).alias("size"),
        F.coalesce(F.col("_s.color"), F.lit(0)).alias("color"),
        F.col("_s.text").alias("text"),
    )


def head_n(df: DataFrame, n: int, group: str = "doc_id", order: str = "unit_idx") -> DataFrame:
    """The first ``n`` rows of each group.

    ``row_number() <= n`` lets Spark cut every group to ``n`` rows before the shuffle, so a group
    of any size costs at most ``n`` rows per task.
    """
    rank = F.row_number().over(W.partitionBy(group).orderBy(order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= n).drop("_rank")


def preview(df: DataFrame, n: int = PREVIEW_ROWS, width: int | None = None) -> DataFrame:
    """First rows of each document, cut to display width, with a 1-based row number.

    Shows text and translation where there is one, else the text alone. ``unit_idx`` has no gaps
    (``ordinals.renumber`` restores that), so the rows are a filter that reaches the scan.
    """
    both = "translated" in df.columns
    width = width or (PREVIEW_RESULT_CHARS if both else PREVIEW_EXTRACT_CHARS)
    shown = ["text", "translated"] if both else ["text"]
    return df.filter(F.col("unit_idx") < n).select(
        "doc_id",
        (F.col("unit_idx") + 1).alias("row_no"),
        *[F.substring(F.coalesce(F.col(c), F.lit("")), 1, width).alias(c) for c in shown],
    )
