"""Translations back to their place, and documents put together again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.functions.text import final_text, replace_runs, strip_ws
from unitflow.operators.joins import join_copies
from unitflow.operators.ordinals import blocked_sum_before, ordinal
from unitflow.options import KIND_SPAN, PAGE_HEADING
from unitflow.session import materialise

# --- Fixed values: simple pagination -----------------------------------------------------------
PAGE_TOP = 50
LINE_STEP = 16
PAGE_BOTTOM = 750
LINES_PER_PAGE = (PAGE_BOTTOM - PAGE_TOP) // LINE_STEP + 1  # 44
LINE_CHARS = 500
MIN_IMAGE_SIDE = 8
# ------------------------------------------------------------------------------------------------

PART_UNITS = 4096  # most pieces that one collected text is made of
BODY, IMAGE = 0, 1  # at the same height text comes before images


def write_back(paras: DataFrame, units: DataFrame, new: Column | None = None) -> DataFrame:
    """Paragraphs with translated runs; those without a translation stay as they are.

    Joined on the true paragraph number, which is unique on both sides: no hot key. ``new``: the final text of a unit,
    where it is not to be made from ``translated`` and ``text``.
    """
    new = final_text(F.col("translated"), F.col("text")) if new is None else new
    done = units.select("doc_id", "para_idx", new.alias("_new"))
    return (
        paras.join(done, ["doc_id", "para_idx"], "left")
        .withColumn(
            "runs",
            F.when(
                F.col("_new").isNotNull(), replace_runs(F.col("runs"), F.col("_new"))
            ).otherwise(F.col("runs")),
        )
        .drop("_new")
    )


def assemble_document(
    pieces: DataFrame,
    pos: str = "para_idx",
    text: str = "text",
    sep: str = "\n",
    part_units: int = PART_UNITS,
) -> DataFrame:
    """(doc_id, part, n_pieces, text): the document's pieces in order.

    A document of up to ``part_units`` positions is one text (part 0). A longer one continues in
    parts 1, 2, ...; joining the parts with ``sep`` gives the whole. So no task ever collects
    more than ``part_units`` pieces, and nothing is cut.
    """
    gathered = (
        pieces.withColumn("part", F.expr(f"{pos} div {int(part_units)}"))
        .groupBy("doc_id", "part")
        .agg(F.array_sort(F.collect_list(F.struct(pos, text))).alias("_pieces"))
    )
    return gathered.select(
        "doc_id",
        F.col("part").cast("bigint").alias("part"),
        F.size("_pieces").cast("bigint").alias("n_pieces"),
        F.array_join(
            F.transform("_pieces", lambda p: F.coalesce(p[text], F.lit(""))), sep
        ).alias("text"),
    )


def page_images(images: DataFrame, order: str = "img_idx") -> DataFrame:
    """Images of each page: no null or 0 xref, the first of each xref, then at least 8 x 8.

    ``order`` is the order in which the page lists its images. The first copy is a minimum, not a
    ranking, so repeats of one image are combined before the shuffle. Whether it is too small is
    asked of the first copy only, after the copies are combined.
    """
    rest = ["y0", "width", "height"]
    first = (
        images.filter(F.coalesce(F.col("xref"), F.lit(0)) != 0)
        .groupBy("doc_id", "page", "xref")
        .agg(F.min(F.struct(order, *rest)).alias("_first"))
        .select("doc_id", "page", "xref", *[F.col(f"_first.{c}").alias(c) for c in [order, *rest]])
    )
    big = (F.col("width") >= MIN_IMAGE_SIDE) & (F.col("height") >= MIN_IMAGE_SIDE)
    return first.filter(big)


def page_items(
    units: DataFrame, images: DataFrame | None = None, pages: DataFrame | None = None
) -> DataFrame:
    """All blocks of all pages: doc_id, page, y, rank, ord, payload.

    ``pages`` (doc_id, n_pages) puts every page on the list, empty ones too. A page's own row
    has no payload and sorts first. Units that are not spans belong to page 0 at height 0.
    """
    has = set(units.columns)
    span = F.col("kind") == KIND_SPAN
    page = F.when(span, F.col("page")).otherwise(0) if "page" in has else F.lit(0)
    top = (
        F.when(span, F.coalesce(F.try_element_at("bbox", F.lit(2)), F.lit(0.0))).otherwise(
            F.lit(0.0)
        )
        if "bbox" in has
        else F.lit(0.0)
    )
    payload = strip_ws(final_text(F.col("translated"), F.col("text")))
    texts = units.select(
        "doc_id",
        page.cast("bigint").alias("page"),
        top.alias("y"),
        F.lit(BODY).alias("rank"),
        F.col("unit_idx").cast("bigint").alias("ord"),
        payload.alias("payload"),
    )
    if pages is None:
        spine = texts.select("doc_id", "page").distinct()
    else:
        spine = pages.select(
            "doc_id",
            F.explode(F.expr("if(n_pages > 0, sequence(0L, n_pages - 1L), null)")).alias("page"),
        )
    items = texts.filter(F.col("payload") != "").unionByName(
        spine.select(
            "doc_id",
            "page",
            F.lit(float("-inf")).alias("y"),
            F.lit(BODY - 1).alias("rank"),
            F.lit(0).cast("bigint").alias("ord"),
            F.lit(None).cast("string").alias("payload"),
        )
    )
    if images is not None:
        items = items.unionByName(
            page_images(images).select(
                "doc_id",
                F.col("page").cast("bigint").alias("page"),
                F.col("y0").alias("y"),
                F.lit(IMAGE).alias("rank"),
                F.col("img_idx").cast("bigint").alias("ord"),
                F.concat(F.lit("[image "), F.col("xref"), F.lit("]")).alias("payload"),
            )
        )
    return items


def _ranked(items: DataFrame) -> DataFrame:
    """Add ``_at``, each item's place on its page.

    Items are cut into ranges of their whole order; a page's ranges are counted and each range is
    ranked on its own, so no task ever holds a page. ``items`` is written already, as sampling ranges reads it
    once more; the ranges are written too, as they are read twice.
    """
    order = ["y", "rank", "ord"]
    ranges = items.repartitionByRange("doc_id", "page", *order)
    cut = materialise(ranges.withColumn("_range", F.spark_partition_id()), "page-ranges")
    return blocked_sum_before(cut, ["doc_id", "page"], order, F.col("_range"), F.lit(1), "_at")


def _with_part(items: DataFrame, part_items: int) -> DataFrame:
    """Add ``part``. Only pages of more than ``part_items`` items need the places of their items for it."""
    counts = items.groupBy("doc_id", "page").agg(F.count("*").alias("_n"))
    long = materialise(counts.filter(F.col("_n") > part_items).drop("_n"), "long-pages")
    if long.isEmpty():
        return items.withColumn("part", F.lit(0).cast("bigint"))
    of_page = items["doc_id"].eqNullSafe(long["doc_id"]) & items["page"].eqNullSafe(long["page"])
    ranked = _ranked(items.join(long, of_page, "left_semi"))
    placed = ranked.withColumn("part", F.expr(f"_at div {int(part_items)}")).drop("_at", "_range")
    rest = items.join(long, of_page, "left_anti").withColumn("part", F.lit(0).cast("bigint"))
    return placed.unionByName(rest)


def assemble_pages(
    units: DataFrame,
    images: DataFrame | None = None,
    pages: DataFrame | None = None,
    part_items: int = PART_UNITS,
) -> DataFrame:
    """(doc_id, page, part, break_before, n_items, text): pages as flowing text with headings.

    Blocks are ordered by height, at the same height text before images, then in their own
    order. Pages of more than ``part_items`` blocks continue in parts 1, 2, ...
    """
    items = page_items(units, images, pages)
    # items are read twice and more: from a written table they are cheap to make
    if not hasattr(units, "written_to"):
        items = materialise(items, "page-items")
    items = _with_part(items, part_items)
    gathered = items.groupBy("doc_id", "page", "part").agg(
        F.array_sort(F.collect_list(F.struct("y", "rank", "ord", "payload"))).alias("_items")
    )
    body = F.filter(
        F.transform("_items", lambda x: x["payload"]), lambda p: p.isNotNull()
    )
    if pages is None:
        placed = items.select("doc_id", "page", "part").distinct()
        first = placed.groupBy("doc_id").agg(
            F.min("page").alias("_first"), F.count("*").alias("_copies")
        )
        gathered = join_copies(gathered, first, ["doc_id"])
    else:
        gathered = gathered.withColumn("_first", F.lit(0))
    heading = F.concat(F.lit(PAGE_HEADING), F.col("page") + 1)
    return gathered.select(
        "doc_id",
        "page",
        "part",
        ((F.col("page") > F.col("_first")) & (F.col("part") == 0)).alias("break_before"),
        F.size(body).cast("bigint").alias("n_items"),
        F.concat_ws("\n", F.when(F.col("part") == 0, heading), body).alias("text"),
    )


def paginate(units: DataFrame, line_chars: int = LINE_CHARS) -> DataFrame:
    """Line positions of a plain rebuilt document: 44 lines a page, 500 drawn characters a line.

    Blank results take no line. ``rest`` holds what a line does not draw (``line`` and ``rest``
    together are the text) and ``cut_chars`` its length. Texts are written before they are
    numbered, so a translation below runs once.
    """
    text = strip_ws(final_text(F.col("translated"), F.col("text")))
    kept = units.select("doc_id", "unit_idx", text.alias("_text")).filter(F.col("_text") != "")
    line = ordinal(materialise(kept, "page-lines"), ["doc_id"], "unit_idx", "_line")
    return line.select(
        "doc_id",
        "unit_idx",
        F.expr(f"_line div {LINES_PER_PAGE}").alias("page_no"),
        (F.lit(PAGE_TOP) + LINE_STEP * (F.col("_line") % LINES_PER_PAGE)).alias("y"),
        F.substring("_text", 1, line_chars).alias("line"),
        F.substr("_text", F.lit(line_chars + 1)).alias("rest"),
        F.greatest(F.length("_text") - line_chars, F.lit(0)).cast("bigint").alias("cut_chars"),
    )
