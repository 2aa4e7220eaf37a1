"""Where and how large translated spans are drawn."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.functions.layout import (
    BOX_HEIGHT,
    SLACK,
    capacity,
    fit_font_size,
    unpack_rgb,
)
from unitflow.functions.text import final_text, strip_ws
from unitflow.options import DEFAULT_FONT_SIZE, KIND_SPAN, MIN_FONT_SIZE


def layout_plan(units: DataFrame, slack: float = SLACK) -> DataFrame:
    """One row per span to draw: box, text, font size, colour; column expressions only.

    ``shrunk``: the text did not fit at its own size. ``overflow``: it does not fit at the least
    size either.
    """
    size = F.coalesce(F.nullif(F.col("size"), F.lit(0.0)), F.lit(DEFAULT_FONT_SIZE))
    spans = units.filter(F.col("kind") == KIND_SPAN).select(
        "doc_id",
        F.col("page").cast("bigint").alias("page"),
        "unit_idx",
        F.col("bbox")[0].alias("x0"),
        F.col("bbox")[1].alias("y0"),
        F.col("bbox")[2].alias("x1"),
        F.greatest(F.col("bbox")[3], F.col("bbox")[1] + size * F.lit(BOX_HEIGHT)).alias("y1"),
        size.alias("size"),
        unpack_rgb(F.col("color")).alias("_rgb"),
        strip_ws(final_text(F.col("translated"), F.col("text"))).alias("text"),
    )
    width, height = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    fitted = spans.filter(F.col("text") != "").withColumn(
        "font_size", fit_font_size(width, height, F.col("text"), F.col("size"), slack)
    )
    start = F.greatest(F.lit(MIN_FONT_SIZE), F.col("size"))
    holds = capacity(width, height, F.lit(MIN_FONT_SIZE)) * F.lit(slack)
    return fitted.select(
        "doc_id",
        "page",
        "unit_idx",
        "x0",
        "y0",
        "x1",
        "y1",
        "size",
        "font_size",
        F.col("_rgb.r").alias("r"),
        F.col("_rgb.g").alias("g"),
        F.col("_rgb.b").alias("b"),
        (F.col("font_size") < start).alias("shrunk"),
        (F.length("text") > holds).alias("overflow"),
        "text",
    )


def overflow_report(plan: DataFrame) -> DataFrame:
    """Per page: spans, shrunk spans, spans at the least size, spans that overflow even there."""
    return plan.groupBy("doc_id", "page").agg(
        F.count("*").alias("n_spans"),
        F.count_if(F.col("shrunk")).alias("n_shrunk"),
        F.count_if(F.col("font_size") == MIN_FONT_SIZE).alias("n_least"),
        F.count_if(F.col("overflow")).alias("n_overflow"),
    )
