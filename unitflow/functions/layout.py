"""Page-geometry expressions: colours, font fitting, location paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from unitflow.options import MIN_FONT_SIZE

# --- Fixed values ------------------------------------------------------------------------------
FONT_STEP = 0.5
CHAR_WIDTH = 0.5  # average character width in font sizes
LINE_HEIGHT = 1.2  # line height in font sizes
BOX_HEIGHT = 1.35  # least height of a text box in font sizes
SLACK = 1.2  # share of the estimated capacity a text may use
SLACK_STRICT = 1.15
# ------------------------------------------------------------------------------------------------


def unpack_rgb(color: Column) -> Column:
    """struct<r, g, b> in 0..1 from a packed integer; null is black."""
    packed = F.coalesce(color, F.lit(0))
    channel = lambda bits: F.shiftright(packed, bits).bitwiseAND(F.lit(255)) / F.lit(255.0)
    return F.struct(channel(16).alias("r"), channel(8).alias("g"), channel(0).alias("b"))


def capacity(width: Column, height: Column, size: Column) -> Column:
    """Characters that a box is taken to hold at a font size."""
    lines = F.greatest(F.lit(1), (height / (size * F.lit(LINE_HEIGHT))).cast("bigint"))
    per_box = (width * lines) / (size * F.lit(CHAR_WIDTH))
    return F.greatest(F.lit(1), per_box.cast("bigint"))


def fit_font_size(
    width: Column, height: Column, text: Column, size: Column, slack: float = SLACK
) -> Column:
    """Largest size, going down from ``size`` in half points, at which the text fits; least 4."""
    start = F.greatest(F.lit(MIN_FONT_SIZE), size)
    steps = F.sequence(F.lit(0), ((start - F.lit(MIN_FONT_SIZE)) / F.lit(FONT_STEP)).cast("int"))
    sizes = F.transform(steps, lambda k: start - k * F.lit(FONT_STEP))
    fitting = F.filter(
        sizes, lambda s: F.length(text) <= capacity(width, height, s) * F.lit(slack)
    )
    return F.coalesce(F.try_element_at(fitting, F.lit(1)), F.lit(MIN_FONT_SIZE))


def loc_path(region: Column, section: Column, table: Column, cells: Column, p: Column) -> Column:
    """Where a paragraph sits: ``body``, ``table0_r1c2p0``, ``header0``, ``footer1_t0_r0c0_n0_r0c0p0``.

    ``cells`` lists the cell of each nesting level from the outermost in, as
    struct<r, c, n>; ``n`` numbers the nested table that the next level lies in.
    """
    base = F.when(region.isin("header", "footer"), F.concat(region, section.cast("string")))
    prefix = (
        F.when(table.isNull(), base)
        .when(base.isNull(), F.concat(F.lit("table"), table.cast("string")))
        .otherwise(F.concat(base, F.lit("_t"), table.cast("string")))
    )
    steps = F.transform(
        cells,
        lambda x: F.concat(
            F.lit("r"),
            x["r"].cast("string"),
            F.lit("c"),
            x["c"].cast("string"),
            F.coalesce(F.concat(F.lit("_n"), x["n"].cast("string")), F.lit("")),
        ),
    )
    in_table = F.concat(
        prefix, F.lit("_"), F.array_join(steps, "_"), F.lit("p"), p.cast("string")
    )
    return F.when(table.isNotNull(), in_table).otherwise(F.coalesce(base, F.lit("body")))
