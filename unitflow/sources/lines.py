"""Line files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.functions.text import RARE_LINE_BREAKS, is_blank, strip_ws
from unitflow.operators.ordinals import blocked_sum_before


def raw_lines(raw: DataFrame) -> DataFrame:
    """Split rows of the text source at the line ends it does not know; drop blank lines."""
    return raw.select(
        "*", F.posexplode(F.split("value", RARE_LINE_BREAKS)).alias("_sub", "text")
    ).filter(~is_blank(F.col("text")))


def read_lines(
    spark: SparkSession, path: str | list[str], strip: bool = False, numbered: bool = True
) -> DataFrame:
    """(path, line_idx, text): one row per non-blank line of UTF-8 text files.

    Big files are read in splits. Lines are numbered per split, and the splits before are added,
    so one huge file is still numbered by many tasks. ``numbered=False`` skips the shuffle.
    """
    raw = spark.read.text(path)
    text = strip_ws(F.col("text")) if strip else F.col("text")
    if not numbered:
        return raw_lines(raw.select(F.col("_metadata.file_path").alias("path"), "value")).select(
            "path", text.alias("text")
        )
    placed = raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_block_start").alias("_start"),
        F.monotonically_increasing_id().alias("_id"),
        "value",
    )
    lines = raw_lines(placed).select("path", "_start", "_id", "_sub", text.alias("text"))
    return blocked_sum_before(
        lines, ["path"], ["_id", "_sub"], F.col("_start"), F.lit(1), "line_idx"
    ).select("path", "line_idx", "text")
