"""Where results go."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.functions.text import side_by_side
from unitflow.session import discard, materialise

PLACES = ("out_format", "doc_id", "page", "part", "para_idx", "unit_idx")


def write_translated(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A writer's table by output format, ordered by document and by the place in it.

    Ranges rather than hashes of the document: a document of many parts, pages, paragraphs or
    spans is cut over several tasks and they still lie in order. Rows are written once before
    ranges are sampled, so a translation below runs once.
    """
    keys = [c for c in PLACES if c in df.columns]
    rows = materialise(df, "to-sink")
    ordered = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    writer = ordered.write.mode(mode)
    if "out_format" in df.columns:
        writer = writer.partitionBy("out_format")
    writer.parquet(path)
    discard(rows)


def side_by_side_lines(df: DataFrame, *order: str) -> DataFrame:
    """Add ``value``, the report line of each row; ``order`` ranges and sorts the rows."""
    lines = df.withColumn("value", side_by_side(F.col("text"), F.col("translated")))
    if order:
        lines = lines.repartitionByRange(*order).sortWithinPartitions(*order)
    return lines


def write_side_by_side(df: DataFrame, path: str, *order: str) -> None:
    """Report lines as text files; with ``order``, rows are written once before ranges are sampled."""
    rows = materialise(df, "to-sink") if order else df
    side_by_side_lines(rows, *order).select("value").write.text(path)
    discard(rows)
