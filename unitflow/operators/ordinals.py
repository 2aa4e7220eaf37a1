"""Numbering and running sums inside groups of any size.

A plain window over a document puts that document into one task. Where a group may be long, its
positions are cut into blocks: each block is summed on its own, and the blocks before are added.
A group with a third of all rows is then spread over as many tasks as it has blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BLOCK_ROWS = 65_536  # positions per block, and so the most rows of one window partition


def sum_before(
    df: DataFrame, group: Sequence[str], order: Sequence[str], weight: Column, out: str
) -> DataFrame:
    """Sum of ``weight`` over the rows before each row of its group: one plain window."""
    before = W.partitionBy(*group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(weight).over(before), F.lit(0)).cast("bigint"))


def blocked_sum_before(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    block: Column,
    weight: Column,
    out: str,
) -> DataFrame:
    """The same for groups of any size.

    ``block`` must not decrease along ``order``, and ``order`` must be unique in a group. Blocks
    are totalled in a second, narrow pass over the input with a map-side combine; the joined
    side only holds the later blocks of long groups.
    """
    blocked = df.withColumn("_block", block).withColumn("_weight", weight)
    totals = blocked.groupBy(*group, "_block").agg(F.sum("_weight").alias("_total"))
    offsets = (
        sum_before(totals, group, ["_block"], F.col("_total"), "_before")
        .filter(F.col("_before") > 0)
        .select(*group, "_block", "_before")
    )
    inside = sum_before(blocked, [*group, "_block"], order, F.col("_weight"), "_inside")
    return (
        inside.join(offsets, [*group, "_block"], "left")
        .withColumn(out, F.col("_inside") + F.coalesce(F.col("_before"), F.lit(0)))
        .drop("_block", "_weight", "_inside", "_before")
    )


def running_sum(
    df: DataFrame,
    group: Sequence[str],
    pos: str,
    weight: Column,
    out: str,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Sum of ``weight`` before each row, by an integer position that is unique in the group.

    Always by blocks: a group of one block has no row on the joined side. ``df`` is read twice, so
    a costly one (a translation) is to be written first.
    """
    block = F.expr(f"{pos} div {int(block_rows)}")
    return blocked_sum_before(df, group, [pos], block, weight, out)


def ordinal(
    df: DataFrame, group: Sequence[str], pos: str, out: str, block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """0-based rank of each row in its group by an integer position; see ``running_sum``."""
    return running_sum(df, group, pos, F.lit(1), out, block_rows)


def renumber(
    df: DataFrame,
    group: Sequence[str] = ("doc_id",),
    pos: str = "unit_idx",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Close the gaps that a filter left in ``pos``."""
    return ordinal(df, group, pos, "_dense", block_rows).withColumn(pos, F.col("_dense")).drop(
        "_dense"
    )
