"""Connected components of a distributed edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.session import materialise


def _stars(edges: DataFrame, large: bool) -> DataFrame:
    """One step: every node hands its neighbours (all the larger ones, or all the smaller ones) its least.

    ``edges`` points from the larger node ``a`` to the smaller ``b``. The least neighbour is a combined
    aggregate and comes back by an equi-join, so a node with very many neighbours is never one group.
    """
    if large:
        both = edges.union(edges.select("b", "a")).toDF("u", "v")
    else:
        both = edges.toDF("u", "v")
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    met = both.join(least, "u")
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array("u", "v")).alias("a"), F.col("m").alias("b"))
    return out.where("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (two long columns); root is the least node that it reaches.

    Large-star and small-star steps alternate until nothing changes; each round is a written table, so a
    lost executor repeats tasks of one round. Rounds grow with the logarithm of a component's size.
    Self-loops and rows with a null are no edges.
    """
    a, b = (F.col(c) for c in edges.columns)
    rows = edges.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    rows = rows.where(a.isNotNull() & b.isNotNull() & (F.col("a") != F.col("b"))).distinct()
    mark = F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))
    rows, seen = materialise(rows, "edges"), None
    while True:
        now = tuple(rows.agg(F.count("*"), mark).first())
        if now == seen or now[0] == 0:
            break
        seen = now
        rows = materialise(_stars(_stars(rows, large=True), large=False), "stars")
    return rows.select(F.col("a").alias("node"), F.col("b").alias("root")).union(
        rows.select("b", "b").distinct()
    )
