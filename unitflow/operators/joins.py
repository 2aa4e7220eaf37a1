"""Joins whose key may hold a large share of all rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 10_000  # a key is hot when it holds more than 1/HOT_SHARE of all rows ...
NULL_SALTS = 4096  # tasks that rows without a key are spread over
HOT_ROWS = 10_000  # ... and more rows than this, which no task minds


def join_copies(
    rows: DataFrame,
    table: DataFrame,
    keys: Sequence[str],
    hot_share: int = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
    how: str = "inner",
    counts: DataFrame | None = None,
) -> DataFrame:
    """Equi-join ``rows`` to ``table``, which is unique by ``keys`` and counts ``_copies``.

    ``counts``: a narrow table of ``keys`` and ``_copies`` that counts instead of ``table``.

    A key with more than 1/``hot_share`` of the rows is cut into that many salted keys. There
    are fewer than ``hot_share`` such keys, so the broadcast (hash, salts) pairs stay under
    16 bytes x ``hot_share`` whatever the data, and the salted copies of the table under
    2 x ``hot_share`` rows. The salt is a hash of the row: a rerun task sends it the same way.
    ``how``: 'inner', or 'left' for rows that may have null keys, which meet nothing and are spread.
    """
    counts = table if counts is None else counts
    total = counts.agg(F.sum("_copies")).first()[0]
    limit = max((total or 0) // hot_share, hot_rows)
    hot = (
        counts.filter(F.col("_copies") > limit)
        .groupBy(F.xxhash64(*keys).alias("_hash"))
        .agg(F.max(F.ceil(F.col("_copies") / limit)).cast("int").alias("_salts"))
    )

    def with_salts(df):
        hashed = df.withColumn("_hash", F.xxhash64(*keys))
        marked = hashed.join(F.broadcast(hot), "_hash", "left")
        return marked.withColumn("_salts", F.coalesce(F.col("_salts"), F.lit(1))).drop("_hash")

    salts = F.when(F.col(keys[0]).isNull(), NULL_SALTS) if how == "left" else F.lit(None)
    salts = F.coalesce(salts, F.when(F.col("_salts") > 1, F.col("_salts")))
    place = F.when(salts.isNotNull(), F.pmod(F.xxhash64(*rows.columns), salts)).otherwise(0)
    salted = with_salts(rows).withColumn("_salt", place.cast("int"))
    copies = with_salts(table).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1))
    )
    return salted.drop("_salts").join(
        copies.drop("_salts", "_copies"), [*keys, "_salt"], how
    ).drop("_salt")
