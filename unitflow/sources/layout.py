"""Page layouts, extracted elsewhere, as a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from unitflow import schemas


def read_layout(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(doc_id, page, blocks) from Parquet, JSON lines or another Spark source; never inferred."""
    return spark.read.schema(schemas.LAYOUT).format(fmt).load(path)


def read_images(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """(doc_id, page, img_idx, xref, y0, width, height): what pages list as their images."""
    return spark.read.schema(schemas.IMAGES).format(fmt).load(path)
