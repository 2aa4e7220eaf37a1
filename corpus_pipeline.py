"""A corpus from raw documents to token ids: five stages, each one operator of ``unitflow.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept; all but the last return
the columns of ``documents``. ``run`` writes each stage's result to the shared folder and reads it back, so a
lost executor never repeats more than one stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.llm.bpe import encode_decode
from unitflow.llm.line_dedup import dedup_lines
from unitflow.llm.mixing import mix
from unitflow.llm.quality_rules import judge
from unitflow.llm.simhash import keep_first
from unitflow.session import materialise

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Failing lines go, and documents that the rules reject."""
    kept = judge(docs).where("kept")
    return _sized(kept.withColumn("text", F.col("clean_text")))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that an earlier document has go."""
    return _sized(dedup_lines(docs))


def simhash(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return keep_first(docs).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are taken as often as their rate says, so that languages have equal shares of the tokens."""
    return mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), "lang").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and a digest of what they decode to.

    The JVM has grown in four stages when the encoders start beside it, so they take a quarter of their usual memory.
    """
    return encode_decode(docs, share=0.25).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", simhash),
    ("mixing sources to target weights", mixing),
    ("byte-level BPE encoding and decoding", tokens),
]

#: SQL has no XXH64, no fitted rates and no merges. The operators are tested one by one; for the whole, the
#: tests look only at which documents each stage keeps.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
