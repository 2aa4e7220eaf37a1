"""Registered queries of the operators: thin forms that give the columns agreed on."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.llm.ann import nearest
from unitflow.llm import lexicon_bpe
from unitflow.llm.bpe import encode_decode
from unitflow.llm.common import documents
from unitflow.llm.line_dedup import dedup_lines
from unitflow.llm.mixing import mixing_rates
from unitflow.llm.pii import counts_of, find_personal_data, spans_text
from unitflow.llm.prefix_trie import prefix_trie, sequences, spliced
from unitflow.llm.quality_model import classify
from unitflow.llm.quality_rules import judge
from unitflow.llm.role_repair import damaged, repair
from unitflow.llm.simhash import near_groups
from unitflow.llm.suffix_dedup import remove_repeats
from unitflow.llm.token_files import read_tokens, write_tokens


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))
    base, terms = F.col("base"), F.col("terms")
    return found.select(
        "doc_id",
        *[n.alias(name) for name, n in counts_of(base).items()],
        F.sha2(spans_text(base), 256).alias("base_sha256"),
        spans_text(F.concat(base, terms)).alias("spans"),
    )


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(documents(spark, sf_dir).select("doc_id", "text"))
    return left.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256")
    )


def op3_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(documents(spark, sf_dir).select("doc_id", "text")).select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
    )


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(encode_decode(documents(spark, sf_dir).select("doc_id", "text")))


def digests(coded: DataFrame) -> DataFrame:
    """The query form of ``encode_decode``."""
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    return mixing_rates(docs, labelled).select(
        "doc_id",
        "n_tokens",
        F.array_join(F.transform("p", lambda x: F.round(x, 6).cast("string")), " ").alias(
            "membership"
        ),
        F.round("rate", 6).alias("rate"),
    )


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = near_groups(documents(spark, sf_dir).select("doc_id", "text"))
    return groups.select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    return nearest(vectors, vectors.where(F.col("vec_id") % 50 == 0))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_tokens(documents(spark, sf_dir).select("doc_id", "text"))
    return read_tokens(manifest).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32")
    )


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(documents(spark, sf_dir).select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spliced(sequences(spark.read.parquet(f"{sf_dir}/conversations.parquet"))))


def op12_role_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return repair(rows).drop("symbols")


def op13_lexicon_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = lexicon_bpe.encode_decode(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_pii,
        op2_suffix_dedup,
        op3_quality_model,
        op4_quality_rules,
        op5_bpe,
        op6_mixing,
        op7_simhash,
        op8_ann,
        op9_token_files,
        op10_line_dedup,
        op11_prefix_trie,
        op12_role_repair,
        op13_lexicon_bpe,
    )
} | {"pipeline": corpus_pipeline.run}
