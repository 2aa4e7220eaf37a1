"""Batches per document and source language, and their progress."""

from __future__ import annotations

from dataclasses import replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from unitflow.functions.text import strip_ws
from unitflow.operators.calls import cut_batches, estimated_tokens
from unitflow.operators.ordinals import BLOCK_ROWS, ordinal
from unitflow.operators.voting import language_groups, with_unit_source
from unitflow.options import PROGRESS_LABEL, Options


def plan_batches(units: DataFrame, batch_size: int = 32, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add ``batch_no`` and ``pos``: consecutive batches within (document, source language)."""
    ranked = ordinal(units, ["doc_id", "src_lang"], "unit_idx", "_ord", block_rows)
    return (
        ranked.withColumn("batch_no", F.expr(f"_ord div {int(batch_size)}"))
        .withColumn("pos", F.col("_ord") % F.lit(batch_size))
        .drop("_ord")
    )


CHUNK = 1024  # batches listed from one row


def progress(units: DataFrame, batch_size: int = 32) -> DataFrame:
    """One row per finished batch: doc_id, step, src_lang, batch_no, done, total, message.

    Languages come in the order in which they first appear. How much is done after a batch
    follows from the group sizes, so units are only counted, never sorted. Groups are listed
    chunk by chunk, so that a document with very many batches is listed by many tasks.
    """
    by_first = W.partitionBy("doc_id").orderBy("first_idx", "src_lang")
    groups = (
        language_groups(units)
        .withColumn("_batches", F.expr(f"(n_units + {batch_size - 1}) div {int(batch_size)}"))
        .withColumn("_earlier", F.sum("n_units").over(by_first.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("_steps", F.sum("_batches").over(by_first.rowsBetween(W.unboundedPreceding, -1)))
        .withColumn("total", F.sum("n_units").over(W.partitionBy("doc_id")))
    )
    chunks = groups.withColumn(
        "_chunk", F.explode(F.expr(f"sequence(0L, (_batches - 1) div {CHUNK})"))
    )
    listed = chunks.repartition("doc_id", "src_lang", "_chunk").withColumn(
        "batch_no",
        F.explode(
            F.expr(f"sequence(_chunk * {CHUNK}, least(_batches, (_chunk + 1) * {CHUNK}) - 1)")
        ),
    )
    done = F.coalesce(F.col("_earlier"), F.lit(0)) + F.least(
        (F.col("batch_no") + 1) * batch_size, F.col("n_units")
    )
    return listed.select(
        "doc_id",
        (F.coalesce(F.col("_steps"), F.lit(0)) + F.col("batch_no") + 1).alias("step"),
        "src_lang",
        "batch_no",
        done.alias("done"),
        "total",
        F.concat(F.lit(PROGRESS_LABEL), done, F.lit("/"), F.col("total")).alias("message"),
    )


def padding_report(units: DataFrame, opts: Options) -> DataFrame:
    """(plan, n_batches, tokens, padded, share): what batches in order and by length would pad, without a model.

    Batches are cut where the model would cut them, inside each Arrow batch of each source; blank units take
    no part. ``share`` is the padded part of all tokens that the model would read.
    """
    plans = {"in order": replace(opts, batch_tokens=None)}
    if opts.batch_tokens is not None:
        plans["by length"] = opts

    def run(batches):
        for batch in batches:
            found = {}
            for source, text in zip(batch.column("src_lang").to_pylist(), batch.column("text").to_pylist()):
                found.setdefault(source, []).append(text)
            rows = []
            for plan, options in plans.items():
                for texts in found.values():
                    sizes = [estimated_tokens(t) for t in texts]
                    for part in cut_batches(texts, options):
                        own = [sizes[i] for i in part]
                        rows.append((plan, 1, sum(own), max(own) * len(own) - sum(own)))
            if rows:
                columns = zip(*rows, strict=True)
                names = ["plan", "n_batches", "tokens", "padded"]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    sourced = units if "src_lang" in units.columns else with_unit_source(units, opts.source, opts.profiles)
    body = strip_ws(F.coalesce(F.col("text"), F.lit("")))
    given = sourced.select("src_lang", body.alias("text")).filter(F.col("text") != "")
    counted = given.mapInArrow(run, "plan string, n_batches bigint, tokens bigint, padded bigint")
    sums = counted.groupBy("plan").agg(*[F.sum(c).alias(c) for c in ("n_batches", "tokens", "padded")])
    return sums.withColumn("share", F.col("padded") / (F.col("padded") + F.col("tokens")))
