"""Counts, quality reports and expectation checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from unitflow.functions.text import is_blank, normalize_uz
from unitflow.operators.batching import plan_batches


def unit_counts(units: DataFrame) -> DataFrame:
    return units.groupBy("doc_id").agg(F.count("*").alias("n_units"))


def page_load(units: DataFrame) -> DataFrame:
    """Units and characters per page."""
    return units.groupBy("doc_id", "page").agg(
        F.count("*").alias("n_units"), F.sum(F.length("text")).cast("bigint").alias("n_chars")
    )


def quality_report(units: DataFrame) -> DataFrame:
    """Per source language: totals, translated, empty, unchanged, still to normalise, share."""
    done = ~is_blank(F.col("translated"))
    counts = units.groupBy("src_lang").agg(
        F.count("*").alias("total"),
        F.count_if(done).alias("translated"),
        F.count_if(~done).alias("empty"),
        F.count_if(F.col("translated") == F.col("text")).alias("unchanged"),
        F.count_if(normalize_uz(F.col("translated")) != F.col("translated")).alias("unnormalised"),
    )
    return counts.withColumn("share", F.try_divide("translated", "total"))


def non_empty() -> Column:
    return ~is_blank(F.col("translated"))


def contains_any(words: Sequence[str]) -> Column:
    """The translation, in lower case, contains one of the words."""
    lowered = F.lower(F.coalesce(F.col("translated"), F.lit("")))
    hit = F.lit(False)
    for word in words:
        hit = hit | F.contains(lowered, F.lit(word.lower()))
    return hit


def rule_totals(rules: Mapping[str, Column]) -> list[Column]:
    """The aggregates behind ``check``: ``n``, ``n_in``, ``n_out``, and ``r0``, ``r1`` ... for the rules."""
    return [
        F.count(F.lit(1)).alias("n"),
        F.count("text").alias("n_in"),
        F.count("translated").alias("n_out"),
        *[
            F.count_if(F.coalesce(rule, F.lit(False))).alias(f"r{i}")
            for i, rule in enumerate(rules.values())
        ],
    ]


def rule_report(totals: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, passed, failed) out of a row of ``rule_totals``."""
    rows = [
        F.struct(
            F.lit(name).alias("rule"),
            F.col(f"r{i}").alias("passed"),
            (F.col("n") - F.col(f"r{i}")).alias("failed"),
        )
        for i, name in enumerate(rules)
    ]
    rows.append(
        F.struct(
            F.lit("same_count").alias("rule"),
            F.least("n_in", "n_out").alias("passed"),
            F.abs(F.col("n_in") - F.col("n_out")).alias("failed"),
        )
    )
    return totals.select(F.inline(F.array(*rows)))


def check(units: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, passed, failed): boolean rules over units, all in one pass.

    ``same_count`` is always reported: units with a text against units with a result.
    """
    return rule_report(units.agg(*rule_totals(rules)), rules)


class ObservedChecks:
    """The checks of ``check``, counted while a job passes its units on: no second scan and no job of their own.

        checks = ObservedChecks(rules)
        checks.watch(units).write.parquet(...)   # any one action
        checks.report(spark)                     # (rule, passed, failed)

    On a stream, ``watch`` counts each micro-batch, and ``of_progress`` reads a batch's counts from its progress. Spark
    counts a task's rows when it has ended; a task that runs again for a lost shuffle file may be counted twice, so
    watch what is written rather than what is shuffled, and use ``check`` where a count decides something.
    """

    def __init__(self, rules: Mapping[str, Column], name: str = "checks"):
        self.rules, self.name = dict(rules), name
        self.observation = Observation(name)

    def watch(self, units: DataFrame) -> DataFrame:
        """The same rows; a batch DataFrame may be watched once."""
        target = self.name if units.isStreaming else self.observation
        return units.observe(target, *rule_totals(self.rules))

    def report(self, spark: SparkSession) -> DataFrame:
        """The counts of the one action that has run over the watched units."""
        return self._report(spark, self.observation.get)

    def of_progress(self, spark: SparkSession, progress: Mapping) -> DataFrame | None:
        """The counts of a micro-batch (``StreamingQuery.recentProgress``), None where it has none."""
        found = progress["observedMetrics"].get(self.name)
        return None if found is None else self._report(spark, found if isinstance(found, dict) else found.asDict())

    def _report(self, spark: SparkSession, counts: Mapping[str, int]) -> DataFrame:
        names = ["n", "n_in", "n_out", *[f"r{i}" for i in range(len(self.rules))]]
        row = spark.range(1).select(*[F.lit(int(counts[n])).cast("bigint").alias(n) for n in names])
        return rule_report(row, self.rules)


def batch_check(units: DataFrame, batch_size: int = 32) -> DataFrame:
    """(rule, passed, failed): batches in which every result has text."""
    whole = (
        plan_batches(units.select("doc_id", "src_lang", "unit_idx", "translated"), batch_size)
        .groupBy("doc_id", "src_lang", "batch_no")
        .agg(F.bool_and(non_empty()).alias("ok"))
    )
    return whole.agg(
        F.count_if("ok").alias("passed"), F.count_if(~F.col("ok")).alias("failed")
    ).select(F.lit("whole_batch").alias("rule"), "passed", "failed")
