"""Translation memory: what one batch or run has translated, no later one translates again.

Texts are known by a digest of source and text. A batch's digests are counted and written, and its new texts are those
whose digest is not in the memory (an anti-join of one narrow column); only if there are any, texts are shuffled at all
on their way to the model. Results come back by the same digest.
What is learnt is committed batch by batch (``sources.ledger``): a batch that is run again finds its own texts known,
and rows of a batch that died before its commit are never read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitflow.operators.inference import (
    Factory,
    counted_keys,
    distinct_bodies,
    join_translations,
    keyed_bodies,
    result_columns,
    translate_bodies,
)
from unitflow.options import Options
from unitflow.session import discard, materialise
from unitflow.sources.ledger import COMPACT_AT, Ledger

SCHEMA = T.StructType(
    [
        T.StructField("_key", T.BinaryType()),
        T.StructField("translated", T.StringType()),
        T.StructField("n_segments", T.IntegerType()),
    ]
)


FEW = 4  # a batch with this times fewer texts than the memory takes its own out first


class TranslationMemory:
    """The committed translations of one target and one way of cutting texts.

    ``path`` is the folder of one translator: another model needs another folder.
    """

    def __init__(self, spark: SparkSession, path: str, opts: Options):
        cut = "" if opts.split_chars is None else f"-{opts.split_chars}"
        self.ledger = Ledger(spark, f"{path.rstrip('/')}/{opts.target}{cut}", SCHEMA)

    def known(self) -> DataFrame:
        """(_key, translated, n_segments): every text once."""
        return self.ledger.read()

    def unknown(self, keys: DataFrame) -> DataFrame:
        return keys.join(self.known().select("_key"), "_key", "left_anti")

    def told(self, keys: DataFrame) -> DataFrame:
        """What is known, without most of what is not in ``keys`` where those are much the fewer."""
        known = self.known()
        if keys.count() * FEW < known.count():
            known = known.join(keys.select("_key"), "_key", "left_semi")
        return known

    def learn(self, done: DataFrame, batch: str) -> None:
        """Commit translations of texts that are not known yet, each file in order of their key."""
        rows = done if "n_segments" in done.columns else done.withColumn("n_segments", F.lit(1))
        folder = self.ledger.stage(rows.sortWithinPartitions("_key"))
        ids = self.ledger.ids()
        self.ledger.commit(folder, batch if batch not in ids else f"{batch}.{uuid.uuid4().hex}")
        if len(self.ledger.commits()) >= COMPACT_AT:
            self.ledger.compact(self.known().repartitionByRange("_key").sortWithinPartitions("_key"))


def translate_remembered(
    units: DataFrame,
    make_translator: Factory,
    opts: Options,
    batch: str | None = None,
    profile=None,
) -> DataFrame:
    """``translate_units`` with the memory in ``opts.memory``: only texts that it does not hold reach the model.

    Texts that fail (``on_error='row'``) are not remembered, so a later run tries them again.
    """
    memory = TranslationMemory(units.sparkSession, opts.memory, opts)
    keys = materialise(counted_keys(units), "keys")
    new = materialise(memory.unknown(keys).select("_key"), "new-keys")
    columns = result_columns(opts)
    failed = None
    if not new.isEmpty():
        bodies = distinct_bodies(units)
        if new.count() < keys.count():
            bodies = bodies.join(new, "_key", "left_semi")
        done = translate_bodies(bodies, make_translator, opts, profile)
        good = done = done.select("_key", *columns)
        if "error" in columns:
            done = materialise(done, "new-translations")
            good = done.filter(F.col("error").isNull())
            failed = done.filter(F.col("error").isNotNull())
        memory.learn(good.drop("error"), batch or uuid.uuid4().hex)
    told = memory.told(keys).select("_key", *[c for c in columns if c != "error"])
    if "error" in columns:
        told = told.withColumn("error", F.lit(None).cast("string"))
        told = told if failed is None else told.unionByName(failed.select(*told.columns))
    discard(new)
    return join_translations(keyed_bodies(units), told, opts, counts=keys)
