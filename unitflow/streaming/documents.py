"""A stream of whole documents: each micro-batch runs the batch job.

Vote, write-back and assembly concern one document, and a document is always whole inside a
micro-batch, so there is no state across batches. A batch writes its own folder and overwrites it
when it is run again after a failure.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unitflow.operators.inference import Factory
from unitflow.options import Options
from unitflow.plans.corpus import translate_corpus, translate_paras
from unitflow.session import materialise
from unitflow.sources.docx import parse_docx

DOCX_FILES = "path string, modificationTime timestamp, length bigint, content binary"


def _each_batch(
    stream: DataFrame,
    job: Callable[[DataFrame, str], DataFrame],
    out: str,
    checkpoint: str,
    once: bool,
) -> StreamingQuery:
    def run(batch: DataFrame, batch_id: int) -> None:
        job(batch, f"{checkpoint}#{batch_id}").write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def watch_documents(
    documents: DataFrame,
    make_translator: Factory,
    out: str,
    checkpoint: str,
    opts: Options = Options(),
    once: bool = True,
) -> StreamingQuery:
    """Translate a stream of (doc_id, text) documents into ``out``."""

    def job(batch, name):
        return translate_corpus(batch.sparkSession, batch, make_translator, opts, name)

    return _each_batch(documents, job, out, checkpoint, once)


def watch_docx(
    spark: SparkSession,
    folder: str,
    make_translator: Factory,
    out: str,
    checkpoint: str,
    opts: Options = Options(),
    once: bool = True,
) -> StreamingQuery:
    """Translate the DOCX files that arrive in a folder into paragraph tables under ``out``.

    A file that cannot be read gives one row with its ``error``.
    """
    files = (
        spark.readStream.format("binaryFile")
        .schema(DOCX_FILES)
        .option("pathGlobFilter", "*.[dD][oO][cC][xX]")
        .load(folder)
        .select("path", "content")
    )

    def job(batch, name):
        paras = materialise(parse_docx(batch.withColumnRenamed("path", "doc_id")), "paras")
        bad = paras.filter(F.col("error").isNotNull())
        good = paras.filter(F.col("error").isNull()).drop("error")
        return translate_paras(good, make_translator, opts, name).unionByName(
            bad, allowMissingColumns=True
        )

    return _each_batch(files, job, out, checkpoint, once)
