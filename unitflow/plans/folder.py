"""From a folder of files to a folder of results, going on where an earlier run stopped.

Files are taken in waves, a few at a time, as one wave's tables are too small to keep a cluster busy. What a wave makes is
written into a folder of its own, and then one commit records the outcome of each of its files with that folder's name.
A run that dies loses the waves that are under way: results without a commit are never read, and the next run takes the
files that have no record, those that have changed since, and no others.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor, as_completed

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.util import inheritable_thread_target

from unitflow.operators.inference import Factory, translate_units
from unitflow.operators.units import paragraph_units
from unitflow.operators.writeback import paginate
from unitflow.options import Options
from unitflow.plans.corpus import translate_paras, voted_documents, with_voted_source
from unitflow.session import discard, materialise, scratch, setting
from unitflow.sources.docx import parse_docx
from unitflow.sources.ledger import Ledger
from unitflow.sources.manifest import plan_manifest, route

WAVE_FILES = 10_000  # files of a wave, whose paths the driver holds
WAVES_AT_ONCE = 4
LISTING = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
OPEN_COST = "spark.sql.files.openCostInBytes"
LISTED_COST = 64 * 1024  # bytes that a file counts as where only its name is asked for

RECORD = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("modified", T.TimestampType()),
        T.StructField("length", T.LongType()),
        T.StructField("status", T.StringType()),  # translated or rejected
        T.StructField("reason", T.StringType()),
        T.StructField("writer", T.StringType()),
        T.StructField("out_path", T.StringType()),
        T.StructField("src_lang", T.StringType()),
        T.StructField("n_paras", T.LongType()),
        T.StructField("n_units", T.LongType()),
        T.StructField("result", T.StringType()),  # folder of the results, under the writer's name
    ]
)
STATE = ["path", "modified", "length"]  # a file that differs in one of these is another file


def records(spark: SparkSession, out: str) -> Ledger:
    return Ledger(spark, f"{out.rstrip('/')}/_records", RECORD)


def folder_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, modified, length) of all files below a folder; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    # splits count a file as megabytes: one for every few files, and a written file for each
    found = found.coalesce(_tasks(spark))
    return found.select("path", F.col("modificationTime").alias("modified"), "length")


def _tasks(spark: SparkSession) -> int:
    """Enough tasks to even out files of all sizes."""
    return 4 * spark.sparkContext.defaultParallelism


def translate_folder(
    spark: SparkSession,
    folder: str,
    out: str,
    make_translator: Factory,
    opts: Options = Options(),
    wave_files: int = WAVE_FILES,
) -> DataFrame:
    """Translate the DOCX files below ``folder`` into ``out``; gives the newest record of each file.

    With ``output_format`` docx (or auto) a file becomes its paragraphs with new runs, with pdf the lines of plain
    pages; ``folder_results`` reads them. Files of other kinds, damaged ones and those without text are recorded as
    rejected, with a reason.
    """
    book = records(spark, out)
    files = folder_files(spark, folder).withColumn("requested", F.lit(opts.output_format or "auto"))
    planned = route(plan_manifest(files))
    reason = F.coalesce("reject_reason", F.when(F.col("suffix") != ".docx", "no reader for its pages"))
    # written before they are joined: a join would move below the coalesce and take a task for every few files
    with setting(spark, OPEN_COST, str(LISTED_COST)):
        listed = materialise(planned.withColumn("reason", reason), "folder-listed")
    todo = listed.join(book.read().select(*STATE), STATE, "left_anti")
    waves = F.pmod(F.xxhash64("path"), F.lit(max(1, -(-todo.count() // wave_files))))
    # a folder for each wave, so that a wave reads its own files' rows alone
    planned = materialise(todo.withColumn("wave", waves).repartition("wave"), "folder-files", "wave")
    discard(listed)
    refused = planned.filter("reason is not null")
    if not refused.isEmpty():
        name = uuid.uuid4().hex
        book.commit(_staged(book, refused.withColumn("status", F.lit("rejected"))), name)
    taken = planned.filter("reason is null")
    writers: dict[int, set[str]] = {}
    for wave, writer in map(tuple, taken.select("wave", "writer").distinct().collect()):
        writers.setdefault(wave, set()).add(writer)

    def run(wave: int) -> tuple[str, str]:
        files = taken.filter(F.col("wave") == wave)
        return _run_wave(spark, files, writers[wave], out, book, make_translator, opts)

    with setting(spark, LISTING, str(_tasks(spark))):  # else a task for each path
        for staged, name in _at_once(spark, run, sorted(writers)):
            book.commit(staged, name)
    discard(planned)
    return newest(book.read())


def _at_once(spark: SparkSession, run: Callable, given: Iterable) -> Iterator:
    """Results of ``run``, a few at a time on threads of their own, as they come."""
    with ThreadPoolExecutor(WAVES_AT_ONCE) as pool:
        try:
            # each thread has its own copy of this one's local properties
            for done in as_completed([pool.submit(inheritable_thread_target(spark)(run), x) for x in given]):
                yield done.result()
        finally:
            pool.shutdown(wait=False, cancel_futures=True)


def _run_wave(
    spark: SparkSession,
    files: DataFrame,
    writers: set[str],
    out: str,
    book: Ledger,
    make_translator: Factory,
    opts: Options,
) -> tuple[str, str]:
    """Write what a wave makes; gives the folder of its staged records and the id to commit them under."""
    name = uuid.uuid4().hex
    with scratch():
        content = _contents(spark, files).coalesce(_tasks(spark)).select(F.col("path").alias("doc_id"), "content")
        parsed = materialise(parse_docx(content), "folder-paras")
        paras = parsed.filter("error is null").drop("error")
        paras.written_to = parsed.written_to
        units = materialise(paragraph_units(paras), "folder-units")
        voted = voted_documents(units, opts)
        for writer, rows in _results(paras, units, voted, writers, make_translator, opts, name):
            rows.write.parquet(f"{out.rstrip('/')}/{writer}/{name}")
        return _staged(book, _outcomes(files, parsed, units, voted, opts, name)), name


def _contents(spark: SparkSession, files: DataFrame) -> DataFrame:
    """``files`` read as binary files. Their paths, of a wave's bounded number, stay in the driver's JVM."""
    texts = spark.sparkContext._jvm.org.apache.spark.sql.Encoders.STRING()
    paths = getattr(files.select("path")._jdf, "as")(texts).collect()
    return DataFrame(spark._jsparkSession.read().format("binaryFile").load(paths), spark)


def _results(paras, units, voted, writers, make_translator, opts, batch):
    """(writer, table) for the writers that the wave's files ask for."""
    if "replace_paragraphs" in writers:
        yield "replace_paragraphs", translate_paras(paras, make_translator, opts, batch, units, voted)
    if "paginate_lines" in writers:
        sourced = with_voted_source(units, opts, voted=voted)
        done = materialise(translate_units(sourced, make_translator, opts, batch=batch), "folder-done")
        yield "paginate_lines", paginate(done)


def _outcomes(files, parsed, units, voted, opts, name) -> DataFrame:
    counted = parsed.groupBy("doc_id").agg(
        F.count_if(F.col("error").isNull()).alias("n_paras"), F.max("error").alias("error")
    )
    if voted is not None:
        votes = voted.select("doc_id", F.col("_copies").alias("n_units"), "src_lang")
    else:
        pinned = F.lit(opts.source) if opts.mode != "per_unit" else F.lit(None).cast("string")
        votes = units.groupBy("doc_id").agg(F.count("*").alias("n_units")).withColumn("src_lang", pinned)
    told = counted.join(votes, "doc_id", "left")
    reason = F.coalesce("error", F.when(F.col("n_units").isNull(), "no text"))
    joined = files.drop("reason").join(told.withColumnRenamed("doc_id", "path"), "path", "left")
    return joined.select(
        "*",
        F.when(reason.isNull(), "translated").otherwise("rejected").alias("status"),
        reason.alias("reason"),
        F.when(reason.isNull(), name).alias("result"),
    )


def _staged(book: Ledger, rows: DataFrame) -> str:
    """The folder of records that wait for their commit."""
    for field in RECORD:
        if field.name not in rows.columns:
            rows = rows.withColumn(field.name, F.lit(None).cast(field.dataType))
    return book.stage(rows)


def newest(rows: DataFrame) -> DataFrame:
    """The record of each file's latest state."""
    latest = rows.groupBy("path").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "path"]), "modified").alias("r"))
    return latest.select("path", "r.*")


def folder_results(spark: SparkSession, out: str, writer: str = "replace_paragraphs") -> DataFrame:
    """The results of one writer, of each file's newest record; ``doc_id`` is the file's path."""
    done = newest(records(spark, out).read()).filter((F.col("status") == "translated") & (F.col("writer") == writer))
    done = materialise(done.select(F.col("path").alias("doc_id"), "result"), "folder-newest")
    folders = [r.result for r in done.select("result").distinct().collect()]  # one a wave
    if not folders:
        raise FileNotFoundError(f"{out} has no results of {writer}")
    root = f"{out.rstrip('/')}/{writer}"
    rows = spark.read.parquet(*[f"{root}/{f}" for f in folders])
    made_in = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    return rows.withColumn("result", made_in).join(done, ["doc_id", "result"], "left_semi").drop("result")
