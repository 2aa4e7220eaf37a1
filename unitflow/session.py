"""Session defaults, materialised tables and other plumbing that Spark leaves to the caller."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)  # by the thread's ``scratch``
_held: dict[tuple[int, str], list] = {}  # (session, setting) -> [blocks that hold it, value before]
_holding = threading.Lock()


def get_session(app: str = "unitflow", master: str | None = None, **conf) -> SparkSession:
    """A session with the settings the operators are written for; ``conf`` wins over them."""
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # joins on whole texts: hashing beats sorting where every partition is seen to be small
        "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64m",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # whole files and long texts go to Python: bound batches by bytes, not by rows alone
        "spark.sql.execution.arrow.maxBytesPerBatch": "64m",
        "spark.python.worker.reuse": "true",
    }
    settings.update({k.replace("__", "."): str(v) for k, v in conf.items()})
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The shared folder for tables that cut lineage.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master, where driver and
    executors are one machine, may fall back to a temporary folder.
    """
    configured = spark.conf.get(CHECKPOINT_DIR, None)
    if configured:
        return configured
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError(f"set {CHECKPOINT_DIR} to a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="unitflow-")
    spark.conf.set(CHECKPOINT_DIR, folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/unitflow/{label}-{uuid.uuid4().hex}"


def materialise(
    df: DataFrame, label: str = "table", *partition_by: str, options: dict[str, str] | None = None
) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from the written table.

    The table survives lost executors, keeps model output from being computed twice, and gives
    Catalyst true sizes for its join choice. It is compressed hard, as it is written once and read a few
    times. Shuffle files of the write are not needed after it and are dropped at its end. ``discard``
    deletes the table when nothing reads it any more. ``options`` are the writer's.
    """
    spark = df.sparkSession
    path = fresh_path(spark, label)
    with setting(spark, DROP_SHUFFLES, "true"):
        df.write.partitionBy(*partition_by).options(**(options or {})).parquet(path, compression="zstd")
    out = spark.read.schema(df.schema).parquet(path)
    out.written_to = path
    made = _made.get()
    if made is not None:
        made.append(out)
    return out


@contextmanager
def scratch() -> Iterator[None]:
    """Tables that ``materialise`` writes inside the block, on this thread, are deleted at its end."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield
    finally:
        _made.reset(token)
        discard(*made)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` has written; other DataFrames are left alone."""
    for table in tables:
        path = getattr(table, "written_to", None)
        if path is not None:
            remove(table.sparkSession, path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``fresh_path`` has named."""
    if "/unitflow/" not in path:
        raise ValueError(f"{path} is no folder of this package")
    files, target = hadoop_path(spark, path)
    files.delete(target, True)


def exists(spark: SparkSession, path: str) -> bool:
    files, target = hadoop_path(spark, path)
    return files.exists(target)


def hadoop_path(spark: SparkSession, path: str):
    """(file system, path) of a folder or file that Spark can reach."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


@contextmanager
def setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A setting of the session for as long as the block runs.

    Blocks of several threads that hold the same value may overlap: the last one puts the old value back.
    """
    place = (id(spark), key)
    with _holding:
        held = _held.setdefault(place, [0, spark.conf.get(key, None)])
        held[0] += 1
        spark.conf.set(key, value)
    try:
        yield
    finally:
        with _holding:
            held[0] -= 1
            if not held[0]:
                del _held[place]
                if held[1] is None:
                    spark.conf.unset(key)
                else:
                    spark.conf.set(key, held[1])


def spread(df: DataFrame, *keys: str, even: int = 1) -> DataFrame:
    """Rebalance a scan that has fewer splits than the cluster has cores.

    A small file arrives as one split and would leave all other cores idle through the
    expensive text work above it. A large table has more splits than cores and stays as it is. Fewer splits than
    ``even`` for each core may still keep most cores idle: a row group lies in one split, however many its file is
    cut into. ``df`` is a plain scan; its rows go by a hash of ``keys``, which costs no sort.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    splits = df.rdd.getNumPartitions()
    if splits >= even * cores:
        return df
    return df.repartition(cores if splits < cores else even * cores, *keys)
