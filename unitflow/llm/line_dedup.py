"""Line dedup over levelled sorted runs of line hashes.

An index is a family of runs: Parquet tables of (h1, h2, owner, last), one row for each line key, sorted
by hash. A batch of documents anti-joins the runs, adds what is new as a run of level 0, and
``fanout`` runs of a level are merged into one of the next. Batches come in ascending ``doc_id``, so the
owner that a run holds for a key is the smallest document that has it.

Hot lines: keys are counted with a map-side combine, and the joins are plain equi-joins of two shuffled
sides, which adaptive execution splits where a key is hot. What a document loses is gathered by document,
so a group is never larger than the lines of one text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import SPACE, ascii_lower, id_of, let, text_of
from unitflow.llm.runs import LevelledRuns, ascending
from unitflow.session import materialise

MIN_KEY = 10
BATCHES = 4
FANOUT = 3


def line_key(line: Column) -> Column:
    """The line without white space at its ends, A-Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(SPACE)))


def _lines(docs: DataFrame, min_key: int) -> DataFrame:
    """(id, text hash, position, h1, h2) of each line whose key is long enough."""
    text = text_of()
    key = line_key(F.col("line"))
    return (
        docs.select(
            id_of().alias("id"),
            F.xxhash64(text).alias("version"),
            F.posexplode(F.split(text, "\n")).alias("pos", "line"),
        )
        .select("id", "version", "pos", key.alias("key"))
        .where(F.length("key") >= min_key)
        .select(
            "id",
            "version",
            "pos",
            F.xxhash64("key").alias("h1"),
            F.xxhash64(F.lit(1), "key").alias("h2"),
        )
    )


def add_batch(runs: LevelledRuns, docs: DataFrame, min_key: int = MIN_KEY) -> DataFrame:
    """Add a batch to the runs; gives the lines that it loses: (id, version, pos).

    The batch's ids must be above those of earlier batches. Its lines are written once, in a narrow
    table, and read for the keys and for the answer.
    """
    lines = materialise(_lines(docs, min_key), "lines")
    keys = lines.groupBy("h1", "h2").agg(F.min("id").alias("owner"), F.max("id").alias("last"))
    older = runs.tables()
    own = runs.add(keys).where("owner < last")
    lost = [
        lines.join(run.select("h1", "h2", "owner"), ["h1", "h2"])
        .where("owner < id")
        .select("id", "version", "pos")
        for run in (*older, own)
    ]
    out = lost[0]
    for more in lost[1:]:
        out = out.union(more)
    out = materialise(out, "lost-lines")
    runs.compact()
    return out


def dedup_lines(
    docs: DataFrame,
    min_key: int = MIN_KEY,
    batches: int = BATCHES,
    fanout: int = FANOUT,
) -> DataFrame:
    """All columns of ``docs`` with the lines of other documents taken out of ``text``.

    Lines are what stands between \\n; a line's key is the line without white space at its ends, A-Z in
    lower case. A key of ``min_key`` code points or more loses its lines in all documents but the
    smallest ``doc_id`` that has it; there it keeps all of them. Shorter keys always stay. Ids are a
    null's and repeats' as in ``common``; a null or empty text is one empty line and becomes ''; an empty
    table gives none. Adds (or replaces) ``n_lines`` and ``n_dropped`` (long).
    """
    spark = docs.sparkSession
    runs = LevelledRuns(spark, ["h1", "h2"], fanout)
    keyed = docs.select("doc_id", "text")
    lost = None
    for batch in ascending(keyed, batches):
        part = add_batch(runs, batch, min_key)
        lost = part if lost is None else lost.union(part)
    lost = lost.groupBy(F.col("id").alias("__id"), F.col("version").alias("__version")).agg(
        F.collect_set("pos").alias("__lost")
    )
    lines = F.split(text_of(), "\n")
    gone = F.coalesce(F.col("__lost"), F.array().cast("array<int>"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), F.col("__gone"))
    return (
        docs.withColumns({"__id": id_of(), "__version": F.xxhash64(text_of())})
        .join(lost, ["__id", "__version"], "left")
        .withColumns({"__lines": lines, "__gone": gone})
        .withColumns(
            {
                "n_lines": F.size("__lines").cast("long"),
                "n_dropped": F.size("__gone").cast("long"),
                "text": F.when(F.size("__gone") == 0, text_of()).otherwise(
                    _pick(F.col("__lines"), kept)
                ),
            }
        )
        .drop("__id", "__version", "__lines", "__gone", "__lost")
    )


def _pick(lines: Column, at: Column) -> Column:
    return let(
        F.struct(lines.alias("lines"), at.alias("at")),
        lambda v: F.array_join(F.transform(v["at"], lambda i: F.get(v["lines"], i)), "\n"),
    )
