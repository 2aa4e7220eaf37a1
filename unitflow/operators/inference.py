"""Batch translation: the one hot path that runs Python.

A translator is a plug-in. ``make_translator(options)`` loads it and returns a function
``fn(texts, source, target) -> texts`` of equal length. It must be deterministic: Spark may
run a lost task again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import replace

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitflow.functions.language import is_supported
from unitflow.functions.text import normalize_uz, strip_ws
from unitflow.operators.calls import Translator, translate_batch, translate_long
from unitflow.operators.joins import HOT_ROWS, HOT_SHARE, join_copies
from unitflow.operators.voting import with_unit_source
from unitflow.options import ENGLISH, Options
from unitflow.session import materialise

Factory = Callable[[Options], Translator]

#: What the model gives where a text may fail or be cut; otherwise it gives the translation alone.
RESULT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("error", T.StringType()),
        T.StructField("n_segments", T.IntegerType()),
    ]
)

_loaded: dict[str, Translator] = {}  # per Python worker: a model is loaded once, not per task


def stub_translator(options: Options) -> Translator:
    """Marks each text with its language pair; stands in for a model in tests and benches."""

    def fn(texts, source, target):
        return [f"[{source}>{target}] {t}" for t in texts]

    return fn


def _load(key: str, pickled: bytes, options: Options) -> Translator:
    if key not in _loaded:
        _loaded[key] = cloudpickle.loads(pickled)(options)
    return _loaded[key]


def _detailed(options: Options) -> bool:
    return options.on_error == "row" or options.split_chars is not None


def _model(make_translator: Factory, options: Options):
    """(result type, a function from Arrow texts and sources to Arrow results) that tasks can run."""
    options = replace(options, profiles=None)  # a detector is no business of the model's workers
    pickled = cloudpickle.dumps(make_translator)
    key = hashlib.sha1(pickled + repr(options).encode()).hexdigest()

    def plain(texts: pa.Array, sources: pa.Array) -> pa.Array:
        fn = _load(key, pickled, options)
        return pa.array(translate_batch(texts.to_pylist(), sources.to_pylist(), fn, options), pa.string())

    def detailed(texts: pa.Array, sources: pa.Array) -> pa.Array:
        fn = _load(key, pickled, options)
        done = translate_long(texts.to_pylist(), sources.to_pylist(), fn, options)
        columns = zip(*done, strict=True) if done else ((), (), ())
        arrays = [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32()), strict=True)]
        return pa.StructArray.from_arrays(arrays, [f.name for f in RESULT])

    return (RESULT, detailed) if _detailed(options) else (T.StringType(), plain)


def translator_udf(make_translator: Factory, options: Options):
    """The plug-in as a column function of (stripped text, source).

    Only these two columns go to Python; all others stay in the JVM beside it. It is marked
    nondeterministic so that no rule evaluates it twice or moves a filter through it.
    """
    kind, model = _model(make_translator, options)

    @F.arrow_udf(kind)
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, sources in batches:
            yield model(texts, sources)

    return run.asNondeterministic()


def _checked(units: DataFrame) -> DataFrame:
    """Fail on unsupported source codes.

    The result cannot be null. A join on it would otherwise push a null test of the whole
    detection down to the scan.
    """
    bad = F.concat(F.lit("unsupported source: "), F.coalesce(F.col("src_lang"), F.lit("null")))
    checked = F.when(is_supported(F.col("src_lang")), F.col("src_lang")).otherwise(
        F.raise_error(bad).cast("string")
    )
    return units.withColumn("src_lang", F.coalesce(checked, F.lit("")))


def with_body(units: DataFrame) -> DataFrame:
    """Checked units with ``_body``, the stripped text that the model sees."""
    return _checked(units).withColumn("_body", strip_ws(F.coalesce(F.col("text"), F.lit(""))))


def result_columns(opts: Options) -> list[str]:
    """What a translation adds to its unit, apart from ``over_limit``."""
    more = ["error"] if opts.on_error == "row" else []
    return ["translated", *more, *(["n_segments"] if opts.split_chars is not None else [])]


def _finished(raw: DataFrame, opts: Options) -> DataFrame:
    """Results out of ``_raw``, the translation normalised in the JVM."""
    told = F.col("_raw")["text"] if _detailed(opts) else F.col("_raw")
    done = raw.withColumn("translated", normalize_uz(told))
    for name in result_columns(opts)[1:]:
        done = done.withColumn(name, F.col("_raw")[name])
    return done.drop("_raw")


def with_limit(done: DataFrame, opts: Options) -> DataFrame:
    """Flag units beyond ``max_chars``."""
    if opts.max_chars is None:
        return done
    return done.withColumn("over_limit", F.length("_body") > opts.max_chars)


def translate_rows(
    units: DataFrame, make_translator: Factory, opts: Options = Options(), profile=None
) -> DataFrame:
    """Add ``translated`` to rows that have ``text`` and ``src_lang``; no shuffle.

    ``profile``: a ResourceProfile (GPUs) for the Python stage, on clusters that offer them. Rows are then written
    with a number, two columns go through the stage, and results are joined back by that number.
    """
    body = with_body(units)
    if profile is None:
        raw = body.withColumn("_raw", translator_udf(make_translator, opts)("_body", "src_lang"))
    else:
        raw = translate_staged(body, make_translator, opts, profile)
    return with_limit(_finished(raw, opts), opts).drop("_body")


def translate_staged(
    body: DataFrame, make_translator: Factory, opts: Options, profile=None
) -> DataFrame:
    """Add ``_raw`` by a stage of its own that only sees a row's number, body and source."""
    rows = materialise(body.withColumn("_row", F.monotonically_increasing_id()), "staged")
    given = rows.select("_row", "_body", "src_lang").filter(F.col("_body") != "")
    done = translate_stage(given, make_translator, opts, profile).select("_row", "_raw")
    joined = rows.join(materialise(done, "stage-results"), "_row", "left").drop("_row")
    if _detailed(opts):
        return joined
    return joined.withColumn("_raw", F.coalesce("_raw", F.lit("")))


def translate_stage(
    body: DataFrame, make_translator: Factory, opts: Options, profile=None
) -> DataFrame:
    """The plug-in as a stage of its own, which may have its own resources.

    All columns of ``body`` pass through Python here, so it is to have few.
    """
    kind, model = _model(make_translator, opts)

    def run(batches):
        for batch in batches:
            yield batch.append_column("_raw", model(batch.column("_body"), batch.column("src_lang")))

    schema = T.StructType(body.schema.fields + [T.StructField("_raw", kind)])
    return body.mapInArrow(run, schema, profile=profile)


def body_key() -> Column:
    """A digest of source and body."""
    return F.unhex(F.sha2(F.concat_ws(":", "src_lang", "_body"), 256))


def keyed_bodies(units: DataFrame) -> DataFrame:
    """Units with ``_body`` and ``_key``, a digest of source and body; blank bodies have no key."""
    return with_body(units).withColumn("_key", F.when(F.col("_body") != "", body_key()))


def distinct_bodies(units: DataFrame) -> DataFrame:
    """(_key, _body, src_lang, _copies): each distinct text once, counted with a map-side combine.

    Only the distinct texts get a key: one in a filter would have every unit's language found twice.
    """
    given = with_body(units).filter(F.col("_body") != "")
    copies = given.groupBy("_body", "src_lang").agg(F.count("*").alias("_copies"))
    return copies.select(body_key().alias("_key"), "_body", "src_lang", "_copies")


def counted_keys(units: DataFrame) -> DataFrame:
    """(_key, _copies): each distinct text once, without the text."""
    given = with_body(units).filter(F.col("_body") != "")
    return given.groupBy(body_key().alias("_key")).agg(F.count("*").alias("_copies"))


def join_translations(
    body: DataFrame,
    table: DataFrame,
    opts: Options,
    hot_share: int = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
    counts: DataFrame | None = None,
) -> DataFrame:
    """Results of ``table`` (_key, _copies, results) back to all units; blank ones get an empty translation.

    ``counts`` (_key, _copies) counts instead of ``table`` where that is costly or has no counts.

    A unit takes one text and a digest through the join, a result its digest and the translation.
    """
    joined = join_copies(body, table, ["_key"], hot_share, hot_rows, "left", counts)
    done = joined.withColumn("translated", F.coalesce("translated", F.lit("")))
    if opts.split_chars is not None:
        done = done.withColumn("n_segments", F.coalesce("n_segments", F.lit(0)))
    return with_limit(done, opts).drop("_body", "_key")


def translate_distinct(
    units: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    hot_share: int = HOT_SHARE,
    hot_rows: int = HOT_ROWS,
    profile=None,
    own: bool = False,
) -> DataFrame:
    """Like ``translate_rows``, but each distinct (stripped text, source) is translated once.

    Copies are counted with a map-side combine; the translated texts are written as a table and
    joined back by their digest. That table's counts say which texts are hot, and those are salted.

    ``own`` adds ``_own``, the stripped text, normalised, of a unit whose translation is empty, and null otherwise: who
    wants no other part of the text need not take it through the join.
    """
    done = translate_bodies(distinct_bodies(units), make_translator, opts, profile)
    columns = ["_key", "_copies", *result_columns(opts)]
    if own:
        empty = F.coalesce("translated", F.lit("")) == ""
        done = done.withColumn("_own", F.when(empty, normalize_uz(F.col("text"))))
        columns.append("_own")
    table = materialise(done.select(*columns), "translations")
    return join_translations(keyed_bodies(units), table, opts, hot_share, hot_rows)


def own_in_table(opts: Options) -> bool:
    """Whether ``translate_distinct`` does the job, which can give ``_own``."""
    return opts.dedup and opts.memory is None


def translate_bodies(
    bodies: DataFrame, make_translator: Factory, opts: Options, profile=None
) -> DataFrame:
    """``translate_rows`` over rows of distinct ``_body`` that need no flag."""
    plain = replace(opts, max_chars=None)
    return translate_rows(bodies.withColumnRenamed("_body", "text"), make_translator, plain, profile)


def translate_units(
    units: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    profile=None,
    batch: str | None = None,
) -> DataFrame:
    """Translate units; detects or pins ``src_lang`` where the input has none.

    With ``opts.memory``, texts that earlier runs have translated do not reach the model; ``batch`` names what is
    learnt now, so that the same batch does not learn it twice.
    """
    if "src_lang" not in units.columns:
        units = with_unit_source(units, opts.source, opts.profiles)
    if opts.memory is not None:
        from unitflow.operators.memory import translate_remembered

        return translate_remembered(units, make_translator, opts, batch, profile)
    if opts.dedup:
        return translate_distinct(units, make_translator, opts, profile=profile)
    return translate_rows(units, make_translator, opts, profile)


def translate_with(
    df: DataFrame,
    fn: Callable[[list[str]], Sequence[str]],
    text: str = "text",
    out: str = "translated",
    batch_size: int = 32,
) -> DataFrame:
    """Add ``out``: a plain ``list[str] -> list[str]`` function over the non-blank texts.

    Texts are handed over as they are; blank ones stay as they are.
    """

    def make(options):
        return lambda texts, source, target: fn(texts)

    options = replace(Options(), batch_size=batch_size)
    blank = strip_ws(F.coalesce(F.col(text), F.lit(""))) == ""
    udf = translator_udf(make, options)
    given = df.withColumn("_given", F.when(~blank, F.col(text)).otherwise(""))
    return given.withColumn("_out", udf("_given", F.lit(ENGLISH))).withColumn(
        out, F.when(F.col("_given") == "", F.col(text)).otherwise(F.col("_out"))
    ).drop("_given", "_out")


def translate_text(
    spark: SparkSession,
    texts: str | Iterable[str] | DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
) -> DataFrame:
    """Translate one string, an iterable of strings, or the ``text`` column of a DataFrame.

    Strings pass through the driver and are numbered by ``idx``; their rows come back in that order, as
    nothing moves them. A sort would run the model once more to find its ranges.
    """
    if isinstance(texts, DataFrame):
        return translate_units(texts, make_translator, opts)
    rows = [texts] if isinstance(texts, str) else list(texts)
    df = spark.createDataFrame(list(enumerate(rows)), "idx bigint, text string")
    return translate_rows(with_unit_source(df, opts.source, opts.profiles), make_translator, opts)
