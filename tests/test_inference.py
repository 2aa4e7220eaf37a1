"""Batch translation: batches, order, copies, bad plug-ins."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from unitflow.functions.text import normalize_uz, strip_ws
from unitflow.operators import inference, joins
from unitflow.operators.voting import with_unit_source
from unitflow.options import ENGLISH, RUSSIAN, Options
from unitflow.session import materialise

STUB = inference.stub_translator
DATA = [(i % 7, i, t) for i, t in enumerate(["привет", "hello", " hello ", "", None, "o?zbek"] * 40)]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(DATA, "doc_id bigint, unit_idx bigint, text string").cache()


def expected():
    out = []
    for _, i, t in DATA:
        body = (t or "").strip()
        src = RUSSIAN if body == "привет" else ENGLISH
        done = f"[{src}>uzn_Latn] {body}" if body else ""
        out.append((i, src, done.replace("?", "'")))
    return sorted(out, key=repr)


@pytest.mark.parametrize("batch_size", [1, 7, 32])
@pytest.mark.parametrize("dedup", [False, True])
def test_batch_size_and_dedup_change_nothing(units, batch_size, dedup):
    done = inference.translate_units(units, STUB, Options(batch_size=batch_size, dedup=dedup))
    assert rows(done, "unit_idx", "src_lang", "translated") == expected()


@pytest.mark.parametrize("partitions", [1, 8])
def test_partitions_change_nothing(units, partitions):
    done = inference.translate_units(units.repartition(partitions), STUB, Options(dedup=False))
    assert rows(done, "unit_idx", "src_lang", "translated") == expected()


def test_calls_hold_one_source_in_order():
    calls = []

    def fn(texts, source, target):
        calls.append((source, list(texts)))
        return texts

    out = inference.translate_batch(
        ["a", "", "b", "c", "d", "e"], ["x", "x", "y", "x", "y", "x"], fn, Options(batch_size=2)
    )
    assert out == ["a", "", "b", "c", "d", "e"]
    assert calls == [("x", ["a", "c"]), ("x", ["e"]), ("y", ["b", "d"])]


def test_copies_reach_the_model_once(spark, units):
    def make(options):
        def fn(texts, source, target):
            assert len(set(texts)) == len(texts)
            return [t + "!" for t in texts]

        return fn

    one = units.filter("trim(text) = 'hello'").coalesce(1)
    done = inference.translate_units(one, make, Options(batch_size=1000))
    assert {r.translated for r in done.collect()} == {"hello!"}
    with pytest.raises(Exception):
        inference.translate_units(one, make, Options(batch_size=1000, dedup=False)).collect()


def test_hot_copies_are_salted(spark):
    """A text with a third of all rows, and one whose copies fill a few salts."""
    data = [(i, "hot" if i % 3 == 0 else "warm" if i % 3 == 1 and i < 900 else f"t{i}")
            for i in range(3000)]
    df = spark.createDataFrame(data, "k bigint, text string")
    counts = df.groupBy("text").agg(F.count("*").alias("_copies"))
    table = materialise(counts.withColumn("v", F.concat("text", F.lit("!"))))
    got = joins.join_copies(df, table, ["text"], hot_share=100, hot_rows=50)
    assert rows(got, "k", "text", "v") == sorted(((k, t, t + "!") for k, t in data), key=repr)
    assert got.columns == ["text", "k", "v"]
    plan = got._jdf.queryExecution().toString()
    assert "_salt" in plan
    plain = joins.join_copies(df, table, ["text"])
    assert plain.columns == got.columns
    assert rows(plain, "k", "v") == rows(got, "k", "v")


def test_salts_follow_the_copies(spark):
    df = spark.range(1000).selectExpr("id as k", "'hot' as text")
    table = materialise(df.groupBy("text").agg(F.count("*").alias("_copies")))
    got = joins.join_copies(df, table, ["text"], hot_share=10, hot_rows=10)
    assert got.count() == 1000 and got.select("k").distinct().count() == 1000


def test_short_result_fails(units):
    def make(options):
        return lambda texts, source, target: texts[:-1]

    with pytest.raises(Exception, match="translator returned"):
        inference.translate_units(units, make, Options(dedup=False)).collect()
    with pytest.raises(Exception, match="translator returned"):
        inference.translate_with(units, lambda texts: list(texts) + ["more"]).collect()


def test_unsupported_source_fails(units):
    bad = units.withColumn("src_lang", F.lit("deu_Latn"))
    with pytest.raises(Exception, match="unsupported source: deu_Latn"):
        inference.translate_units(bad, STUB, Options(dedup=False)).collect()


def test_pinned_source_and_options_reach_the_plug_in(units):
    def make(options):
        return lambda texts, s, t: [f"{s} {t} {options.beam_size}" for _ in texts]

    opts = Options(source=RUSSIAN, target="kaa_Latn", beam_size=4, dedup=False, max_chars=5)
    done = inference.translate_units(units, make, opts)
    assert {r.translated for r in done.collect()} == {"", "rus_Cyrl kaa_Latn 4"}
    flagged = {(r.text, r.over_limit) for r in done.collect()}
    assert ("o?zbek", True) in flagged and (" hello ", False) in flagged


def test_stage_equals_column_function(units):
    rows_ = with_unit_source(units).withColumn("_body", strip_ws(F.coalesce("text", F.lit(""))))
    done = inference.translate_stage(rows_, STUB, Options(batch_size=7))
    got = done.select("unit_idx", "src_lang", normalize_uz(F.col("_raw")).alias("translated"))
    assert rows(got) == expected()


def test_model_is_loaded_once_per_worker(spark):
    def make(options):
        import os
        import uuid

        mark = f"{os.getpid()}-{uuid.uuid4()}"
        return lambda texts, s, t: [mark for _ in texts]

    df = spark.range(400).selectExpr("id as unit_idx", "concat('text ', id) as text")
    done = inference.translate_rows(
        df.repartition(40).withColumn("src_lang", F.lit(ENGLISH)), make, Options()
    )
    marks = {r.translated for r in done.collect()}
    assert len(marks) == len({m.split("-")[0] for m in marks})


def test_translate_text_forms(spark):
    one = inference.translate_text(spark, "hello", STUB).collect()
    assert [r.translated for r in one] == ["[eng_Latn>uzn_Latn] hello"]
    many = inference.translate_text(spark, iter(["привет", "", "hi"]), STUB).collect()
    assert [r.translated for r in many] == ["[rus_Cyrl>uzn_Latn] привет", "", "[eng_Latn>uzn_Latn] hi"]
    assert inference.translate_text(spark, [], STUB).count() == 0


def test_translate_with_keeps_blanks(spark):
    df = spark.createDataFrame([(0, " a "), (1, " "), (2, None)], "k int, text string")
    done = inference.translate_with(df, lambda texts: [t.upper() for t in texts])
    assert rows(done, "k", "translated") == [(0, " A "), (1, " "), (2, None)]
