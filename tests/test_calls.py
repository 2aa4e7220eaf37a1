"""Segments, batches by length and failing calls."""

import random

import pytest
from conftest import executed_plan, rows
from pyspark.sql import functions as F

from unitflow.functions.text import WHITESPACE
from unitflow.operators import batching, calls, inference
from unitflow.options import ENGLISH, Options


def text(seed, n):
    rng = random.Random(seed)
    return "".join(rng.choice("abc .!?…\n 　é😀") for _ in range(n))


@pytest.mark.parametrize("chars", [2, 3, 10, 77])
def test_segments_are_the_text(chars):
    for seed in range(60):
        given = text(seed, seed * 7)
        parts = calls.segments_of(given, chars)
        assert "".join(parts) == given
        assert all(len(p) <= chars for p in parts) and (not given or all(parts))


def test_segments_end_where_sentences_do():
    given = "One two. Three four! Five six seven? Eight"
    assert calls.segments_of(given, 22) == ["One two. Three four! ", "Five six seven? Eight"]
    assert calls.segments_of(given, 100) == [given]
    assert calls.segments_of("aaaa bbbb cccc", 6) == ["aaaa ", "bbbb ", "cccc"]
    assert calls.segments_of("x" * 7, 3) == ["xxx", "xxx", "x"]
    assert calls.segments_of("v1.2 is 3.14159 long", 8) == ["v1.2 is ", "3.14159 ", "long"]


def test_long_texts_keep_their_white_space():
    given = "First one.  \n Second　two! " + " " * 30 + "Third"
    done = calls.translate_long(
        [given, "", "short"], ["x"] * 3, lambda ts, s, t: [f"<{x}>" for x in ts], Options(split_chars=14)
    )
    plain = done[0][0].replace("<", "").replace(">", "")
    assert plain == given and done[0][2] > 3
    assert all(p == p.strip(WHITESPACE) for p in done[0][0].replace(">", "<").split("<")[1::2])
    assert done[1:] == [("", None, 0), ("<short>", None, 1)]


def test_batches_by_length_stay_in_the_budget():
    texts = ["x" * n for n in (5, 400, 7, 90, 88, 3, 1, 2, 4000, 6)]
    opts = Options(batch_tokens=60, batch_size=4)
    batches = list(calls.cut_batches(texts, opts))
    assert sorted(i for b in batches for i in b) == list(range(len(texts)))
    for b in batches:
        longest = max(calls.estimated_tokens(texts[i]) for i in b)
        assert len(b) == 1 or (longest * len(b) <= 60 and len(b) <= 4)
    assert [sorted(b) for b in batches][-1] == [8]


def test_batches_by_length_change_no_result(spark):
    units = spark.createDataFrame(
        [(i, f"{text(i, i % 90)}|") for i in range(400)], "unit_idx bigint, text string"
    ).repartition(3)
    plain = inference.translate_units(units, inference.stub_translator, Options(dedup=False))
    for opts in (Options(dedup=False, batch_tokens=50), Options(batch_tokens=7, batch_size=5)):
        assert rows(inference.translate_units(units, inference.stub_translator, opts), *plain.columns) == rows(plain)


def test_padding_is_reported(spark):
    units = spark.createDataFrame(
        [(i, "x" * (4 if i % 2 else 400)) for i in range(200)], "unit_idx bigint, text string"
    ).coalesce(1)
    report = {
        r.plan: r for r in batching.padding_report(units, Options(batch_size=20, batch_tokens=2020)).collect()
    }
    assert report["in order"].tokens == report["by length"].tokens == 100 * 2 + 100 * 101
    assert report["in order"].padded == 100 * 99 and report["by length"].padded == 0
    assert report["by length"].share == 0 < report["in order"].share < 1


def failing(bad):
    def make(options):
        def fn(texts, source, target):
            if any(bad in t for t in texts):
                raise RuntimeError("no way")
            return [t + "!" for t in texts]

        return fn

    return make


def test_a_bad_text_is_found_by_halving():
    seen = []

    def fn(texts, source, target):
        seen.append(len(texts))
        return failing("bad")(None)(texts, source, target)

    texts = [f"t{i}" for i in range(32)]
    texts[13] = "a bad one"
    done = calls.translate_texts(texts, ["x"] * 32, fn, Options(on_error="row"))
    assert [e for _, e in done if e] == ["RuntimeError: no way"] and done[13] == ("", "RuntimeError: no way")
    assert all(t == texts[i] + "!" for i, (t, e) in enumerate(done) if not e)
    assert len(seen) <= 12
    with pytest.raises(RuntimeError):
        calls.translate_texts(texts, ["x"] * 32, fn, Options())


@pytest.mark.parametrize("dedup", [False, True])
def test_the_job_goes_on_after_a_bad_text(spark, dedup):
    data = ["fine", "bad", "fine", "", None, "long enough. bad here. and on"]
    units = spark.createDataFrame(list(enumerate(data)), "unit_idx bigint, text string")
    opts = Options(dedup=dedup, on_error="row", split_chars=13)
    done = inference.translate_units(units, failing("bad"), opts)
    got = {r.unit_idx: (r.translated, r.error, r.n_segments) for r in done.collect()}
    bad = "RuntimeError: no way"
    assert got == {
        0: ("fine!", None, 1), 1: ("", bad, 1), 2: ("fine!", None, 1), 3: ("", None, 0), 4: ("", None, 0),
        5: ("", bad, 3),
    }
    with pytest.raises(Exception, match="no way"):
        inference.translate_units(units, failing("bad"), Options(dedup=dedup)).collect()


def test_a_wrong_count_ends_the_job_all_the_same():
    with pytest.raises(ValueError, match="translator returned"):
        calls.translate_texts(["a", "b"], ["x", "x"], lambda t, s, g: t[:1], Options(on_error="row"))


def test_blank_units_are_spread_in_the_join(spark):
    units = spark.range(2000).selectExpr("id as unit_idx", "if(id % 2 = 0, '  ', concat('t', id % 7)) as text")
    sourced = units.withColumn("src_lang", F.lit(ENGLISH))
    assert inference.keyed_bodies(sourced).filter("_key is null").count() == 1000
    assert inference.distinct_bodies(sourced).count() == 7
    done = inference.translate_units(units, inference.stub_translator, Options())
    assert done.filter("translated = ''").count() == 1000 and done.count() == 2000
    plan = executed_plan(done)
    assert "4096" in plan


def test_the_stage_sees_three_columns(spark):
    units = spark.createDataFrame([(i, f"t{i % 3}" if i % 4 else "", "x" * 9) for i in range(40)], "unit_idx bigint, text string, more string")
    body = inference.with_body(units.withColumn("src_lang", F.lit(ENGLISH)))
    done = inference.translate_staged(body, inference.stub_translator, Options())
    assert done.filter("_raw = ''").count() == 10 and done.count() == 40
    plan = executed_plan(inference.translate_stage(body.select("unit_idx", "_body", "src_lang"), inference.stub_translator, Options()))
    assert "MapInArrow" in plan
