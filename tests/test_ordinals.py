"""Numbering with small blocks against brute force, one group holding most rows."""

import random

import pytest
from conftest import executed_plan, rows
from pyspark.sql import functions as F

from unitflow.operators import batching, ordinals, units, writeback


@pytest.fixture(scope="module")
def hot(spark):
    """Positions with gaps; document 0 holds two thirds of the rows."""
    rng = random.Random(3)
    data = [(0, p) for p in rng.sample(range(3000), 1000)]
    data += [(d, p) for d in range(1, 51) for p in rng.sample(range(40), 10)]
    rng.shuffle(data)
    return data, spark.createDataFrame(data, "doc_id bigint, pos bigint").repartition(5).cache()


def brute(data):
    out = []
    for d in {d for d, _ in data}:
        out += [(d, p, k) for k, p in enumerate(sorted(p for e, p in data if e == d))]
    return sorted(out, key=repr)


@pytest.mark.parametrize("block_rows", [1, 7, 64, 65_536])
def test_ordinal(hot, block_rows):
    data, df = hot
    got = ordinals.ordinal(df, ["doc_id"], "pos", "k", block_rows)
    assert rows(got, "doc_id", "pos", "k") == brute(data)


def test_running_sum(hot):
    data, df = hot
    got = ordinals.running_sum(df, ["doc_id"], "pos", F.col("pos"), "s", 16)
    want = {}
    for d, p, _ in sorted(brute(data)):
        want[d, p] = sum(q for e, q in data if e == d and q < p)
    assert {(r.doc_id, r.pos): r.s for r in got.collect()} == want


def test_hot_group_is_spread(hot):
    _, df = hot
    got = ordinals.ordinal(df, ["doc_id"], "pos", "k", 16)
    plan = executed_plan(got)
    assert "hashpartitioning(doc_id" in plan and "_block" in plan
    sizes = got.withColumn("b", F.expr("pos div 16")).groupBy("doc_id", "b").count()
    assert sizes.agg(F.max("count")).first()[0] <= 16


def test_renumber(hot):
    data, df = hot
    got = ordinals.renumber(df.withColumnRenamed("pos", "unit_idx"), block_rows=32)
    assert rows(got, "doc_id", "unit_idx") == sorted(((d, k) for d, _, k in brute(data)), key=repr)


@pytest.mark.parametrize("block_rows", [3, 65_536])
def test_plan_batches(spark, block_rows):
    data = [(1, i, "a" if i % 3 else "b", f"t{i}") for i in range(100)]
    df = spark.createDataFrame(data, "doc_id bigint, unit_idx bigint, src_lang string, text string")
    got = batching.plan_batches(df, 8, block_rows)
    seen = {"a": 0, "b": 0}
    want = []
    for d, i, lang, _ in data:
        want.append((d, i, seen[lang] // 8, seen[lang] % 8))
        seen[lang] += 1
    assert rows(got, "doc_id", "unit_idx", "batch_no", "pos") == sorted(want, key=repr)


def test_progress_of_a_long_document(spark):
    n = 5000
    df = spark.range(n).selectExpr(
        "1L as doc_id", "id as unit_idx", "case when id % 4 = 1 then 'a' else 'b' end as src_lang"
    )
    got = batching.progress(df, 2).orderBy("step").collect()
    done, want = 0, []
    for lang, size in (("b", 3750), ("a", 1250)):  # b appears first
        for b in range(0, size, 2):
            done += min(2, size - b)
            want.append((lang, b // 2, done, n, f"Tarjima: {done}/{n}"))
    assert [(r.src_lang, r.batch_no, r.done, r.total, r.message) for r in got] == want
    assert [r.step for r in got] == list(range(1, len(want) + 1))


def layout_rows(pages_per_doc):
    span = lambda t: (t, [0.0, 1.0, 2.0, 3.0], 0.0, None)
    out, want = [], []
    for d, n in pages_per_doc.items():
        k = 0
        for p in range(n):
            texts = [f"{d}.{p}.{j}" for j in range(p % 4)] + [" "]
            out.append((d, p, [(1, [([span("image")],)]), (0, [([span(t)],) for t in texts])]))
            for t in texts[:-1]:
                want.append((d, k, f"pdf-{k}", p, t, 11.0, 0))
                k += 1
    return out, sorted(want, key=repr)


@pytest.mark.parametrize("page_block", [2, 4096])
def test_explode_spans(spark, page_block):
    from unitflow import schemas

    data, want = layout_rows({1: 30, 2: 1, 3: 5})
    layout = spark.createDataFrame(data, schemas.LAYOUT)
    got = units.explode_spans(layout, page_block)
    assert rows(got, "doc_id", "unit_idx", "uid", "page", "text", "size", "color") == want


@pytest.mark.parametrize("n", [1, 44, 45, 88, 89])
def test_paginate(spark, n):
    data = [(1, 2 * i, f"t{i}", None) for i in range(n)] + [(1, 1, " ", None), (2, 0, "x" * 501, None)]
    df = spark.createDataFrame(data, "doc_id bigint, unit_idx bigint, text string, translated string")
    got = writeback.paginate(df)
    mine = got.filter("doc_id = 1").orderBy("unit_idx").collect()
    page, y, want = 0, 50, []
    for _ in range(n):
        if y > 750:
            page, y = page + 1, 50
        want.append((page, y))
        y += 16
    assert [(r.page_no, r.y) for r in mine] == want
    long = got.filter("doc_id = 2").first()
    assert (long.line, long.rest, long.cut_chars) == ("x" * 500, "x", 1)
    short = writeback.paginate(df, line_chars=1).filter("doc_id = 2").first()
    assert (short.line, short.rest, short.cut_chars) == ("x", "x" * 500, 500)
