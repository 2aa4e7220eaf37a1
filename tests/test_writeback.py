"""Write-back, assembly, images, placement, quality."""

import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from unitflow import schemas
from unitflow.functions.layout import fit_font_size, unpack_rgb
from unitflow.operators import placement, quality, units, writeback
from unitflow.operators.inference import stub_translator
from unitflow.options import Options
from unitflow.plans import corpus


def test_blank_paragraphs_do_not_shift_translations(spark):
    """Each paragraph gets its own translation however many blank ones lie before it."""
    paras = spark.createDataFrame(
        [
            (1, 0, "body", [" "]),
            (1, 1, "body", ["one"]),
            (1, 2, "body", []),
            (1, 3, "body", ["", "two", "b"]),
            (1, 4, "header0", ["three"]),
        ],
        schemas.PARAS,
    )
    done = corpus.translate_paras(paras, stub_translator, Options(source="eng_Latn"))
    assert rows(done, "para_idx", "runs") == [
        (0, [" "]),
        (1, ["[eng_Latn>uzn_Latn] one"]),
        (2, []),
        (3, ["", "[eng_Latn>uzn_Latn] twob", ""]),
        (4, ["[eng_Latn>uzn_Latn] three"]),
    ]


@pytest.mark.parametrize("part_units", [1, 3, 4096])
def test_parts_join_to_the_whole(spark, part_units):
    texts = [f"line {i}" if i % 4 else "" for i in range(20)]
    docs = spark.createDataFrame([(1, "\n".join(texts))], schemas.DOCUMENTS)
    parts = writeback.assemble_document(units.explode_lines(docs), part_units=part_units)
    got = parts.orderBy("part").collect()
    assert "\n".join(r.text for r in got) == "\n".join(texts)
    assert max(r.n_pieces for r in got) <= part_units
    assert len(got) == -(-20 // part_units)


def test_corpus_of_long_documents_keeps_every_paragraph(spark):
    text = "\n".join(["", "first", " ", "second", ""])
    docs = spark.createDataFrame([(1, text), (2, " \n")], schemas.DOCUMENTS)
    for opts in (Options(), Options(dedup=False), Options(mode="per_unit")):
        done = corpus.translate_corpus(spark, docs, stub_translator, opts)
        mark = "[eng_Latn>uzn_Latn] "
        assert rows(done, "doc_id", "text") == [(1, f"\n{mark}first\n \n{mark}second\n")]


def test_page_images(spark):
    data = [
        (1, 0, 0, 5, 9.0, 4, 40),  # the first copy is too small, so the second is not taken
        (1, 0, 1, 5, 8.0, 40, 40),
        (1, 0, 2, 0, 7.0, 40, 40),
        (1, 0, 3, None, 7.0, 40, 40),
        (1, 0, 4, 6, 7.0, 8, 8),
        (1, 0, 5, 6, 1.0, 80, 80),
        (1, 1, 0, 6, 3.0, 40, 7),
    ]
    got = writeback.page_images(spark.createDataFrame(data, schemas.IMAGES))
    assert rows(got, "doc_id", "page", "xref", "img_idx", "y0") == [(1, 0, 6, 4, 7.0)]


SPAN_COLUMNS = (
    "doc_id bigint, unit_idx bigint, kind string, page bigint, bbox array<double>, text string, "
    "translated string"
)


@pytest.mark.parametrize("part_items", [2, 5, 4096])
def test_pages_of_any_size(spark, part_items):
    rng = random.Random(5)
    spans = [
        (1, i, "pdf_span", 1, [0.0, float(rng.choice([0, 3, 7])), 1.0, 1.0], f"t{i}", f"T{i}")
        for i in range(30)
    ] + [(1, 30, "pdf_span", 0, [0.0, 5.0, 1.0, 1.0], " ", "")]
    images = spark.createDataFrame([(1, 1, 0, 9, 3.0, 20, 20)], schemas.IMAGES)
    pages = spark.createDataFrame([(1, 3)], "doc_id bigint, n_pages bigint")
    got = writeback.assemble_pages(
        spark.createDataFrame(spans, SPAN_COLUMNS), images, pages, part_items
    )
    items = sorted(
        [(s[4][1], 0, s[1], s[6]) for s in spans[:30]] + [(3.0, 1, 0, "[image 9]")]
    )
    text = {}
    for r in got.orderBy("page", "part").collect():
        text.setdefault(r.page, []).append(r.text)
        assert r.break_before == (r.page > 0 and r.part == 0)
        assert r.n_items <= part_items
    assert "\n".join(text[1]) == "\n".join(["Sahifa 2"] + [x[3] for x in items])
    assert text[0] == ["Sahifa 1"] and text[2] == ["Sahifa 3"]


def test_pages_without_a_page_list(spark):
    spans = [
        (1, 0, "pdf_span", 4, [0.0, 5.0, 1.0, 1.0], "a", None),
        (1, 1, "pdf_span", 2, [0.0, 5.0, 1.0, 1.0], "b", None),
        (2, 0, "docx_para", None, None, "c", "C"),
        (2, 1, "docx_para", None, None, "d", "D"),
    ]
    got = writeback.assemble_pages(spark.createDataFrame(spans, SPAN_COLUMNS))
    assert rows(got, "doc_id", "page", "break_before", "text") == [
        (1, 2, False, "Sahifa 3\nb"),
        (1, 4, True, "Sahifa 5\na"),
        (2, 0, False, "Sahifa 1\nC\nD"),
    ]


def shrink(w, h, n, size, slack):
    """Brute force: from the wished size down in half points."""
    k = max(4.0, size)
    while k >= 4.0:
        lines = max(1, int(h / (k * 1.2)))
        if n <= max(1, int(w * lines / (k * 0.5))) * slack:
            return k
        k -= 0.5
    return 4.0


def test_fit_font_size(spark):
    rng = random.Random(11)
    data = [
        (rng.uniform(0, 400), rng.uniform(0, 80), rng.randrange(300), rng.uniform(0, 40))
        for _ in range(1500)
    ] + [(0.0, 0.0, 5, 11.0), (300.0, 20.0, 3, 2.0), (500.0, 30.0, 4, 12.0), (1.0, 1.0, 99, 30.0)]
    df = spark.createDataFrame(data, "w double, h double, n int, s double")
    for slack in (1.2, 1.15):
        size = fit_font_size(F.col("w"), F.col("h"), F.expr("repeat('x', n)"), F.col("s"), slack)
        got = df.select("*", size.alias("f")).collect()
        assert [r.f for r in got] == [shrink(r.w, r.h, r.n, r.s, slack) for r in got]


def test_unpack_rgb(spark):
    df = spark.createDataFrame([(0x336699,), (0,), (0xFFFFFF,), (None,)], "c int")
    got = [tuple(r[0]) for r in df.select(unpack_rgb(F.col("c"))).collect()]
    assert got == [(0.2, 0.4, 0.6), (0, 0, 0), (1, 1, 1), (0, 0, 0)]


def test_layout_plan(spark):
    spans = [
        (1, 0, "pdf_span", 0, [0.0, 10.0, 100.0, 12.0], "a", "A", 0.0, None),
        (1, 1, "pdf_span", 0, [0.0, 10.0, 10.0, 12.0], "b", "x" * 500, 8.0, 255),
        (1, 2, "pdf_span", 0, [0.0, 10.0, 10.0, 12.0], "c", " ", 8.0, 255),
    ]
    df = spark.createDataFrame(spans, SPAN_COLUMNS + ", size double, color int")
    plan = placement.layout_plan(df)
    got = {r.unit_idx: r for r in plan.collect()}
    assert sorted(got) == [0, 1]  # blank results are not drawn
    assert (got[0].size, got[0].y1, got[0].shrunk) == (11.0, 10.0 + 11.0 * 1.35, False)
    assert (got[1].font_size, got[1].shrunk, got[1].overflow) == (4.0, True, True)
    assert (got[1].r, got[1].g, got[1].b) == (0.0, 0.0, 1.0)
    assert rows(placement.overflow_report(plan)) == [(1, 0, 2, 1, 1, 1)]


def test_expectations_on_a_small_batch(spark):
    """A greeting is greeted; a batch of two gives two non-empty results."""
    df = spark.createDataFrame(
        [(1, 0, "eng_Latn", "Hi, how are you?", "Salom, qalaysiz?"),
         (1, 1, "eng_Latn", "Thanks.", "Rahmat."),
         (2, 0, "rus_Cyrl", "Да.", ""),
         (2, 1, "rus_Cyrl", "Нет.", None)],
        "doc_id bigint, unit_idx bigint, src_lang string, text string, translated string",
    )
    rules = {"non_empty": quality.non_empty(), "greets": quality.contains_any(["SALOM", "qanday"])}
    assert rows(quality.check(df, rules)) == [
        ("greets", 1, 3), ("non_empty", 2, 2), ("same_count", 3, 1),
    ]
    assert rows(quality.batch_check(df, 2)) == [("whole_batch", 1, 1)]
    assert rows(quality.quality_report(df)) == [
        ("eng_Latn", 2, 2, 0, 0, 0, 1.0), ("rus_Cyrl", 2, 0, 2, 0, 0, 0.0),
    ]
