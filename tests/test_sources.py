"""Line files, DOCX files, manifests and sinks."""

import os
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from unitflow.functions.text import paragraph_text
from unitflow.operators.inference import stub_translator
from unitflow.options import Options
from unitflow.plans import corpus
from unitflow.plans.fixtures import docx_bytes, docx_paragraph
from unitflow.sources import docx, lines, manifest, sinks


def test_lines_of_one_big_file_in_many_splits(spark, tmp_path):
    n = 20_000
    text = [f"line {i}" if i % 7 else " " for i in range(n)]
    path = tmp_path / "big.txt"
    path.write_text("\n".join(text), encoding="utf-8")
    kept = [t for t in text if t.strip()]
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(path.stat().st_size // 9))
    try:
        got = lines.read_lines(spark, str(path)).orderBy("line_idx").collect()
        splits = spark.read.text(str(path)).select(F.input_file_block_start()).distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits >= 9
    assert [r.line_idx for r in got] == list(range(len(kept)))
    assert [r.text for r in got] == kept


def test_lines_at_rare_breaks_and_spaces(spark, tmp_path):
    text = "a\x0bb\r\n \n c \x1cd\x85e f\rg"
    (tmp_path / "x.txt").write_bytes(text.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    want = [t for t in text.splitlines() if t.strip()]
    got = lines.read_lines(spark, str(tmp_path)).orderBy("line_idx").collect()
    assert [r.text for r in got] == want
    stripped = lines.read_lines(spark, str(tmp_path), strip=True).orderBy("line_idx").collect()
    assert [r.text for r in stripped] == [t.strip() for t in want]
    loose = lines.read_lines(spark, str(tmp_path), numbered=False)
    assert Counter(r.text for r in loose.collect()) == Counter(want)


def test_empty_line_file_gives_an_empty_table(spark, tmp_path):
    (tmp_path / "empty.txt").write_bytes(b"\n \n")
    given = lines.read_lines(spark, str(tmp_path))
    assert corpus.translate_lines(given, stub_translator).count() == 0


def test_line_files_are_translated_side_by_side(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "ru.txt").write_text("Привет всем\n\nHello\n", encoding="utf-8")
    given = lines.read_lines(spark, str(tmp_path / "in"))
    done = corpus.translate_lines(given, stub_translator)
    out = str(tmp_path / "out")
    sinks.write_side_by_side(done, out, "path", "line_idx")
    assert sorted(r.value for r in spark.read.text(out).collect()) == [
        "Hello\t→\t[rus_Cyrl>uzn_Latn] Hello",
        "Привет всем\t→\t[rus_Cyrl>uzn_Latn] Привет всем",
    ]
    pinned = corpus.translate_lines(given, stub_translator, Options(source="eng_Latn"))
    assert {r.src_lang for r in pinned.collect()} == {"eng_Latn"}


P = docx_paragraph


def cell(*content, props=""):
    return f"<w:tc><w:tcPr>{props}</w:tcPr>{''.join(content)}</w:tc>"


def table(*table_rows):
    return "<w:tbl>" + "".join(f"<w:tr>{''.join(r)}</w:tr>" for r in table_rows) + "</w:tbl>"


BODY = (
    P("one ", "run two")
    + table(
        [cell(P("a"), table([cell(P("deep"))])), cell(P("b"), P("b2"))],
        [cell(P("wide"), props='<w:gridSpan w:val="2"/>')],
    )
    + P()
    + "<w:p><w:r><w:t>x</w:t><w:tab/><w:t>y</w:t><w:br/><w:br w:type=\"page\"/></w:r>"
    "<w:hyperlink><w:r><w:t>link</w:t></w:r></w:hyperlink></w:p>"
    + table(
        [cell(P("top"), props='<w:vMerge w:val="restart"/>'), cell(P("r0"))],
        [cell(P("hidden"), props="<w:vMerge/>"), cell(P("r1"))],
    )
)
WANT = [
    ("body", ["one ", "run two"]),
    ("body", []),
    ("body", ["x\ty\n"]),
    ("table0_r0c0p0", ["a"]),
    ("table0_r0c0_n0_r0c0p0", ["deep"]),
    ("table0_r0c1p0", ["b"]),
    ("table0_r0c1p1", ["b2"]),
    ("table0_r1c0p0", ["wide"]),
    ("table0_r1c1p0", ["wide"]),
    ("table1_r0c0p0", ["top"]),
    ("table1_r0c1p0", ["r0"]),
    ("table1_r1c0p0", ["top"]),
    ("table1_r1c1p0", ["r1"]),
]


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("docx")
    (path / "a.docx").write_bytes(docx_bytes(BODY, P("head") + table([cell(P("h"))])))
    (path / "b.DOCX").write_bytes(docx_bytes(P("plain")))
    (path / "bad.docx").write_bytes(b"no zip file")
    (path / "note.txt").write_text("not taken")
    return str(path)


def test_read_docx(spark, folder):
    got = {}
    for r in docx.read_docx(spark, folder).orderBy("doc_id", "para_idx").collect():
        got.setdefault(os.path.basename(r.doc_id), []).append(r)
    assert sorted(got) == ["a.docx", "b.DOCX", "bad.docx"]
    a = got["a.docx"]
    want = WANT + [("header0", ["head"]), ("header0_t0_r0c0p0", ["h"]), ("footer0", [])]
    assert [(r.loc, r.runs) for r in a] == want
    assert [r.para_idx for r in a] == list(range(len(a)))
    assert [(r.loc, r.runs) for r in got["b.DOCX"]] == [
        ("body", ["plain"]), ("header0", []), ("footer0", []),
    ]
    assert got["bad.docx"][0].error.startswith("BadZipFile")


def test_docx_folder_is_translated(spark, folder):
    paras = docx.read_docx(spark, folder).filter("error is null").drop("error")
    done = corpus.translate_paras(paras, stub_translator)
    a = done.filter(F.col("doc_id").endswith("a.docx")).orderBy("para_idx")
    texts = [r[0] for r in a.select(paragraph_text(F.col("runs"))).collect()]
    mark = "[eng_Latn>uzn_Latn] "
    assert texts[:5] == [mark + "one run two", "", mark + "x\ty", mark + "a", mark + "deep"]


def test_layouts_are_read_with_a_fixed_schema(spark, tmp_path):
    from unitflow.operators.units import explode_spans
    from unitflow.sources.layout import read_images, read_layout

    (tmp_path / "pages.json").write_text(
        '{"doc_id": 1, "page": 0, "blocks": [{"type": 0, "lines": [{"spans": ['
        '{"text": "a", "bbox": [0, 1, 2, 3], "size": 9.5, "color": 1, "flags": 4}]}, {}]}, '
        '{"type": 0}, {"type": 1}]}\n'
        '{"doc_id": 1, "page": 1, "blocks": null}\n'
    )
    got = explode_spans(read_layout(spark, str(tmp_path / "pages.json"), "json"))
    assert rows(got, "unit_idx", "page", "bbox", "size", "color", "text") == [
        (0, 0, [0.0, 1.0, 2.0, 3.0], 9.5, 1, "a")
    ]
    (tmp_path / "images.json").write_text('{"doc_id": 1, "page": 0, "xref": 3, "y0": 2}\n')
    images = read_images(spark, str(tmp_path / "images.json"), "json")
    assert rows(images, "xref", "y0", "width") == [(3, 2.0, None)]


@pytest.mark.parametrize(
    "path, requested, out, want",
    [
        ("in/A.PDF", "auto", None, (".pdf", "pdf", "in/A_uz.pdf", None, "replace_spans")),
        ("in/a.v1.docx", None, None, (".docx", "docx", "in/a.v1_uz.docx", None, "replace_paragraphs")),
        ("a.docx", "PDF", "o/x.tmp", (".docx", "pdf", "o/x.pdf", None, "paginate_lines")),
        ("a.pdf", "docx", "o.d/x", (".pdf", "docx", "o.d/x.docx", None, "rebuild_pages")),
        ("a.txt", "docx", None, (".txt", None, None, "unsupported input", None)),
        ("dir.pdf/plain", "auto", None, ("", None, None, "unsupported input", None)),
        (".pdf", "auto", None, ("", None, None, "unsupported input", None)),
        ("a.pdf", "odt", None, (".pdf", None, None, "unknown output format", None)),
    ],
)
def test_manifest(spark, path, requested, out, want):
    df = spark.createDataFrame([(path, requested, out)], "path string, requested string, out string")
    r = manifest.route(manifest.plan_manifest(df)).first()
    assert (r.suffix, r.out_format, r.out_path, r.reject_reason, r.writer) == want
    assert (r.mime is None) == (r.reject_reason is not None)


def test_sink_keeps_parts_in_order(spark, tmp_path):
    data = [(d, p, f"{d}-{p}", "docx" if d % 2 else "pdf") for d in range(5) for p in range(40)]
    df = spark.createDataFrame(data, "doc_id bigint, part bigint, text string, out_format string")
    out = str(tmp_path / "out")
    sinks.write_translated(df.repartition(7), out)
    back = spark.read.parquet(out)
    assert rows(back, "doc_id", "part", "text", "out_format") == sorted(data, key=repr)
