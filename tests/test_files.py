"""A mixed folder through all four writers."""

from conftest import rows

from unitflow import schemas
from unitflow.operators.inference import stub_translator
from unitflow.options import Options
from unitflow.plans.files import translate_files


def spans(*texts):
    return [(0, [([(t, [0.0, 10.0 * i, 90.0, 10.0 * i + 9], 9.0, 0)],) for i, t in enumerate(texts)])]


def test_each_file_goes_through_its_writer(spark):
    files = spark.createDataFrame(
        [
            (1, "a.docx", "auto"), (2, "b.docx", "pdf"), (3, "c.pdf", "docx"), (4, "d.pdf", ""),
            (5, "e.txt", "auto"), (6, "f.docx", "odt"), (7, "empty.docx", "docx"),
            (8, "scan.pdf", "docx"), (9, "missing.pdf", "pdf"),
        ],
        "doc_id bigint, path string, requested string",
    )
    paras = spark.createDataFrame(
        [(d, p, "body", runs) for d in (1, 2, 6) for p, runs in enumerate([["a", "b"], [], ["c"]])]
        + [(7, 0, "body", [" "])],
        schemas.PARAS,
    )
    layout = spark.createDataFrame(
        [(3, 0, spans("x", " ")), (3, 1, spans(" ")), (4, 0, spans("y", "z")), (8, 0, spans(" "))],
        schemas.LAYOUT,
    )
    images = spark.createDataFrame(
        [(3, 1, 0, 7, 5.0, 20, 20), (8, 0, 0, 7, 5.0, 20, 20)], schemas.IMAGES
    )
    out = translate_files(files, paras, layout, stub_translator, Options(), images)
    mark = "[eng_Latn>uzn_Latn] "
    assert rows(out["replace_paragraphs"], "doc_id", "para_idx", "runs") == [
        (1, 0, [mark + "ab", ""]), (1, 1, []), (1, 2, [mark + "c"]),
    ]
    assert rows(out["paginate_lines"], "doc_id", "page_no", "y", "line") == [
        (2, 0, 50, mark + "ab"), (2, 0, 66, mark + "c"),
    ]
    assert rows(out["rebuild_pages"], "doc_id", "page", "text") == [
        (3, 0, f"Sahifa 1\n{mark}x"), (3, 1, "Sahifa 2\n[image 7]"),
    ]
    assert rows(out["replace_spans"], "doc_id", "text") == [(4, mark + "y"), (4, mark + "z")]
    assert rows(out["rejected"], "doc_id", "reject_reason") == [
        (5, "unsupported input"), (6, "unknown output format"), (7, "no text"),
        (8, "no text"), (9, "no text"),
    ]
