"""The folder job: records, restarts, changed files."""

import os
import time

import pytest
from conftest import rows
from test_memory import counting, seen

from unitflow.operators.inference import stub_translator
from unitflow.options import Options
from unitflow.plans import folder
from unitflow.plans.fixtures import docx_bytes, docx_paragraph
from unitflow.sources import ledger


@pytest.fixture
def source(tmp_path):
    root = tmp_path / "in"
    (root / "sub").mkdir(parents=True)
    for i in range(6):
        (root / f"{i}.docx").write_bytes(docx_bytes(docx_paragraph(f"text {i}") + docx_paragraph("shared")))
    (root / "sub" / "ru.DOCX").write_bytes(docx_bytes(docx_paragraph("привет мир")))
    (root / "bad.docx").write_bytes(b"broken")
    (root / "empty.docx").write_bytes(docx_bytes(docx_paragraph(" ")))
    (root / "note.txt").write_text("x")
    (root / "page.pdf").write_bytes(b"x")
    return root


def name(path):
    return path.rsplit("/", 1)[1]


def told(done):
    return {name(r.path): (r.status, r.src_lang, r.n_paras, r.n_units) for r in done.collect()}


def test_every_file_has_a_record(spark, source, tmp_path):
    out = str(tmp_path / "out")
    done = folder.translate_folder(spark, str(source), out, stub_translator)
    got = told(done)
    assert got["0.docx"] == ("translated", "eng_Latn", 4, 2)
    assert got["ru.DOCX"] == ("translated", "rus_Cyrl", 3, 1)
    reasons = {name(r.path): r.reason for r in done.collect() if r.status == "rejected"}
    assert reasons.pop("bad.docx").startswith("BadZipFile")
    assert reasons == {
        "empty.docx": "no text", "note.txt": "unsupported input", "page.pdf": "no reader for its pages",
    }
    texts = {name(r.doc_id): r.runs for r in folder.folder_results(spark, out).filter("para_idx = 0").collect()}
    assert texts["3.docx"] == ["[eng_Latn>uzn_Latn] text 3"] and "empty.docx" not in texts
    assert len(texts) == 7


def test_a_run_goes_on_where_one_died(spark, source, tmp_path, monkeypatch):
    out, calls = str(tmp_path / "out"), tmp_path / "calls"
    calls.mkdir()
    make, opts = counting(str(calls)), Options(dedup=False)
    commit, left = ledger.Ledger.commit, [3]

    def dies(self, where, id):
        left[0] -= 1
        if left[0] == 0:
            raise KeyboardInterrupt
        commit(self, where, id)

    with monkeypatch.context() as patch:
        patch.setattr(ledger.Ledger, "commit", dies)
        with pytest.raises(KeyboardInterrupt):
            folder.translate_folder(spark, str(source), out, make, opts, wave_files=3)
    # the refused files and one wave are recorded; the second wave is written but does not count
    before = told(folder.newest(folder.records(spark, out).read()))
    finished = [n for n, r in before.items() if r[0] == "translated"]
    assert 0 < len(before) < 11
    whole = told(folder.translate_folder(spark, str(source), out, make, opts, wave_files=3))
    assert len(whole) == 11 and {n: whole[n] for n in before} == before
    results = folder.folder_results(spark, out)
    assert results.select("doc_id", "para_idx").distinct().count() == results.count()
    assert results.select("doc_id").distinct().count() == 7
    # recorded files were not translated again
    for n in finished:
        if n[0].isdigit():
            assert seen(calls).count(f"text {n[0]}") == 1
    n = len(seen(calls))
    again = folder.translate_folder(spark, str(source), out, make, opts, wave_files=3)
    assert told(again) == whole and len(seen(calls)) == n


def test_changed_and_new_files_are_taken(spark, source, tmp_path):
    out = str(tmp_path / "out")
    folder.translate_folder(spark, str(source), out, stub_translator)
    changed = source / "0.docx"
    changed.write_bytes(docx_bytes(docx_paragraph("changed text that is longer")))
    later = time.time() + 60
    os.utime(changed, (later, later))
    (source / "new.docx").write_bytes(docx_bytes(docx_paragraph("new")))
    done = folder.translate_folder(spark, str(source), out, stub_translator)
    assert done.count() == 12
    texts = {name(r.doc_id): r.runs for r in folder.folder_results(spark, out).filter("para_idx = 0").collect()}
    assert texts["0.docx"] == ["[eng_Latn>uzn_Latn] changed text that is longer"]
    assert texts["new.docx"] and texts["1.docx"] == ["[eng_Latn>uzn_Latn] text 1"]


def test_plain_pages(spark, source, tmp_path):
    out = str(tmp_path / "out")
    folder.translate_folder(spark, str(source), out, stub_translator, Options(output_format="pdf"))
    lines = folder.folder_results(spark, out, "paginate_lines")
    assert rows(lines.filter("doc_id like '%/2.docx'"), "page_no", "y", "line") == [
        (0, 50, "[eng_Latn>uzn_Latn] text 2"), (0, 66, "[eng_Latn>uzn_Latn] shared"),
    ]
    with pytest.raises(FileNotFoundError):
        folder.folder_results(spark, out)


def test_an_empty_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    assert folder.translate_folder(spark, str(tmp_path / "in"), str(tmp_path / "out"), stub_translator).count() == 0
