"""Streams give what the batch gives."""

from conftest import rows
from pyspark.sql import functions as F

from unitflow.operators.inference import stub_translator
from unitflow.plans import corpus
from unitflow.plans.fixtures import docx_bytes, docx_paragraph
from unitflow.sources.docx import read_docx
from unitflow.streaming import documents, lines


def test_line_stream_equals_batch_and_takes_new_files(spark, tmp_path):
    folder, out, ckpt = (str(tmp_path / n) for n in ("in", "out", "ckpt"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("Hello\n\n  привет \nx\x0by\n", encoding="utf-8")

    def run():
        stream = lines.translate_stream(lines.line_stream(spark, folder), stub_translator)
        lines.start_append(stream, out, ckpt).awaitTermination()
        return rows(spark.read.parquet(out), "text", "src_lang", "translated")

    first = run()
    batch = spark.createDataFrame([(t,) for t in ("Hello", "", "  привет ", "x", "y")], "text string")
    done = lines.translate_stream(batch, stub_translator)
    assert first == rows(done, "text", "src_lang", "translated") and len(first) == 4
    (tmp_path / "in" / "b.txt").write_text("late\n", encoding="utf-8")
    assert len(run()) == 5  # only the new file is read again


def test_document_stream_equals_batch(spark, tmp_path):
    docs = spark.createDataFrame(
        [(i, f"Hello {i}\n\nпривет") for i in range(20)], "doc_id bigint, text string"
    )
    docs.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = (
        spark.readStream.schema("doc_id bigint, text string")
        .option("maxFilesPerTrigger", 1)
        .parquet(str(tmp_path / "in"))
    )
    out = str(tmp_path / "out")
    documents.watch_documents(
        stream, stub_translator, out, str(tmp_path / "ckpt")
    ).awaitTermination()
    got = spark.read.parquet(out)
    want = corpus.translate_corpus(spark, docs, stub_translator)
    assert rows(got, *want.columns) == rows(want)
    assert got.select("batch").distinct().count() > 1


def test_docx_stream_equals_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.docx").write_bytes(docx_bytes(docx_paragraph(f"Hello {i}")))
    (tmp_path / "in" / "bad.docx").write_bytes(b"broken")
    folder, out = str(tmp_path / "in"), str(tmp_path / "out")
    documents.watch_docx(
        spark, folder, stub_translator, out, str(tmp_path / "ckpt")
    ).awaitTermination()
    got = spark.read.parquet(out)
    paras = read_docx(spark, folder).filter("error is null").drop("error")
    want = corpus.translate_paras(paras, stub_translator)
    assert rows(got.filter("error is null"), *want.columns) == rows(want)
    assert got.filter(F.col("error").isNotNull()).count() == 1
