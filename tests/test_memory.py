"""Ledger and translation memory: commits, replays, runs that die."""

import os

import pytest
from conftest import rows

from unitflow.operators import inference, memory
from unitflow.options import Options
from unitflow.plans import corpus
from unitflow.sources import ledger
from unitflow.streaming import documents

SCHEMA = "k bigint, v string"


def counting(folder):
    """A translator that leaves one line for every text it is given."""

    def make(options):
        def fn(texts, source, target):
            with open(os.path.join(folder, f"{os.getpid()}.log"), "a", encoding="utf-8") as log:
                log.writelines(f"{t}\n" for t in texts)
            return [f"<{t}>" for t in texts]

        return fn

    return make


def seen(folder):
    out = []
    for name in os.listdir(folder):
        with open(os.path.join(folder, name), encoding="utf-8") as log:
            out += log.read().splitlines()
    return sorted(out)


@pytest.fixture
def book(spark, tmp_path):
    schema = spark.createDataFrame([], SCHEMA).schema
    return ledger.Ledger(spark, str(tmp_path / "book"), schema)


def table(spark, *ks):
    return spark.createDataFrame([(k, f"v{k}") for k in ks], SCHEMA)


def test_rows_count_when_they_are_committed(spark, book):
    assert book.read().count() == 0 and book.ids() == set()
    lost = book.stage(table(spark, 9))
    book.commit(book.stage(table(spark, 1, 2)), "a")
    book.commit(None, "b")
    assert rows(book.read(), "k") == [(1,), (2,)] and book.ids() == {"a", "b"}
    assert rows(book.read_of("a"), "k") == [(1,), (2,)] and book.read_of("b").count() == 0
    with pytest.raises(ValueError, match="committed already"):
        book.commit(lost, "a")
    assert book.sweep() == 1
    assert rows(book.read(), "k") == [(1,), (2,)]


def test_compaction_keeps_rows_and_ids(spark, book):
    for i in range(3):
        book.commit(book.stage(table(spark, i)), f"b{i}")
    before = book.read()
    book.compact()
    assert len(book.commits()) == 1 and book.ids() == {"b0", "b1", "b2"}
    assert rows(before, "k") == rows(book.read(), "k") == [(0,), (1,), (2,)]  # a reader of before is not cut off
    book.commit(book.stage(table(spark, 7)), "b3")
    assert book.sweep() == 6  # three folders, three commits
    assert rows(book.read(), "k") == [(0,), (1,), (2,), (7,)]


def test_two_writers_do_not_both_commit(spark, book, monkeypatch):
    book.commit(book.stage(table(spark, 1)), "a")
    monkeypatch.setattr(book, "commits", lambda: [])
    with pytest.raises(RuntimeError, match="another writer"):
        book.commit(None, "b")


def units(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "unit_idx bigint, text string")


def test_known_texts_never_reach_the_model(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    opts = Options(memory=str(tmp_path / "memory"))
    make = counting(str(calls))

    def run(*texts, batch):
        done = inference.translate_units(units(spark, *texts), make, opts, batch=batch)
        return [r.translated for r in done.sort("unit_idx").collect()]

    assert run("a", "b", " a ", "", None, batch="0") == ["<a>", "<b>", "<a>", "", ""]
    assert seen(calls) == ["a", "b"]
    assert run("b", "c", "привет", batch="1") == ["<b>", "<c>", "<привет>"]
    assert seen(calls) == ["a", "b", "c", "привет"]
    # the same batch again, and a run without a new text
    assert run("b", "c", "привет", batch="1") == ["<b>", "<c>", "<привет>"]
    assert run("a", "c", batch="2") == ["<a>", "<c>"]
    assert seen(calls) == ["a", "b", "c", "привет"]
    held = memory.TranslationMemory(spark, opts.memory, opts)
    assert held.known().count() == 4 and held.ledger.ids() == {"0", "1"}
    # another target knows nothing of it
    other = Options(memory=opts.memory, target="kaa_Latn")
    inference.translate_units(units(spark, "a"), make, other).collect()
    assert seen(calls).count("a") == 2


def test_a_run_that_died_before_its_commit_is_run_again(spark, tmp_path, monkeypatch):
    opts = Options(memory=str(tmp_path / "memory"))
    make = inference.stub_translator

    def die(self, folder, id):
        raise KeyboardInterrupt

    with monkeypatch.context() as patch:
        patch.setattr(ledger.Ledger, "commit", die)
        with pytest.raises(KeyboardInterrupt):
            inference.translate_units(units(spark, "a", "b"), make, opts, batch="0")
    held = memory.TranslationMemory(spark, opts.memory, opts)
    assert held.known().count() == 0
    done = inference.translate_units(units(spark, "a", "b"), make, opts, batch="0")
    assert done.count() == 2 and held.known().count() == 2
    assert held.ledger.sweep() == 1 and held.known().count() == 2


def test_failed_texts_are_tried_again(spark, tmp_path):
    state = {"bad": "b"}

    def make(options):
        bad = state["bad"]

        def fn(texts, source, target):
            if bad in texts:
                raise RuntimeError("no")
            return [t.upper() for t in texts]

        return fn

    opts = Options(memory=str(tmp_path / "memory"), on_error="row", split_chars=50)
    first = inference.translate_units(units(spark, "a", "b"), make, opts).sort("unit_idx").collect()
    assert [(r.translated, r.error) for r in first] == [("A", None), ("", "RuntimeError: no")]
    state["bad"] = "none"
    again = inference.translate_units(units(spark, "a", "b"), make, opts).sort("unit_idx").collect()
    assert [(r.translated, r.error, r.n_segments) for r in again] == [("A", None, 1), ("B", None, 1)]


def test_many_batches_are_compacted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(memory, "COMPACT_AT", 3)
    opts = Options(memory=str(tmp_path / "memory"))
    for i in range(5):
        inference.translate_units(units(spark, f"t{i}", "t0"), inference.stub_translator, opts, batch=str(i))
    held = memory.TranslationMemory(spark, opts.memory, opts)
    assert len(held.ledger.commits()) < 4 and held.known().count() == 5
    assert held.known().select("_key").distinct().count() == 5
    assert held.ledger.ids() == {"0", "1", "2", "3", "4"}


def test_a_stream_remembers_across_batches_and_replays(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    docs = [(0, "one\ntwo"), (1, "two\nthree"), (2, "one\nthree"), (3, " ")]
    for i, doc in enumerate(docs):
        spark.createDataFrame([doc], "doc_id bigint, text string").coalesce(1).write.parquet(
            str(tmp_path / "in" / str(i))
        )
    opts = Options(memory=str(tmp_path / "memory"))

    def run(out):
        stream = (
            spark.readStream.schema("doc_id bigint, text string")
            .option("maxFilesPerTrigger", 1)
            .option("recursiveFileLookup", "true")
            .parquet(str(tmp_path / "in"))
        )
        documents.watch_documents(
            stream, counting(str(calls)), str(tmp_path / out), str(tmp_path / f"{out}-ckpt"), opts
        ).awaitTermination()
        return rows(spark.read.parquet(str(tmp_path / out)), "doc_id", "text")

    first = run("first")
    assert [t for _, t in first] == ["<one>\n<two>", "<two>\n<three>", "<one>\n<three>"]
    assert seen(calls) == ["one", "three", "two"]
    assert run("second") == first and seen(calls) == ["one", "three", "two"]


def test_outcomes_have_a_row_for_every_document(spark):
    docs = spark.createDataFrame(
        [(0, "Hello\nthere"), (1, None), (2, " \n\t"), (3, "привет"), (4, "a\n" * 9)], "doc_id bigint, text string"
    )
    opts = Options(part_units=4)
    done = corpus.translate_corpus(spark, docs, inference.stub_translator, opts)
    got = rows(corpus.document_outcomes(docs, done, opts))
    assert got == [
        (0, "eng_Latn", 1, None),
        (1, None, 0, "no text"),
        (2, None, 0, "no text"),
        (3, "rus_Cyrl", 1, None),
        (4, "eng_Latn", 3, None),
    ]


def test_paragraphs_are_parsed_once(spark, tmp_path):
    log = tmp_path / "log"
    log.mkdir()

    def parse(batches):
        for batch in batches:
            for k in batch.column("doc_id").to_pylist():
                with open(os.path.join(str(log), f"{os.getpid()}"), "a") as out:
                    out.write(f"{k}\n")
            yield batch

    paras = spark.createDataFrame(
        [(i, 0, "body", ["Hello ", f"{i}"]) for i in range(6)],
        "doc_id bigint, para_idx bigint, loc string, runs array<string>",
    )
    scanned = paras.mapInArrow(parse, paras.schema)
    done = corpus.translate_paras(scanned, inference.stub_translator)
    assert done.count() == 6
    assert seen(log) == [str(i) for i in range(6)]
