"""Pages that arrive apart: whole documents, restarts, time-outs, late pages."""

import time
from types import SimpleNamespace

import pytest
from conftest import rows

from unitflow import schemas
from unitflow.operators.inference import stub_translator
from unitflow.plans.corpus import layout_to_pages
from unitflow.streaming import layouts

SCHEMA = schemas.LAYOUT + ", n_pages bigint"


def page(doc, n, of, text=None):
    span = {"text": text or f"text {doc}.{n}", "bbox": [1.0, 2.0, 3.0, 4.0], "size": None, "color": None}
    return (doc, n, [{"type": 0, "lines": [{"spans": [span]}]}], of)


@pytest.fixture
def drop(spark, tmp_path):
    """Puts pages into the stream's folder as one file."""

    def put(*pages):
        df = spark.createDataFrame(list(pages), SCHEMA)
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    return put


def run(spark, tmp_path, wait_ms=layouts.WAIT_MS, out="out"):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    layouts.watch_layouts(
        stream, stub_translator, str(tmp_path / out), str(tmp_path / "ckpt"), wait_ms=wait_ms
    ).awaitTermination()
    return spark.read.schema(
        "doc_id bigint, page bigint, part bigint, break_before boolean, n_items bigint, text string, status string, batch int"
    ).parquet(str(tmp_path / out))


def test_documents_leave_when_they_are_whole_across_a_restart(spark, tmp_path, drop):
    drop(page(1, 0, 3), page(2, 0, 1), page(3, 1, 2))
    drop(page(1, 2, 3), page(1, 2, 3))
    got = run(spark, tmp_path)
    assert rows(got.select("doc_id", "status").distinct()) == [(2, "complete")]
    # a new query from the same checkpoint knows the pages that have come
    drop(page(3, 0, 2), page(4, 0, 2))
    drop(page(1, 1, 3), page(4, 1, 2))
    got = run(spark, tmp_path)
    everything = [page(1, n, 3) for n in range(3)] + [page(2, 0, 1), page(3, 0, 2), page(3, 1, 2)]
    everything += [page(4, 0, 2), page(4, 1, 2)]
    batch = layout_to_pages(spark.createDataFrame(everything, SCHEMA).drop("n_pages"), stub_translator)
    columns = ["doc_id", "page", "part", "break_before", "n_items", "text"]
    assert rows(got, *columns) == rows(batch, *columns)
    assert rows(got.select("status").distinct()) == [("complete",)]
    # each document in one batch
    assert got.groupBy("doc_id").agg({"batch": "min"}).count() == got.select("doc_id", "batch").distinct().count()


def test_pages_that_never_come_and_late_ones(spark, tmp_path, drop):
    drop(page(1, 0, 3), page(1, 1, 3), page(5, 0, None))
    assert run(spark, tmp_path, wait_ms=1).count() == 0
    time.sleep(0.2)
    drop(page(2, 0, 1))
    got = run(spark, tmp_path, wait_ms=1)
    told = rows(got, "doc_id", "page", "status")
    assert told == [(1, 0, "timed out"), (1, 1, "timed out"), (2, 0, "complete"), (5, 0, "timed out")]
    drop(page(1, 2, 3), page(2, 0, 1))
    late = run(spark, tmp_path, wait_ms=1).filter("status = 'late'")
    assert rows(late, "doc_id", "page", "text") == [(1, 2, None), (2, 0, None)]


def test_pages_without_a_place_are_dropped(spark, tmp_path, drop):
    drop(page(None, 0, 1), page(7, None, 1), page(7, 0, 1, "x"))
    assert rows(run(spark, tmp_path), "doc_id", "page") == [(7, 0)]


class _State(dict):
    """A map or a value in place of the store's; counts what would be messages to it."""

    def __init__(self, calls):
        super().__init__()
        self.calls = calls

    def _told(name, do):
        def run(self, *args):
            self.calls.append(name)
            return do(self, *args)

        return run

    containsKey = _told("containsKey", lambda self, k: k in self)
    updateValue = _told("updateValue", lambda self, k, v: self.__setitem__(k, v))
    iterator = _told("iterator", lambda self: iter(list(self.items())))
    exists = _told("exists", lambda self: bool(self))
    get = _told("get", lambda self: dict.get(self, 0))
    update = _told("update", lambda self, v: self.__setitem__(0, v))
    clear = _told("clear", lambda self: [self.pop(k) for k in list(self)])


def _assembler():
    calls, timers = [], set()
    handle = SimpleNamespace(
        getMapState=lambda *a: _State(calls),
        getValueState=lambda *a: _State(calls),
        listTimers=lambda: list(timers),
        deleteTimer=timers.discard,
        registerTimer=timers.add,
    )
    made = layouts.PageAssembler(10, 100)
    made.init(handle)
    now = SimpleNamespace(getCurrentProcessingTimeInMs=lambda: 1)

    def batch(*given):
        given = [SimpleNamespace(page=p, layout=t, n_pages=n) for p, t, n in given]
        return sorted((r.page, r.layout, r.status) for r in made.handleInputRows((7,), iter(given), now))

    return batch, calls, timers, made


def test_a_document_that_comes_whole_is_not_put_into_state():
    """each page cost two messages to the state store, and three more to take it out again."""
    batch, calls, timers, made = _assembler()
    assert batch((0, "a", 3), (2, "c", 3), (1, "x", 3), (1, "b", 3)) == [(i, "abc"[i], "complete") for i in range(3)]
    assert calls == ["get", "exists", "update"] and not timers
    assert batch((0, "a", 3)) == [(0, "a", "late")]


@pytest.mark.parametrize("held", [2, 1024])
def test_pages_that_come_apart_leave_together(monkeypatch, held):
    monkeypatch.setattr(layouts, "HELD_PAGES", held)
    batch, calls, timers, made = _assembler()
    assert batch((0, "a", None), (1, "b", None), (0, "A", 5), (3, "d", 5)) == [] and len(timers) == 1
    # a page that comes again is no new one
    assert batch((3, "D", 5), (0, "a", 5)) == []
    calls.clear()
    assert batch((4, "e", 5), (2, "c", 5), (1, "B", 5)) == [(i, "aBcDe"[i], "complete") for i in range(5)]
    assert not timers and not made.pages and not made.count
    assert held == 2 or calls == ["get", "iterator", "update", "clear", "clear"]
