"""A stream of page layouts whose pages arrive apart.

A document can be voted and assembled only when all its pages are there, and they come in any order, over many
micro-batches. Pages wait in keyed state: a map from page to layout, so state grows page by page and no page is read
again until the document may be whole. Then its pages leave together, and the batch job runs on them; pages that come
with the last one are never put into state, as every call to it is a message to the JVM. A timer ends the
wait for pages that never come; what comes after the document has left is passed on as late, not assembled.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from unitflow import schemas
from unitflow.operators.inference import Factory
from unitflow.options import Options
from unitflow.plans.corpus import layout_to_pages
from unitflow.session import materialise, scratch

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
EMPTY_BATCHES = "spark.sql.streaming.noDataMicroBatches.enabled"

COMPLETE, TIMED_OUT, LATE = "complete", "timed out", "late"
WAIT_MS = 10 * 60 * 1000
HELD_PAGES = 1024  # most pages of a document outside its state
REMEMBER_MS = 24 * 60 * 60 * 1000  # how long a document that has left is known, so that its late pages are told

PAGE = "doc_id bigint, page bigint, layout string, n_pages bigint, status string"
_Page = Row("doc_id", "page", "layout", "n_pages", "status")


class PageAssembler(StatefulProcessor):
    """Holds the pages of one document until all ``n_pages`` have come, or ``wait_ms`` after the first."""

    def __init__(self, wait_ms: int, remember_ms: int):
        self.wait_ms, self.remember_ms = wait_ms, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pages = handle.getMapState("pages", "page bigint", "layout string")
        self.count = handle.getValueState("count", "n_pages bigint, come bigint")
        self.left = handle.getValueState("left", "status string", self.remember_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        (doc,) = key
        count = self.count.get()
        # a document that waits has not left
        if count is None and self.left.exists():
            for row in rows:
                yield _Page(doc, row.page, row.layout, row.n_pages, LATE)
            return
        n_pages, come = count or (0, 0)
        first, arrived = come == 0, {}
        for row in rows:
            # a page that comes again replaces itself
            arrived[row.page] = row.layout
            n_pages = max(n_pages, row.n_pages or 0)
            if len(arrived) == HELD_PAGES:
                come += self._keep(arrived, come)
                arrived = {}
        if come + len(arrived) >= n_pages > 0:
            if 0 < come <= HELD_PAGES:
                arrived = {page: layout for (page,), (layout,) in self.pages.iterator()} | arrived
                there, inside = len(arrived), 0
            else:
                there, inside = come + self._new(arrived, come), come
            if there >= n_pages:
                for timer in [] if first else list(self.handle.listTimers()):
                    self.handle.deleteTimer(timer)
                yield from self._leave(doc, n_pages, COMPLETE, arrived, inside)
                if come:
                    self._forget()
                return
        come += self._keep(arrived, come)
        self.count.update((n_pages, come))
        if first:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait_ms)

    def _new(self, arrived: dict, come: int) -> int:
        """How many pages the state, which has ``come`` pages, does not have."""
        return sum(not come or not self.pages.containsKey((page,)) for page in arrived)

    def _keep(self, arrived: dict, come: int) -> int:
        """Put pages into state, which has ``come`` pages; gives how many it did not have."""
        new = self._new(arrived, come)
        for page, layout in arrived.items():
            self.pages.updateValue((page,), (layout,))
        return new

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.count.exists():
            n_pages, come = self.count.get()
            yield from self._leave(key[0], n_pages, TIMED_OUT, {}, come)
            self._forget()

    def _leave(self, doc: int, n_pages: int, status: str, arrived: dict, inside: int) -> Iterator[Row]:
        """The pages at hand, and those of the state where they are not at hand, ``inside`` in number."""
        if inside:
            for (page,), (layout,) in self.pages.iterator():
                if page not in arrived:
                    yield _Page(doc, page, layout, n_pages, status)
        for page, layout in arrived.items():
            yield _Page(doc, page, layout, n_pages, status)
        self.left.update((status,))

    def _forget(self) -> None:
        self.pages.clear()
        self.count.clear()

    def close(self) -> None:
        pass


def whole_documents(
    pages: DataFrame, wait_ms: int = WAIT_MS, remember_ms: int = REMEMBER_MS
) -> DataFrame:
    """(doc_id, page, blocks, n_pages, status) of a stream of (doc_id, page, blocks, n_pages).

    All pages of a document leave in one micro-batch, as ``complete`` or, when not all have come in time, as ``timed
    out``; pages that come after that are ``late``. ``n_pages`` may be null while it is not known; pages without a
    document's id or a number are dropped, as they have no place.
    """
    given = pages.where("doc_id is not null and page is not null").select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("page").cast("bigint").alias("page"),
        F.to_json("blocks").alias("layout"),
        F.col("n_pages").cast("bigint").alias("n_pages"),
    )
    left = given.groupBy("doc_id").transformWithState(
        statefulProcessor=PageAssembler(wait_ms, remember_ms),
        outputStructType=PAGE,
        outputMode="Append",
        timeMode="processingTime",
    )
    blocks = F.from_json("layout", schemas.BLOCKS).alias("blocks")
    return left.select("doc_id", "page", blocks, "n_pages", "status")


def watch_layouts(
    pages: DataFrame,
    make_translator: Factory,
    out: str,
    checkpoint: str,
    opts: Options = Options(),
    wait_ms: int = WAIT_MS,
    once: bool = True,
    pace: str = "10 seconds",
) -> StreamingQuery:
    """Translate a stream of (doc_id, page, blocks, n_pages) into flowing pages under ``out``, document by document.

    Rows have the document's ``status``; late pages come with a null text. State lies in RocksDB, on the executors'
    disks and in the checkpoint, so documents in waiting may be more than memory holds. A batch writes a folder of its
    own and overwrites it when it is run again after a failure. With ``once`` the query ends when it has read what is
    there, and what is due is told in the next run; otherwise batches without new pages run too, for the timers' sake.
    """
    spark = pages.sparkSession

    def run(batch: DataFrame, batch_id: int) -> None:
        with scratch():
            rows = materialise(batch, "whole-documents")
            ready = rows.filter(F.col("status") != LATE)
            done = layout_to_pages(
                ready.select("doc_id", "page", "blocks"), make_translator, opts, batch=f"{checkpoint}#{batch_id}"
            )
            told = done.join(ready.select("doc_id", "status").distinct(), "doc_id")
            late = rows.filter(F.col("status") == LATE).select("doc_id", "page", "status")
            told.unionByName(late, allowMissingColumns=True).write.mode("overwrite").parquet(
                f"{out}/batch={batch_id}"
            )

    writer = whole_documents(pages, wait_ms).writeStream.foreachBatch(run).outputMode("append")
    writer = writer.option("checkpointLocation", checkpoint)
    # a query takes its settings along when it starts
    before = spark.conf.get(EMPTY_BATCHES, "true")
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(EMPTY_BATCHES, str(not once).lower())
    try:
        return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=pace)).start()
    finally:
        spark.conf.set(EMPTY_BATCHES, before)
