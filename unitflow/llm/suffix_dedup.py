"""Removal of byte strings that an earlier document has, over a logarithmic family of suffix arrays.

A full suffix array with the context to sort it would be fifty times the corpus. The arrays here are
sparse and hold fingerprints: of each 50-byte string the 20-byte substring with the least hash is its
anchor, the starts of neighbouring strings with the same anchor are one segment, and a suffix is
sampled at each segment, about one in sixteen bytes. Equal strings have equal anchors, so no match is lost:

1. Each batch of documents, in ascending ``doc_id`` and as large as all before it, becomes an array of (anchor, segment hash,
   doc, place), sorted by the first three. It is merge-scanned with the levels: a segment that an
   earlier document has whole is removed whole. What is new becomes a level; equal levels merge, and
   the scan that reads them writes what they become.
2. Segments with a common anchor and different content match in part or not at all. Only there are the
   50-byte strings compared one by one, for each distinct content once, at every place that the first document has it.
   They are dealt in blocks, by the 47 bytes that the block's strings share, not by anchor, so that one very common
   anchor is no group of its strings. Only blocks that two documents have give a row for each string.

Anchors are dealt to ``slices`` that are handled one after another, arrays and strings alike, so what is on disk
at one time is a fraction of all. Anchors and segments are rolling 64-bit hashes from one pass of numpy over the
bytes; a match needs an equal anchor and an equal segment (or string) hash. Copies inside an
Arrow batch are settled before any shuffle, so a passage that a third of the documents share sends a row for
each batch, not for each document. Joins are equi-joins or semi-joins of two shuffled sides.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.llm.common import id_of, text_of
from unitflow.llm.runs import LevelledRuns, ascending
from unitflow.session import discard, materialise

LENGTH = 50
ANCHOR = 20
#: shares of the documents. A scan reads all that came before, so batches that double cost under two scans of the corpus,
#: however many they are. With two runs a level, four are the least with which levels merge and lie beside each other
BATCHES = (1, 1, 2, 4)
FANOUT = 2
SLICES = 2
PIECE = 1 << 17  # bytes hashed at a time; eight bytes for each stay in a core's cache
MAX_SEGMENT = 64  # string starts in a segment; longer ones (of one repeated byte, say) are cut
STEP = 9_000  # segments whose strings are hashed at a time
BLOCK = 4  # strings of a block at most; what very many documents share comes to one task that many times

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(2025).integers(1, 2**63, 256).astype(np.uint64)
#: place = start * 64 + n - 1: where the segment starts, and how many string starts it has
_SEGMENT = "anchor long, seg long, doc long, version long, place long"
_STRING = (
    "anchor long, doc long, version long, start long, more array<long>, strings array<long>, "
    "blocks array<struct<seg: long, nth: long, n: long>>"
)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class _Hasher:
    """Rolling hashes of any substring of a byte array."""

    def __init__(self):
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def load(self, data: np.ndarray) -> None:
        if len(self.up) <= len(data):
            self.up = _powers(_BASE, len(data) + 1)
            self.down = _powers(_INVERSE, len(data) + 1)
        self.sums = np.zeros(len(data) + 1, dtype=np.uint64)
        terms = _BYTE[data]
        terms *= self.up[: len(data)]
        np.cumsum(terms, out=self.sums[1:])

    def every(self, length: int) -> np.ndarray:
        n = len(self.sums) - length
        h = (self.sums[length:] - self.sums[:n]) * self.down[:n]
        h ^= h >> np.uint64(32)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        return h

    def some(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return _mix((self.sums[high] - self.sums[low]) * self.down[low] + np.uint64(1))


def _least(h: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        h = np.minimum(h[: len(h) - step], h[step:])
        done += step
    return h


def _pieces(lengths: np.ndarray, length: int) -> Iterator[list[tuple[int, int, int]]]:
    """(row, from, to) parts of texts, together about PIECE bytes; parts of a text overlap by length - 1."""
    out, held = [], 0
    for row, size in enumerate(lengths):
        low = 0
        while size - low >= length:
            high = min(size, low + PIECE)
            out.append((row, low, high))
            held += high - low
            if held >= PIECE:
                yield out
                out, held = [], 0
            if high == size:
                break
            low = high - length + 1
    if out:
        yield out


def _hashed(texts: list[bytes], length: int, hasher: _Hasher, anchor: int):
    """For each group of pieces: anchors, which places are string starts, and the pieces' places.

    Gives (anchors, starts, low, row, offset): ``anchors`` and ``starts`` by byte, and for each piece its first
    byte, its text and its offset there.
    """
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    for parts in _pieces(lengths, length):
        data = np.frombuffer(b"".join(texts[r][a:b] for r, a, b in parts), dtype=np.uint8)
        hasher.load(data)
        anchors = _least(hasher.every(anchor), length - anchor + 1)
        high = np.cumsum([b - a for _, a, b in parts])
        starts = np.ones(len(data), dtype=bool)
        starts[(high[:, None] - np.arange(1, length)).ravel()] = False
        row, offset, _ = np.array(parts).T
        yield anchors, starts[: len(anchors)], np.append(0, high[:-1]), row, offset


def _segments(texts: list[bytes], length: int, hasher: _Hasher, anchor: int, slice_: int, slices: int):
    """Arrays row, start, n, anchor, hash of the segments of a slice."""
    found = []
    for anchors, starts, low, row, offset in _hashed(texts, length, hasher, anchor):
        same = (anchors[1:] == anchors[:-1]) & starts[1:] & starts[:-1]
        first = np.nonzero(starts & np.append(True, ~same))[0]
        n = np.nonzero(starts & np.append(~same, True))[0] - first + 1
        if slices > 1:
            own = (anchors[first] >> np.uint64(17)) % np.uint64(slices) == slice_
            first, n = first[own], n[own]
        if not len(first):
            continue
        if n.max() > MAX_SEGMENT:
            cuts = -(-n // MAX_SEGMENT)
            nth = np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts)
            ends = np.repeat(first + n, cuts)
            first = np.repeat(first, cuts) + nth * MAX_SEGMENT
            n = np.minimum(ends - first, MAX_SEGMENT)
        part = np.searchsorted(low, first, "right") - 1
        content = hasher.some(first, first + n + length - 1)
        found.append((row[part], first - low[part] + offset[part], n, anchors[first], content))
    if not found:
        return None
    return [np.concatenate(x) for x in zip(*found, strict=True)]


def _settled(doc: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Whether a smaller document of the same batch has the same segment."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    head = np.ones(len(order), dtype=bool)
    head[1:] = k[1:] != k[:-1]
    least = np.minimum.reduceat(d, np.nonzero(head)[0])[np.cumsum(head) - 1]
    out = np.empty(len(order), dtype=bool)
    out[order] = least < d
    return out


def _raw(column: pa.Array) -> list[bytes]:
    return column.cast(pa.binary()).to_pylist()


def _emit(columns: dict, step: int = 200_000) -> Iterator[pa.RecordBatch]:
    table = pa.table({k: v if isinstance(v, pa.Array) else pa.array(v) for k, v in columns.items()})
    yield from table.to_batches(max_chunksize=step)


def segments(
    docs: DataFrame, length: int, slice_: int = 0, slices: int = 1, anchor: int = ANCHOR
) -> DataFrame:
    """The sparse suffix array of (doc, version, text) for the anchors of a slice, unsorted.

    A segment that a smaller document of the same Arrow batch has is settled: it needs no scan. Its ``seg`` is
    null and its ``anchor`` a hash of its place, so that settled rows do not gather at a hot anchor.
    """

    def run(batches):
        hasher = _Hasher()
        for batch in batches:
            texts = _raw(batch.column("text"))
            found = _segments(texts, length, hasher, anchor, slice_, slices)
            if found is None:
                continue
            row, start, n, key, seg = found
            doc = batch.column("doc").to_numpy()[row]
            done = _settled(doc, key ^ (seg * np.uint64(_BASE)))
            place = start * MAX_SEGMENT + n - 1
            away = _mix(doc.astype(np.uint64) * np.uint64(_BASE) + place.astype(np.uint64))
            yield from _emit(
                {
                    "anchor": np.where(done, away, key).view(np.int64),
                    "seg": pa.array(seg.view(np.int64), mask=done),
                    "doc": doc,
                    "version": batch.column("version").to_numpy()[row],
                    "place": place,
                }
            )

    return docs.mapInArrow(run, _SEGMENT)


def _places(places: list[int] | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and counts."""
    at = np.array(places, dtype=np.int64)
    return at // MAX_SEGMENT, at % MAX_SEGMENT + 1


def _runs(places: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """First start and end of each run of neighbouring starts, in order."""
    start, n = _places(sorted(places))
    end = np.maximum.accumulate(start + n)
    head = np.append(True, start[1:] > end[:-1])
    return start[head], end[np.append(head[1:], True)]


def _lists(lengths: np.ndarray, values: np.ndarray | pa.Array) -> pa.ListArray:
    """Lists of these lengths, null where there is nothing."""
    ends = pa.array(np.append(0, np.cumsum(lengths)), pa.int32())
    values = values if isinstance(values, pa.Array) else pa.array(values, pa.int64())
    return pa.ListArray.from_arrays(ends, values, mask=pa.array(lengths == 0))


def _blocks(hasher: _Hasher, at: np.ndarray, new: np.ndarray, anchors: np.ndarray, length: int):
    """Arrays first, n, hash of the blocks of strings that start at ``at``, segment after segment.

    ``new``: which strings begin a segment; ``anchors``: the anchor at each byte. A string's offset is where it has its
    anchor first, so equal strings have equal offsets. A block's strings have one anchor place and neighbouring
    offsets, from a multiple of the width; its hash is of the bytes that strings of all its offsets have there.
    """
    width = min(BLOCK, length - ANCHOR + 1)
    h = hasher.every(ANCHOR)
    place = np.where(h == anchors[: len(h)], np.arange(len(h)), len(anchors))
    place = np.minimum.accumulate(place[::-1])[::-1]
    offset = place[at] - at
    offset[offset > length - ANCHOR] = 0  # no anchor of this text: each string is its own block
    block = offset // width
    cut = new.copy()
    cut[1:] |= (offset[1:] + 1 != offset[:-1]) | (block[1:] != block[:-1])
    first = np.nonzero(cut)[0]
    low = at[first] + offset[first] - block[first] * width
    return first, np.diff(np.append(first, len(at))), hasher.some(low, low + length - width + 1)


def strings(docs: DataFrame, length: int = LENGTH, step: int = STEP) -> DataFrame:
    """(anchor, doc, version, start, more, strings, blocks) of the segments ``parts``, (anchor, place).

    ``strings`` are the hashes of a segment's strings, ``blocks`` the n of them from the nth that are dealt together by
    ``seg``, a hash of what they share. A text's equal segments are one row for each ``step`` places, the others'
    distances from ``start`` in ``more``: a segment that a document repeats very often is no group of its places.
    """

    def run(batches):
        hasher = _Hasher()
        for batch in batches:
            texts, parts = _raw(batch.column("text")), batch.column("parts")
            rows = np.repeat(np.arange(len(texts)), parts.value_lengths().to_numpy())
            anchors, places = (parts.flatten().field(name).to_numpy() for name in ("anchor", "place"))
            docs_, versions = batch.column("doc").to_numpy(), batch.column("version").to_numpy()
            for low in range(0, len(rows), step):
                row, (start, n) = rows[low : low + step], _places(places[low : low + step])
                size = n + length - 1
                cut = [texts[r][a : a + k] for r, a, k in zip(row.tolist(), start.tolist(), size.tolist(), strict=True)]
                hasher.load(np.frombuffer(b"".join(cut), dtype=np.uint8))
                base = np.cumsum(size) - size
                content = hasher.some(base, base + size)
                order = np.lexsort((content, row))
                r, c = row[order], content[order]
                first = np.nonzero(np.append(True, (c[1:] != c[:-1]) | (r[1:] != r[:-1])))[0]
                head, copies = order[first], np.diff(np.append(first, len(order)))
                more = start[order] - np.repeat(start[head], copies)
                n = n[head]
                ends = np.cumsum(n)
                at = np.repeat(base[head] - ends + n, n) + np.arange(n.sum())
                new = np.zeros(len(at), dtype=bool)
                new[ends - n] = True
                own = np.repeat(anchors[low : low + step].view(np.uint64), size)
                block, held, core = _blocks(hasher, at, new, own, length)
                of = np.searchsorted(ends, block, "right")
                nth = block - (ends - n)[of]
                shared = [pa.array(x) for x in (core.view(np.int64), nth, held)]
                yield from _emit(
                    {
                        "anchor": anchors[low + head],
                        "doc": docs_[row[head]],
                        "version": versions[row[head]],
                        "start": start[head],
                        "more": _lists(copies - 1, np.delete(more, first)),
                        "strings": _lists(n, hasher.some(at, at + length).view(np.int64)),
                        "blocks": _lists(
                            np.bincount(of, minlength=len(n)), pa.StructArray.from_arrays(shared, ["seg", "nth", "n"])
                        ),
                    },
                    step=20_000,
                )

    return docs.mapInArrow(run, _STRING)


#: how tables of hashes are written: they hardly repeat and hardly shrink, so a dictionary and hard work are lost
HASHES = {"parquet.enable.dictionary": "false", "parquet.compression.codec.zstd.level": "1"}
_KEY = ["anchor", "seg"]
_PLACE = ["doc", "version", "place"]
GONE, DOUBT, LIVE = 1, 2, 4  # bits of a row's kind
BATCH, LEVEL, MERGED = 0, 1, 2  # where a row is from; runs that are merged are levels too


def _add_batch(levels: LevelledRuns, array: DataFrame, last: bool) -> DataFrame:
    """Merge-scan a batch's array with the levels and add what is new as a level, with the levels it merges with.

    Gives a table of places by kind: what is ``GONE``, in ``DOUBT`` the segments of the batch or of a level
    whose anchor has other content as well, and ``LIVE`` the rows of the level. After the ``last`` batch nothing is added.
    """
    merged, level = ([], 0) if last else levels.due()
    rows = array.withColumn("from", F.lit(BATCH))
    for path, run in levels.named():
        rows = rows.unionByName(run.drop("kind").withColumn("from", F.lit(MERGED if path in merged else LEVEL)))
    rows = rows.repartition("anchor").sortWithinPartitions("anchor", "seg", "doc")
    anchor, segment = Window.partitionBy("anchor"), Window.partitionBy(*_KEY).orderBy("doc")
    differs = lambda name: F.min(name).over(anchor) < F.max(name).over(anchor)
    scanned = rows.withColumn(
        "mixed", differs("seg") & differs("doc") & (F.min("from").over(anchor) == BATCH)
    ).withColumns(
        {
            "nth": F.row_number().over(segment),
            "first": F.first("doc").over(segment.rowsBetween(Window.unboundedPreceding, Window.currentRow)),
        }
    )
    settled = F.col("seg").isNull()
    own = (F.col("first") == F.col("doc")) & ~settled  # every place in the first document, in all its texts
    head = own & (F.col("nth") == 1)
    fresh = F.col("from") == BATCH
    bit = lambda found, kind: F.when(found, kind).otherwise(0)
    kind = bit(fresh & (settled | (F.col("first") < F.col("doc"))), GONE) + bit(own & F.col("mixed"), DOUBT)
    if not last:
        kind = kind + bit((head & fresh) | (F.col("from") == MERGED), LIVE)
    found = scanned.select(*_KEY, *_PLACE, kind.alias("kind")).where("kind > 0")
    done = materialise(found, "suffix-run", options=HASHES)
    if not last:
        levels.lend(done, level, merged)
    return done


def _of(kind: int, tables: list[DataFrame], *columns: str) -> DataFrame:
    return reduce(DataFrame.union, (t.where(F.col("kind").bitwiseAND(kind) > 0).select(*columns) for t in tables))


def _grouped(places: DataFrame, part: Column) -> DataFrame:
    """The places of each text; never more than the text has."""
    return places.groupBy("doc", "version").agg(F.collect_set(part).alias("parts"))


def _compared(docs: DataFrame, doubt: DataFrame, length: int) -> DataFrame:
    """Places of the strings in ``doubt`` that a smaller document has."""
    # each distinct content once, so a string that very many documents share is not a group of theirs
    parts = _grouped(doubt, F.struct("anchor", "place"))
    found = strings(docs.join(parts, ["doc", "version"]), length)
    block = found.select("anchor", "doc", "version", "start", "more", "strings", F.explode("blocks").alias("of")).select(
        *("anchor", "of.seg", "doc", "version", "more"),
        (F.col("start") + F.col("of.nth")).alias("start"),
        F.slice("strings", (F.col("of.nth") + 1).cast("int"), F.col("of.n").cast("int")).alias("strings"),
    )
    # sorted by the block first: very many have one anchor, and a sort compares its first column at once
    together = Window.partitionBy("seg", "anchor")
    met = block.withColumns({"least": F.min("doc").over(together), "most": F.max("doc").over(together)})
    one_by_one = met.where("least < most").select(
        *_KEY, "doc", "version", "start", "more", F.posexplode("strings").alias("nth", "string")
    )
    place = ((F.col("start") + F.col("nth")) * MAX_SEGMENT).alias("place")
    same = Window.partitionBy("seg", "anchor", "string")  # dealt as blocks are
    again = (
        one_by_one.select(*_KEY, "string", "doc", "version", place, "more")
        .withColumn("first", F.min("doc").over(same))
        .where("first < doc")
    )
    others = F.transform("more", lambda away: F.col("place") + away * MAX_SEGMENT)
    every = F.concat(F.array("place"), F.coalesce(others, F.array().cast("array<long>")))
    return again.select("doc", "version", F.explode(every).alias("place"))


def repeated_strings(
    docs: DataFrame,
    length: int = LENGTH,
    batches: int | Sequence[int] = BATCHES,
    fanout: int = FANOUT,
    slices: int = SLICES,
) -> DataFrame:
    """(doc, version, parts): starts of ``length``-byte strings that a smaller ``doc`` has, by text.

    ``docs``: doc, version, text. ``parts`` are places: each names n neighbouring starts (``_places``), and they
    may overlap. ``batches``: how many of equal size, or their shares. The result is a written table; all others are
    deleted when it is there.
    """
    places = []
    for k in range(slices):
        levels = LevelledRuns(docs.sparkSession, _KEY, fanout, f"kind & {LIVE} > 0")
        parts, own = list(ascending(docs, batches, F.col("doc"))), []
        for i, batch in enumerate(parts):
            array = segments(batch, length, k, slices)
            own.append(_add_batch(levels, array, last=i == len(parts) - 1))
        levels.drop()
        again = _compared(docs, _of(DOUBT, own, "anchor", *_PLACE), length)
        places.append(materialise(_grouped(again.union(_of(GONE, own, *_PLACE)), F.col("place")), "places"))
        discard(*own)
    if slices == 1:
        return places[0]
    every = reduce(DataFrame.union, places).groupBy("doc", "version")
    found = materialise(every.agg(F.flatten(F.collect_list("parts")).alias("parts")), "repeats")
    discard(*places)
    return found


def _removed(length: int):
    def cover(texts, parts):
        for text, own in zip(texts, parts, strict=True):
            mark = np.zeros(len(text) + 1, dtype=np.int32)
            if own:
                start, end = _runs(own)  # no two of them begin or end together
                mark[start] += 1
                mark[end + length - 1] -= 1
            gone = np.cumsum(mark[:-1]) > 0
            spans = int((gone & ~np.concatenate(([False], gone[:-1]))).sum())
            kept = np.frombuffer(text, dtype=np.uint8)[~gone].tobytes()
            yield len(text), int(gone.sum()), spans, kept

    def run(batches):
        for batch in batches:
            rows = list(cover(_raw(batch.column("text")), batch.column("parts").to_pylist()))
            n, removed, spans, kept = zip(*rows, strict=True) if rows else ([],) * 4
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    pa.array(removed, pa.int64()),
                    pa.array(spans, pa.int64()),
                    pa.array(kept, pa.binary()),
                ],
                ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"],
            )

    return run


def remove_repeats(
    docs: DataFrame,
    length: int = LENGTH,
    batches: int | Sequence[int] = BATCHES,
    fanout: int = FANOUT,
    slices: int = SLICES,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept) of each row of ``docs``; ``kept`` is binary.

    Every byte that a ``length``-byte string covers goes if that string also starts in a document with a
    smaller ``doc_id``; strings are those of the input and never cross documents. What is left is bytes: a
    cut may fall inside a character. Null and empty texts have no bytes, rows with one id do not remove
    each other's strings, a null id is the last one, other columns are not looked at, and an empty
    table gives none.
    """
    if length <= ANCHOR:
        raise ValueError(f"length must be over {ANCHOR}")
    plain = docs.select("doc_id", id_of().alias("doc"), text_of().alias("text"))
    repeated = materialise(plain.groupBy("doc").count().where("count > 1").select("doc"), "repeated")
    # only where an id has several texts does a hash tell them apart
    marked = plain.join(repeated.withColumn("again", F.lit(True)), "doc", "left")
    rows = marked.select(
        "doc_id", "doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(0).alias("version"), "text"
    )
    parts = repeated_strings(rows.select("doc", "version", "text"), length, batches, fanout, slices)
    return (
        rows.join(parts, ["doc", "version"], "left")
        .select("doc_id", "text", "parts")
        .mapInArrow(
            _removed(length),
            "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary",
        )
    )


