"""Token ids in seekable files: one zstandard frame for each document, then a seek table.

A file is: the frames, in ascending ``doc_id``; a skippable frame with the documents' ids and the end of the
magic number that marks it; a skippable frame in zstandard's public seekable format, with compressed size,
decompressed size and a checksum of each frame. Any zstandard tool can read the frames, and a reader that
wants some documents reads the two trailing frames and then only theirs.

Writing is one range shuffle by ``doc_id``; each task streams its documents into files of bounded size. A file
counts once it is in the manifest, which Spark commits, so files of lost or repeated tasks are
never read. The manifest has a row for each file, and the documents' starts are its running sum.
"""

from __future__ import annotations

import re
import struct
import uuid
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from unitflow.llm.common import id_of, text_of
from unitflow.llm.words import WordIds, pack_texts, text_groups
from unitflow.session import fresh_path, materialise

VOCABULARY = "byte_bpe_50k.json"
END_ID = 2
FILE_BYTES = 64 << 20  # of ids before compression
LEVEL = 3
CACHED = 600_000  # words and pieces remembered
READ_BYTES = 4 << 20

#: Fixed values of the seekable format.
SKIPPABLE = 0x184D2A5E
DOCUMENTS = 0x184D2A50
SEEKABLE = 0x8F92EAB1

_MANIFEST = "part int, seq int, path string, n_docs long, n_tokens long, first_id long, last_id long"


class Tokens(WordIds):
    """Packs texts as 32-bit ids with the tokenizers library.

    A text is cut into words; a word that is new is cut by the tokenizer's pattern, and a piece that is new is
    encoded by the library's model. Texts with a special token's string go to the library whole.
    """

    def __init__(self, path: str | None):
        import public_tokenizers

        super().__init__(path or public_tokenizers.path(VOCABULARY))
        special = self.tokenizer.get_added_tokens_decoder().values()
        self.marks = "|".join(re.escape(t.content) for t in special)

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        whole = np.zeros(0, dtype=np.int64)
        if self.marks:
            marked = pc.match_substring_regex(texts, self.marks)
            whole = np.flatnonzero(marked.to_numpy(zero_copy_only=False))
        plain = pc.if_else(marked, "", texts) if len(whole) else texts
        out = pack_texts(plain, lambda words: self.pack(words, CACHED))
        for i in whole.tolist():
            ids = self.tokenizer.encode(texts[i].as_py(), add_special_tokens=False).ids
            out[i] = array("I", ids).tobytes()
        return out


_WORKER: dict[str | None, Tokens] = {}


def _tokens(path: str | None) -> Tokens:
    if path not in _WORKER:
        _WORKER[path] = Tokens(path)
    return _WORKER[path]


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


class _File:
    """A file that is being written; only sizes, checksums and ids stay in memory."""

    def __init__(self, uri: str):
        import zstandard

        self.uri = uri
        files, path = _filesystem(uri)
        self.out = files.open_output_stream(path, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=LEVEL)
        self.entries: list[tuple[int, int, int]] = []
        self.ids: list[int] = []
        self.size = 0

    def add(self, doc: int, raw: bytes) -> None:
        import xxhash

        frame = self.zstd.compress(raw)
        self.out.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.ids.append(doc)
        self.size += len(raw)

    def close(self, part: int, seq: int) -> tuple:
        ids = struct.pack(f"<{len(self.ids)}q", *self.ids)
        packed = self.zstd.compress(ids)
        self.out.write(struct.pack("<II", DOCUMENTS, len(packed)) + packed)
        entry = struct.Struct("<III")
        table = b"".join(entry.pack(*e) for e in [*self.entries, (8 + len(packed), 0, 0)])
        foot = struct.pack("<IBI", len(self.entries) + 1, 0x80, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table) + len(foot)) + table + foot)
        self.out.close()
        n = len(self.ids)
        return part, seq, self.uri, n, self.size // 4, self.ids[0], self.ids[-1]


def write_tokens(
    docs: DataFrame,
    folder: str | None = None,
    tokenizer: str | None = None,
    end_id: int = END_ID,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the ids of each whole text, ``end_id`` after each; gives the manifest (one row a file).

    Order is ascending ``doc_id``, null last, rows of one id by their text. A null text is empty and has the
    end id alone; other columns are not looked at; an empty table has no files. ``folder`` must be shared by
    all executors (default: a new one in ``spark.checkpoint.dir``); ``tokenizer`` is a file that every
    worker can open.
    """
    folder = folder or fresh_path(docs.sparkSession, "token-files")
    files, path = _filesystem(folder)
    files.create_dir(path, recursive=True)

    def run(batches):
        part, seq, out = TaskContext.get().partitionId(), 0, None
        tokens = _tokens(tokenizer)
        done = []
        for batch in batches:
            ids = batch.column("id").to_pylist()
            for piece, texts in text_groups(batch.column("text")):
                packed = tokens.encode(texts)
                for doc, raw in zip(ids[piece], packed, strict=True):
                    if out is None:
                        out = _File(f"{folder}/{part:06d}-{seq:06d}-{uuid.uuid4().hex}.zst")
                    out.add(doc, raw + struct.pack("<I", end_id))
                    if out.size >= file_bytes:
                        done.append(out.close(part, seq))
                        out, seq = None, seq + 1
        if out is not None:
            done.append(out.close(part, seq))
        if done:
            columns = zip(*done, strict=True)
            types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            names = [c.split()[0] for c in _MANIFEST.split(", ")]
            yield pa.RecordBatch.from_arrays(arrays, names)

    rows = docs.select(id_of().alias("id"), text_of().alias("text"))
    ordered = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialise(ordered.mapInArrow(run, _MANIFEST), "token-manifest")


def _frames(uri: str, wanted: set[int] | None) -> Iterator[tuple[int, int, bytes]]:
    """(document, tokens before it in the file, its ids) from a file; only wanted frames are read."""
    import xxhash
    import zstandard

    files, path = _filesystem(uri)
    with files.open_input_file(path) as file:
        size = file.size()
        n, _, magic = struct.unpack("<IBI", file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        table_at = size - 9 - 12 * n
        entries = list(struct.iter_unpack("<III", file.read_at(12 * n, table_at)))
        ids_size = entries[-1][0]
        zstd = zstandard.ZstdDecompressor()
        packed = file.read_at(ids_size - 8, table_at - 8 - ids_size + 8)
        ids = struct.unpack(f"<{n - 1}q", zstd.decompress(packed))
        at = before = 0
        block, block_at = b"", 0
        for doc, (length, raw_length, check) in zip(ids, entries, strict=False):
            if wanted is None or doc in wanted:
                if at < block_at or at + length > block_at + len(block):
                    # a full read takes neighbouring frames together
                    many = length if wanted is not None else max(length, READ_BYTES)
                    block, block_at = file.read_at(min(many, table_at - at), at), at
                raw = zstd.decompress(block[at - block_at : at - block_at + length])
                if len(raw) != raw_length or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != check:
                    raise ValueError(f"{uri}: checksum of document {doc} is wrong")
                yield doc, before, raw
            at += length
            before += raw_length // 4


def read_tokens(manifest: DataFrame, wanted: list[int] | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids) from the files of a manifest; ``ids`` is binary, 32-bit integers.

    ``start`` counts the ids of all documents before. With ``wanted``, a list that the caller bounds, only
    files that may hold these documents are opened and only their frames decompressed. A null ``doc_id``
    was written as the last id and comes back as null.
    """
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    # one row a file: a running sum over the manifest is small whatever the corpus
    files = manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(order), F.lit(0)))
    if wanted is not None:
        ids = F.array(*[F.lit(int(i)) for i in wanted]).cast("array<long>")
        files = files.where(F.exists(ids, lambda i: i.between(F.col("first_id"), F.col("last_id"))))
    chosen = None if wanted is None else set(wanted)

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                held, size = [], 0
                for doc, before, raw in _frames(row["path"], chosen):
                    held.append((doc, row["base"] + before, len(raw) // 4, raw))
                    size += len(raw)
                    if size >= READ_BYTES:
                        yield _rows(held)
                        held, size = [], 0
                if held:
                    yield _rows(held)

    # a number that is asked for is not coalesced: a task for each file
    spread = files.select("path", "base").repartitionByRange(max(1, files.count()), "path")
    read = spread.mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")
    return read.withColumn("doc_id", F.nullif("doc_id", F.lit(2**63 - 1)))


def _rows(held: list[tuple]) -> pa.RecordBatch:
    types = [pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    arrays = [pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "n_tokens", "ids"])
