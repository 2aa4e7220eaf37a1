"""Byte-pair encoding through a lexicon: frequent words are read off a minimal acyclic transducer.

1. Words (white space and what follows it) are counted over the whole corpus. A word is frequent when it is more than
   1 / SHARE of all words, so there are fewer than SHARE of them whatever the corpus.
2. Frequent words are compiled into an automaton that shares prefixes and suffixes. Its transitions put
   out numbers whose sum along a word is the word's place in the list, and the list holds the words' ids.
3. The automaton is one file of flat arrays. Spark hands it to every executor, and all workers of a
   machine map the same pages. A batch's distinct words walk it together, one byte a step.
4. Words that it does not hold are cut into pieces and merged by the library's own model, so every id is
   the library's whatever the lexicon holds.
5. Words are cut and counted, and ids dealt to their places, by Arrow; see ``words``.

The driver holds the frequent words, at most SHARE x MAX_WORD code points.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import text_of
from unitflow.llm.words import (
    MAX_WORD,
    SPACE,
    WordIds,
    byte_letters,
    cut,
    elements,
    pack_texts,
    packed_array,
    packed_parts,
    text_groups,
)
from unitflow.session import discard, fresh_path, materialise

VOCABULARY = "byte_bpe_50k.json"
SHARE = 100_000
COUNTED = 200_000  # distinct words of long texts that a task counts before it hands them on
COUNTED_BYTES = 8 << 20  # of other texts, counted together
ENCODED_BYTES = 4 << 20  # of texts that are encoded together
LONG = 1 << 20  # code points from which a text is taken word by word
WORDS_AT_ONCE = 200_000
IDS_AT_ONCE = 1 << 18
REMEMBERED = 500_000  # merged words and pieces that a worker keeps, each of at most MAX_WORD code points

#: No piece of the pattern goes on from other characters into white space, so words are encoded one by one.
_WORD = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")


# --- the transducer -----------------------------------------------------------------------------


def minimal_automaton(words: Iterable[bytes]) -> list[tuple[bool, tuple[tuple[int, int], ...]]]:
    """The states (final, ((byte, state), ...)) of the least automaton of ``words``, which ascend.

    States come after all that they lead to; the last one is the start. Only the last word's path is open; what a
    new word leaves behind is looked up among the states that are there.
    """
    known: dict[tuple, int] = {}
    path: list[list] = [[False, []]]
    previous = None

    def close(depth: int) -> None:
        while len(path) > depth + 1:
            final, edges = path.pop()
            state = known.setdefault((final, tuple(edges)), len(known))
            path[-1][1][-1] = (path[-1][1][-1][0], state)

    for word in words:
        if previous is not None and word <= previous:
            raise ValueError("words have to ascend")
        shared = len(os.path.commonprefix([previous or b"", word]))
        close(shared)
        for byte in word[shared:]:
            path[-1][1].append((byte, -1))
            path.append([False, []])
        path[-1][0] = True
        previous = word
    close(0)
    final, edges = path.pop()
    # the start is a state of its own, even where another one is equal
    return [*known, (final, tuple(edges))]


def flat_tables(states: list[tuple]) -> dict[str, np.ndarray]:
    """The automaton as arrays: state s goes by byte b from slot base[s] + b, if that slot checks for s.

    ``add`` is what a transition puts out: how many words come before those that go on through it.
    """
    below = []
    for final, edges in states:
        below.append(int(final) + sum(below[child] for _, child in edges))
    used, base = bytearray(512), [0] * len(states)
    slots: list[tuple[int, int, int, int]] = []
    order = sorted(range(len(states)), key=lambda s: -len(states[s][1]))
    free = 256
    for s in order:
        final, edges = states[s]
        if not edges:
            continue
        at = free = used.find(0, free)
        while True:
            low = at - edges[0][0]
            top = low + edges[-1][0]
            if top + 512 > len(used):
                used.extend(bytes(len(used)))
            if not any(used[low + byte] for byte, _ in edges):
                break
            at = used.find(0, at + 1)
        base[s], before = low, int(final)
        for byte, child in edges:
            used[low + byte] = 1
            slots.append((low + byte, s, child, before))
            before += below[child]
    size = max((slot for slot, *_ in slots), default=0) + 512
    check, target, add = (np.full(size, fill, dtype=np.int32) for fill in (-1, 0, 0))
    if slots:
        columns = np.array(slots, dtype=np.int64)
        check[columns[:, 0]], target[columns[:, 0]], add[columns[:, 0]] = columns[:, 1:].T
    return {
        "base": np.array(base, dtype=np.int32),
        "final": np.array([final for final, _ in states], dtype=np.int32),
        "check": check,
        "target": target,
        "add": add,
    }


def compile_lexicon(words: Iterable[str], ids_of: Callable[[list[str]], list[bytes]]) -> bytes:
    """The file of a lexicon: a header, then 32-bit arrays."""
    ordered = sorted(set(words), key=str.encode)
    ids = ids_of(ordered)
    tables = flat_tables(minimal_automaton(w.encode() for w in ordered))
    tables["ids_at"] = np.cumsum([0, *(len(i) // 4 for i in ids)]).astype(np.int32)
    tables["ids"] = np.frombuffer(b"".join(ids), dtype=np.int32)
    header = json.dumps({name: len(table) for name, table in tables.items()}).encode()
    header += b" " * (-len(header) % 8)
    body = b"".join(table.astype("<i4").tobytes() for table in tables.values())
    return struct.pack("<Q", len(header)) + header + body


class Lexicon:
    """A mapped lexicon file."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            (size,) = struct.unpack("<Q", file.read(8))
            lengths = json.loads(file.read(size))
        whole = np.memmap(path, dtype="<i4", mode="r", offset=0)
        at = (8 + size) // 4
        tables = {}
        for name, n in lengths.items():
            tables[name] = whole[at : at + n]
            at += n
        self.base, self.final, self.check = (tables[n] for n in ("base", "final", "check"))
        self.target, self.add, self.ids_at = (tables[n] for n in ("target", "add", "ids_at"))
        self.ids, self.start = tables["ids"], len(tables["base"]) - 1
        #: the packed ids of each place, on the mapped pages
        self.packed = packed_array(4 * self.ids_at.astype(np.int64), self.ids)

    def places(self, words: list[bytes]) -> np.ndarray:
        """Each word's place in the lexicon, -1 where it is not in it; all words walk together."""
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        text = np.frombuffer(b"".join(words), dtype=np.uint8)
        return self._walk(text, np.cumsum(lengths) - lengths, lengths)

    def places_of(self, words: pa.Array) -> np.ndarray:
        """``places`` for an array of strings."""
        edges, text = packed_parts(words.cast(pa.large_string()))
        return self._walk(np.frombuffer(text, dtype=np.uint8), edges[:-1], np.diff(edges))

    def _walk(self, text: np.ndarray, at: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        state = np.full(len(at), self.start, dtype=np.int64)
        place = np.zeros(len(at), dtype=np.int64)
        live, step = np.flatnonzero(lengths > 0), 0
        while len(live):
            slot = self.base[state[live]] + text[at[live] + step]
            meets = self.check[slot] == state[live]
            state[live[~meets]] = -1
            live, slot = live[meets], slot[meets]
            place[live] += self.add[slot]
            state[live] = self.target[slot]
            step += 1
            live = live[lengths[live] > step]
        found = state >= 0
        found[found] = self.final[state[found]] > 0
        return np.where(found, place, -1)

    def encode(self, words: list[str]) -> list[bytes | None]:
        """The packed ids of each word, None where the lexicon does not hold it."""
        out: list[bytes | None] = [None] * len(words)
        # longer words are none of the lexicon's, nor is the empty one
        places = self.places([w.encode() if len(w) <= MAX_WORD else b"" for w in words])
        hits = np.flatnonzero(places >= 0)
        low, high = self.ids_at[places[hits]].tolist(), self.ids_at[places[hits] + 1].tolist()
        for i, a, b in zip(hits.tolist(), low, high, strict=True):
            out[i] = self.ids[a:b].tobytes()
        return out


# --- words that the lexicon does not hold ---------------------------------------------------------


class Merger(WordIds):
    """Exact ids of any words, and the bytes of any id, from a tokenizer file."""

    def __init__(self, path: str | None):
        import public_tokenizers
        from tokenizers.pre_tokenizers import ByteLevel

        path = path or public_tokenizers.path(VOCABULARY)
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        plain = ("single_word", "lstrip", "rstrip", "normalized")
        if told["normalizer"] or any(t[f] for t in told["added_tokens"] for f in plain):
            raise ValueError(f"{path}: only byte-level tokenizers with plain added tokens")
        super().__init__(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        byte = {c: b for b, c in byte_letters(ByteLevel.alphabet()).items()}
        marks = {t["content"]: t["id"] for t in told["added_tokens"]}
        known = told["model"]["vocab"] | marks
        token_bytes = [b""] * (max(known.values()) + 1)
        for token, i in known.items():
            inside = all(c in byte for c in token)
            token_bytes[i] = bytes(byte[c] for c in token) if inside else token.encode()
        self.token_bytes = pa.array(token_bytes, pa.large_binary())
        self.marks = {m: struct.pack("<I", i) for m, i in marks.items()}
        self.ways = "|".join(re.escape(m) for m in sorted(marks, key=len, reverse=True))
        self.mark = re.compile(f"({self.ways})") if self.ways else None

    def segments(self, text: str) -> list[str]:
        """The text cut at added tokens; every second part is one."""
        return self.mark.split(text) if self.mark else [text]

    def words(self, words: list[str]) -> list[bytes]:
        """The packed ids of distinct words without added tokens."""
        return elements(self.packed_words(pa.array(words, pa.string())))

    def packed_words(self, words: pa.Array) -> pa.Array:
        return self.pack(words, REMEMBERED)

    def decode(self, ids: bytes) -> str:
        """What the ids stand for; broken UTF-8 becomes U+FFFD."""
        numbers = np.frombuffer(ids, dtype="<u4")
        parts = []
        for low in range(0, len(numbers), IDS_AT_ONCE):
            edges, text = packed_parts(self.token_bytes.take(pa.array(numbers[low : low + IDS_AT_ONCE])))
            parts.append(text[: edges[-1]])
        return b"".join(parts).decode("utf-8", "replace")


class Encoder:
    """Texts to packed ids: the lexicon first, exact merges for the rest."""

    def __init__(self, merger: Merger, lexicon: Lexicon):
        self.merger, self.lexicon = merger, lexicon

    def known(self, words: Iterable[str]) -> dict[str, bytes]:
        """The ids of each distinct word."""
        distinct = list(words)
        held = dict(zip(distinct, self.lexicon.encode(distinct), strict=True))
        unseen = [w for w, ids in held.items() if ids is None]
        held.update(zip(unseen, self.merger.words(unseen), strict=True))
        return held

    def _long(self, text: str) -> bytes:
        out = []
        words = (m.group() for m in _WORD.finditer(text))
        while part := list(islice(words, WORDS_AT_ONCE)):
            out.append(b"".join(map(self.known(set(part)).__getitem__, part)))
        return b"".join(out)

    def _marked(self, text: str) -> bytes:
        parts = self.merger.segments(text)
        return b"".join(self.merger.marks[p] if i % 2 else self._long(p) for i, p in enumerate(parts))

    def _ids_of(self, words: pa.Array) -> pa.Array:
        """The ids of an array of distinct words."""
        places, held = self.lexicon.places_of(words), self.lexicon.packed
        unseen = np.flatnonzero(places < 0)
        places[unseen] = len(held) + np.arange(len(unseen))
        merged = self.merger.packed_words(words.take(pa.array(unseen)))
        return pa.concat_arrays([held, merged]).take(pa.array(places))

    def encode(self, texts: pa.Array | list[str]) -> list[bytes]:
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        other = pc.greater(pc.utf8_length(texts), LONG)
        if self.merger.ways:
            other = pc.or_(other, pc.match_substring_regex(texts, self.merger.ways))
        apart = np.flatnonzero(other.to_numpy(zero_copy_only=False)).tolist()
        out = pack_texts(pc.if_else(other, "", texts) if apart else texts, self._ids_of)
        for i in apart:
            out[i] = self._marked(texts[i].as_py())
        return out


# --- Spark --------------------------------------------------------------------------------------


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of up to MAX_WORD code points in ``docs``."""

    def rows(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"]
        )

    def of_long(text: str) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        found = (m.group() for m in _WORD.finditer(text))
        while part := list(islice(found, WORDS_AT_ONCE)):
            counts.update(part)
            if len(counts) > COUNTED:
                yield rows(_short(counts))
                counts = Counter()
        yield rows(_short(counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in text_groups(batch.column("text"), COUNTED_BYTES):
                long = pc.greater(pc.utf8_length(texts), LONG)
                apart = np.flatnonzero(long.to_numpy(zero_copy_only=False)).tolist()
                for i in apart:
                    yield from of_long(texts[i].as_py())
                words, _ = cut(pc.if_else(long, "", texts) if apart else texts)
                word, n = words.value_counts().flatten()
                short = pc.less_equal(pc.utf8_length(word), MAX_WORD)
                yield pa.RecordBatch.from_arrays([word.filter(short), n.filter(short)], ["word", "n"])

    partial = docs.select(text_of().alias("text")).mapInArrow(run, "word string, n long")
    return partial.groupBy("word").agg(F.sum("n").alias("n"))


def _short(counts: Counter) -> Counter:
    return Counter({w: n for w, n in counts.items() if len(w) <= MAX_WORD})


def frequent_words(docs: DataFrame, share: int = SHARE) -> list[str]:
    """The words that are more than 1 / ``share`` of all counted words: fewer than ``share``."""
    counts = materialise(word_counts(docs), "word-counts")
    everything = counts.agg(F.sum("n")).first()[0] or 0
    rows = counts.where(F.col("n") * share > everything).select("word").collect()
    discard(counts)
    return [r.word for r in rows]


_WORKER: dict[tuple, Encoder] = {}


def _encoder(tokenizer: str | None, name: str) -> Encoder:
    key = (tokenizer, name)
    if key not in _WORKER:
        _WORKER.clear()  # one lexicon at a time
        _WORKER[key] = Encoder(Merger(tokenizer), Lexicon(SparkFiles.get(name)))
    return _WORKER[key]


def publish_lexicon(docs: DataFrame, tokenizer: str | None = None, share: int = SHARE) -> str:
    """Compile the frequent words of ``docs`` and hand the file to all executors; gives its name.

    The file lies in the shared folder; an executor that comes later fetches it as the others did.
    """
    from pyarrow import fs

    spark = docs.sparkSession
    content = compile_lexicon(frequent_words(docs, share), Merger(tokenizer).words)
    name = f"lexicon-{uuid.uuid4().hex}.bin"
    folder = fresh_path(spark, "lexicon")
    files, path = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))
    files.create_dir(path, recursive=True)
    with files.open_output_stream(f"{path}/{name}", compression=None) as out:
        out.write(content)
    spark.sparkContext.addFile(f"{folder}/{name}")
    return name


def encode_decode(
    docs: DataFrame, tokenizer: str | None = None, share: int = SHARE, lexicon: str | None = None
) -> DataFrame:
    """(doc_id, ids, decoded) of each row's whole text: ids as packed 32-bit integers, and what they decode to.

    ``tokenizer`` is a byte-level tokenizer file that every worker can open (default: the installed public
    one); added tokens in a text become their ids, no others are added. ``lexicon`` is the name of one that
    ``publish_lexicon`` has given (default: one of ``docs``); it changes no result. A null text is empty and has
    no ids; ids of documents may be null or repeated, each row is encoded by itself; other columns are not
    looked at. A single word is merged whole, in time that grows little faster than its length.
    """
    name = lexicon or publish_lexicon(docs, tokenizer, share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(tokenizer, name)
        for batch in batches:
            ids = batch.column("doc_id")
            for part, texts in text_groups(batch.column("text"), ENCODED_BYTES):
                packed = encoder.encode(texts)
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part.start : part.stop],
                        pa.array(packed, pa.binary()),
                        pa.array(map(encoder.merger.decode, packed), pa.string()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids binary, decoded string")
