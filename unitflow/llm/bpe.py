"""Byte-level BPE by recursive DuckDB queries inside the tasks.

Spark deals the documents out; each Arrow batch is split by the tokenizer's pattern, and the distinct pieces
that the worker has not met yet become token-position rows. A recursive query joins neighbouring
positions to the merge table, contracts the leftmost pair of least rank in each word, and repeats until no
pair is left; words of over 128 bytes are first cut where no token joins two bytes, and contract all places of
their least pair in a round. Decoding joins (document, position, id) rows to the vocabulary and aggregates in order.

DuckDB runs in the Python worker, on one thread, over one small batch at a time; nothing is shared between
tasks but a bounded cache of encoded pieces, which changes no result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import text_of

VOCABULARY = "byte_bpe_50k.tiktoken"
BATCH_CHARS = 4_000_000  # text that is encoded at a time
LONG = 1 << 20  # code points from which a text is split piece by piece
CACHED = 192 << 20  # bytes of pieces and their ids that a worker remembers
ENTRY = 150  # bytes that a remembered piece takes beside its text and ids
STRETCH = 1 << 20  # ids that are decoded at a time
ROUND_ROWS = 6_000_000  # rows that one query may keep, about 150 MB
SHORT = 128  # bytes up to which all rounds of a word are kept until the end

_MERGES = """
create table merges as
select a.id as l, b.id as r, v.id as merged
from (select id, hex, unnest(range(2, length(hex)::bigint, 2)) as cut from vocab) v
join vocab a on a.hex = left(v.hex, v.cut) join vocab b on b.hex = substr(v.hex, v.cut + 1)
"""

#: Words of a few bytes: a row knows its neighbour, every round adds the word's rows anew, the last round
#: is the answer.
_SHORT_WORDS = """
with recursive piece(w, pos, tok, nxt, npos, k) as (
  select w, pos, tok, nxt, npos, 0 from start
  union all
  (with best as (
     select w, min(merged::bigint * 4294967296 + pos) as best
     from piece join merges on l = tok and r = nxt group by w),
   head as (
     select p.w, p.pos as h, p.npos as n, (best // 4294967296)::int as merged
     from best join piece p on p.w = best.w and p.pos = best % 4294967296),
   cut as (
     select head.*, p.nxt as after, p.npos as apos
     from head join piece p on p.w = head.w and p.pos = head.n)
   select p.w, p.pos, case when p.pos = h then merged else tok end,
     case when p.pos = h then after when p.npos = h then merged else nxt end,
     case when p.pos = h then apos else npos end, k + 1
   from piece p join cut on p.w = cut.w where p.pos <> n)
), last as (select w, max(k) as k from piece group by w)
select w, tok from piece join last using (w, k) order by w, pos
"""

#: Longer words: a position's row is replaced in each round, and -1 marks one that was contracted. A round
#: contracts all places of the least pair from the left (of those that overlap, every other one), up to the
#: first whose new neighbours are a pair of lower rank, as that one has to go first then.
_LONG_WORDS = """
with recursive piece(w, pos, tok, k) using key (w, pos) as (
  select w, pos, tok, 0 from start
  union
  (with pair as (
     select w, pos, tok, k, lag(tok) over side as prev, lead(tok) over side as next,
       lead(tok, 2) over side as after, lead(pos) over side as npos, lead(pos, 2) over side as apos
     from piece where tok >= 0 window side as (partition by w order by pos)),
   ranked as (
     select w, pos, npos, apos, prev, after, merged from pair join merges on l = tok and r = next),
   least as (select w, min(merged) as merged from ranked group by w),
   met as (
     select ranked.*, lag(npos) over (partition by w order by pos) is distinct from pos as fresh
     from ranked join least using (w, merged)),
   runs as (select *, sum(fresh::int) over (partition by w order by pos) as run from met),
   apart as (
     select * from (
       select *, row_number() over (partition by w, run order by pos) as nth from runs)
     where nth % 2 = 1),
   placed as (
     select *, case when lag(apos) over (partition by w order by pos) = pos then merged else prev end as before
     from apart),
   stops as (
     select p.w, min(p.pos) as stop
     from placed p left join merges a on a.l = p.before and a.r = p.merged
     left join merges b on b.l = p.merged and b.r = p.after
     where a.merged < p.merged or b.merged < p.merged group by p.w),
   heads as (
     select p.w, p.pos, p.npos, p.merged from placed p left join stops on stops.w = p.w
     where stop is null or p.pos <= stop)
   select p.w, p.pos,
     case when h.pos is not null then h.merged when n.npos is not null then -1 else p.tok end, k + 1
   from pair p join least on least.w = p.w
   left join heads h on h.w = p.w and h.pos = p.pos
   left join heads n on n.w = p.w and n.npos = p.pos)
)
select w, tok from piece where tok >= 0 order by w, pos
"""

_DECODE = """
select doc, from_hex(string_agg(hex, '' order by pos)) as bytes
from tokens join vocab using (id) group by doc order by doc
"""


class DuckBpe:
    """Encoder and decoder over one rank file; ``ranks`` is its path.

    ``share``: of the usual memory for batches of text, queries and stretches of ids. Results do not depend on it.
    """

    def __init__(self, ranks: str, pattern: str, cached: int = CACHED, share: float = 1):
        import duckdb
        import regex

        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        with open(ranks, "rb") as rows:
            pairs = [line.split() for line in rows if line.strip()]
        tokens = [base64.b64decode(token) for token, _ in pairs]
        ids = [int(rank) for _, rank in pairs]
        vocab = pa.table({"id": pa.array(ids, pa.int32()), "hex": [t.hex() for t in tokens]})
        self.con.register("vocab_rows", vocab)
        self.con.execute("create table vocab as select * from vocab_rows")
        self.con.execute(_MERGES)
        self.of_byte = np.zeros(256, dtype=np.int32)
        for token, i in zip(tokens, ids, strict=True):
            if len(token) == 1:
                self.of_byte[token[0]] = i
        # a piece that is a token needs no contraction
        self.tokens = {t: i.to_bytes(4, "little") for t, i in zip(tokens, ids, strict=True)}
        # two bytes that stand together in no token: no contraction ever crosses between them
        self.joined = np.zeros((256, 256), dtype=bool)
        for token in tokens:
            self.joined[list(token[:-1]), list(token[1:])] = True
        self.pattern, self.cached = regex.compile(pattern), cached
        self.chars, self.rows = int(BATCH_CHARS * share), int(ROUND_ROWS * share)
        self.stretch = int(STRETCH * share)
        self.known: dict[str, bytes] = {}
        self.held = 0

    def pieces(self, text: str) -> Iterator[list[str]]:
        if len(text) <= LONG:
            yield self.pattern.findall(text)
            return
        found = (m.group() for m in self.pattern.finditer(text))
        while part := list(islice(found, 200_000)):
            yield part

    def _contract(self, words: list[bytes], query: str) -> list[bytes]:
        """The ids of each word, packed as 32-bit integers; as many words a query as its rows allow."""
        lengths = np.array([len(w) for w in words], dtype=np.int64)
        # a short word of n bytes keeps at most n + (n - 1) + ... + 1 rows, a long one its n
        kept = lengths * (lengths + 1) // 2 if query is _SHORT_WORDS else 8 * lengths
        group = np.cumsum(kept) // self.rows
        edges = [0, *(np.nonzero(np.diff(group))[0] + 1).tolist(), len(words)]
        out: list[bytes] = []
        for lo, hi in zip(edges, edges[1:], strict=False):
            if lo < hi:
                out += self._contract_some(words[lo:hi], query)
        return out

    def _contract_some(self, words: list[bytes], query: str) -> list[bytes]:
        lengths = np.array([len(w) for w in words])
        ends = np.cumsum(lengths)
        tok = self.of_byte[np.frombuffer(b"".join(words), dtype=np.uint8)]
        pos = (np.arange(ends[-1]) - np.repeat(ends - lengths, lengths)).astype(np.int32)
        nxt, npos = np.append(tok[1:], np.int32(-1)), pos + 1
        nxt[ends - 1] = npos[ends - 1] = -1
        w = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
        start = pa.table({"w": w, "pos": pos, "tok": tok, "nxt": nxt, "npos": npos})
        self.con.register("start", start)
        out = self.con.sql(query).to_arrow_table()
        ids = out.column("tok").to_numpy().astype("<i4").tobytes()
        counts = out.group_by("w", use_threads=False).aggregate([("tok", "count")]).sort_by("w")
        packed, at = [], 0
        for n in counts.column("tok_count").to_pylist():
            packed.append(ids[at : at + 4 * n])
            at += 4 * n
        return packed

    def _apart(self, word: bytes) -> list[bytes]:
        """The parts of a word that no token joins."""
        b = np.frombuffer(word, dtype=np.uint8)
        cuts = np.nonzero(~self.joined[b[:-1], b[1:]])[0] + 1
        edges = [0, *cuts.tolist(), len(word)]
        return [word[lo:hi] for lo, hi in zip(edges, edges[1:], strict=False)]

    def _long(self, words: list[bytes]) -> list[bytes]:
        """The ids of words of more than ``SHORT`` bytes, by their parts."""
        parts = [self._apart(w) for w in words]
        distinct = list({p for some in parts for p in some})
        ids: dict[bytes, bytes] = {}
        for query, some in (
            (_SHORT_WORDS, [p for p in distinct if len(p) <= SHORT]),
            (_LONG_WORDS, [p for p in distinct if len(p) > SHORT]),
        ):
            ids.update(zip(some, self._contract(some, query), strict=True))
        return [b"".join(map(ids.__getitem__, some)) for some in parts]

    def learn(self, pieces: set[str]) -> None:
        new = pieces - self.known.keys()
        if self.held > self.cached:
            self.known = {p: self.known[p] for p in pieces - new}
            self.held = sum(len(p) + len(ids) + ENTRY for p, ids in self.known.items())
        raw = {p: p.encode() for p in new}
        found = {p: self.tokens[b] for p, b in raw.items() if b in self.tokens}
        short = [p for p, b in raw.items() if p not in found and len(b) <= SHORT]
        long = [p for p, b in raw.items() if len(b) > SHORT and p not in found]
        found.update(zip(short, self._contract([raw[p] for p in short], _SHORT_WORDS), strict=True))
        found.update(zip(long, self._long([raw[p] for p in long]), strict=True))
        self.known.update(found)
        self.held += sum(len(p) + len(ids) + ENTRY for p, ids in found.items())

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed as little-endian 32-bit integers."""
        out, held, size = [b""] * len(texts), [], 0

        def flush():
            self.learn({p for _, part in held for p in part})
            grouped: dict[int, list[bytes]] = {}
            for i, part in held:
                grouped.setdefault(i, [out[i]]).append(b"".join(map(self.known.__getitem__, part)))
            for i, parts in grouped.items():
                out[i] = b"".join(parts)

        for i, text in enumerate(texts):
            for part in self.pieces(text):
                held.append((i, part))
                size += len(part)
                if size >= self.chars:
                    flush()
                    held, size = [], 0
        flush()
        return out

    def decode(self, packed: list[bytes]) -> list[bytes]:
        """The bytes of each text's ids, a stretch of ids at a time."""
        lengths = np.array([len(p) // 4 for p in packed])
        doc = np.repeat(np.arange(len(packed), dtype=np.int32), lengths)
        ids = np.frombuffer(b"".join(packed), dtype="<i4")
        parts: list[list[bytes]] = [[] for _ in packed]
        for low in range(0, len(ids), self.stretch):
            some = slice(low, low + self.stretch)
            rows = {"doc": doc[some], "id": ids[some]}
            self.con.register("tokens", pa.table(rows | {"pos": np.arange(len(rows["id"]))}))
            found = self.con.sql(_DECODE).to_arrow_table()
            for d, b in zip(found.column("doc").to_pylist(), found.column("bytes").to_pylist(), strict=True):
                parts[d].append(b)
        return [b"".join(p) for p in parts]


_WORKER: dict[tuple, DuckBpe] = {}


def _encoder(ranks: str | None, pattern: str | None, share: float) -> DuckBpe:
    key = (ranks, pattern, share)
    if key not in _WORKER:
        import public_tokenizers

        _WORKER[key] = DuckBpe(
            ranks or public_tokenizers.path(VOCABULARY),
            pattern or public_tokenizers.PATTERN,
            int(CACHED * share),
            share,
        )
    return _WORKER[key]


def groups(texts: list[str], chars: int = 2_000_000) -> Iterator[slice]:
    """Slices of neighbouring texts with about ``chars`` code points each."""
    low = size = 0
    for i, text in enumerate(texts):
        size += len(text)
        if size >= chars:
            yield slice(low, i + 1)
            low, size = i + 1, 0
    if low < len(texts):
        yield slice(low, len(texts))


def encode_decode(
    docs: DataFrame, ranks: str | None = None, pattern: str | None = None, share: float = 1
) -> DataFrame:
    """(doc_id, ids array<int>, decoded binary) of each row's whole text.

    ``ids`` is the ordinary encoding without special tokens, ``decoded`` what the ids decode to. ``ranks``
    is a rank file that every worker can open (default: the installed public one). A null text is the
    empty text and has no ids; ids may be null or repeated, rows are encoded one by one; other columns
    are not looked at. Time grows with the square of a single piece's length, as one pair is contracted
    in each round; memory does not.

    ``share`` is the part of the usual memory that a worker may take for texts, queries and known pieces: less where
    the JVM beside it has grown in stages before. It costs some time and changes no result.
    """

    def run(batches):
        bpe = _encoder(ranks, pattern, share)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
            for part in groups(texts, bpe.chars):
                packed = bpe.encode(texts[part])
                offsets = [0]
                for p in packed:
                    offsets.append(offsets[-1] + len(p) // 4)
                values = pa.Array.from_buffers(
                    pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(packed))]
                )
                yield pa.RecordBatch.from_arrays(
                    [
                        ids[part.start : part.stop],
                        pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values),
                        pa.array(bpe.decode(packed), pa.binary()),
                    ],
                    ["doc_id", "ids", "decoded"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>, decoded binary")
