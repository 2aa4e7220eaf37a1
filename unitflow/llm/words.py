"""Words of many texts at once, and the tokenizers library's ids of each distinct one.

A word is white space and what follows it. No piece of the tokenizer's pattern goes on from other characters
into white space, so a text's ids are its words' ids. Words are cut on the UTF-8 bytes of an Arrow batch
and looked up by Arrow's hash table; only distinct words become Python strings, and only pieces that
the worker does not remember go to the library's model.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MAX_WORD = 64  # code points; longer words and pieces are not remembered
GROUP_BYTES = 16 << 20  # of texts that are encoded together

#: The white space of the tokenizer's pattern, and the same as bytes: single ones, seconds
#: after C2, and three after one another.
_WIDE = [chr(c) for c in (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)]
SPACE = "".join(["\t\n\x0b\x0c\r \x85\xa0", *_WIDE])
_ONE = np.isin(np.arange(256), list(b"\t\n\x0b\x0c\r "))
_TWO = np.isin(np.arange(256), [0x85, 0xA0])
_THREE = np.array([int.from_bytes(c.encode(), "big") for c in _WIDE], dtype=np.int32)

#: Code points below are Latin letters, digits and old punctuation; what is a letter is agreed on there.
SETTLED = 0x250
_SETTLED_BYTES = chr(SETTLED).encode()
_SETTLED = re.compile(f"[\0-{chr(SETTLED - 1)}]*")


def _bounds(texts: pa.Array) -> np.ndarray:
    return np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1]


def text_groups(texts: pa.Array, size: int = GROUP_BYTES) -> Iterator[tuple[slice, pa.Array]]:
    """Neighbouring texts with about ``size`` bytes a group: where they stand, and the texts."""
    texts = texts.cast(pa.string())
    if not len(texts):
        return
    ends = _bounds(texts)[1:].astype(np.int64)
    low = 0
    while low < len(texts):
        before = ends[low - 1] if low else ends[0]
        high = max(low + 1, int(np.searchsorted(ends, before + size, side="right")))
        yield slice(low, high), texts.slice(low, high - low)
        low = high


def cut(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, and the number of words before each text and before the end."""
    bounds = _bounds(texts) if len(texts) else np.zeros(1, dtype=np.int32)
    low, high = int(bounds[0]), int(bounds[-1])
    if low == high:
        return pa.array([], pa.string()), np.zeros(len(bounds), dtype=np.int64)
    data = np.frombuffer(texts.buffers()[2], dtype=np.uint8)[low:high]
    space = _ONE[data]
    at = np.flatnonzero(data[:-1] == 0xC2)
    at = at[_TWO[data[at + 1]]]
    space[at] = space[at + 1] = True
    lead = data[:-2] if high - low > 2 else data[:0]
    at = np.flatnonzero((lead >= 0xE1) & (lead <= 0xE3))
    code = data[at].astype(np.int32) << 16 | data[at + 1].astype(np.int32) << 8 | data[at + 2]
    at = at[np.isin(code, _THREE)]
    space[at] = space[at + 1] = space[at + 2] = True
    starts = space.copy()
    starts[1:] &= ~space[:-1]
    starts[bounds[:-1][bounds[:-1] < high] - low] = True
    found = np.flatnonzero(starts) + low
    edges = np.append(found, high).astype(np.int32)
    words = pa.StringArray.from_buffers(len(found), pa.py_buffer(edges), texts.buffers()[2])
    return words, np.searchsorted(found, bounds)


def strings(words: pa.Array) -> list[str]:
    return words.to_numpy(zero_copy_only=False).tolist()


def pack_texts(texts: pa.Array, ids_of: Callable[[pa.Array], pa.Array]) -> list[bytes]:
    """The ids of each text; ``ids_of`` gives those of distinct words as large_binary."""
    words, first = cut(texts)
    if not len(words):
        return [b""] * len(texts)
    coded = words.dictionary_encode()
    edges, flat = packed_parts(ids_of(coded.dictionary).take(coded.indices))
    ends = edges[first].tolist()
    return [bytes(flat[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def packed_parts(ids: pa.Array) -> tuple[np.ndarray, memoryview]:
    """Where each element of an array with 64-bit offsets begins, with the end of all, and the bytes."""
    edges = np.frombuffer(ids.buffers()[1], dtype=np.int64)[ids.offset : ids.offset + len(ids) + 1]
    return edges, memoryview(ids.buffers()[2] or b"")


def elements(ids: pa.Array) -> list[bytes]:
    if not len(ids):
        return []
    edges, flat = packed_parts(ids)
    return [bytes(flat[a:b]) for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


def packed_array(edges: np.ndarray, flat) -> pa.Array:
    """A large_binary array whose elements end at the next one's beginning."""
    buffers = [None, pa.py_buffer(np.ascontiguousarray(edges, dtype=np.int64)), pa.py_buffer(flat)]
    return pa.Array.from_buffers(pa.large_binary(), len(edges) - 1, buffers)


def _plain(words: pa.Array) -> np.ndarray:
    """Which words begin with white space, end with none and have settled code points only.

    The pattern cuts such words as it cuts their sum. Of white space that is not ASCII some words are left out.
    """
    bounds = _bounds(words).astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8)[: bounds[-1]]
    first, last = data[bounds[:-1]], data[bounds[1:] - 1]
    out = _ONE[first] & ~_ONE[last]
    odd = np.flatnonzero(_TWO[last])
    out[odd[data[bounds[odd + 1] - 2] == 0xC2]] = False
    lead, follow = _SETTLED_BYTES
    new = np.flatnonzero(data[bounds[0] :] >= lead) + bounds[0]
    new = new[(data[new] > lead) | (data[np.minimum(new + 1, len(data) - 1)] >= follow)]
    out[np.searchsorted(bounds, new, side="right") - 1] = False
    return out


def _classes(pattern: str) -> str:
    """The tokenizer's pattern with its classes spelled out for code points under ``SETTLED``."""
    import regex

    points = list(map(chr, range(SETTLED)))
    letter, digit = (
        "".join(re.escape(c) for c in points if regex.match(p, c)) for p in (r"\p{L}", r"\p{N}")
    )
    pattern = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{SPACE}{letter}{digit}]")
    pattern = pattern.replace(r"\p{L}", f"[{letter}]").replace(r"\p{N}", f"[{digit}]")
    return pattern.replace(r"\s", f"[{SPACE}]").replace(r"\S", f"[^{SPACE}]")


def byte_letters(alphabet: list[str]) -> dict[int, str]:
    """The letter that stands for each byte: itself where it is printable, the rest in order of code point."""
    plain = {ord(c) for c in alphabet if ord(c) < 256}
    rest = iter(sorted(c for c in alphabet if ord(c) >= 256))
    return {b: chr(b) if b in plain else next(rest) for b in range(256)}


class WordIds:
    """Packed ids of words without added tokens, by the library; short words and pieces are remembered."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import regex
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.pattern = re.compile(_classes(public_tokenizers.PATTERN))
        self.any_script = regex.compile(public_tokenizers.PATTERN)
        self.agreed: dict[str, bool] = {}
        self.letters = byte_letters(ByteLevel.alphabet())
        self.merged: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}

    def _spelled(self, pieces: list[str]) -> list[str]:
        """The pieces in the model's letters, all in one pass where none holds the separator."""
        spell = self.letters
        parts = "\0".join(pieces).encode().decode("latin-1").translate(spell).split(spell[0])
        if len(parts) == len(pieces):
            return parts
        return [p.encode().decode("latin-1").translate(spell) for p in pieces]

    def _pack_pieces(self, pieces: list[str]) -> list[bytes]:
        known, tokenize = self.pieces, self.model.tokenize
        new = list(set(pieces).difference(known))
        spelled = self._spelled(new) if new else []
        found = [array("I", [t.id for t in tokenize(s)]).tobytes() for s in spelled]
        known.update(zip(new, found, strict=True))
        out = list(map(known.__getitem__, pieces))
        for piece in new:
            if len(piece) > MAX_WORD:
                del known[piece]
        return out

    def _pack_plain(self, words: pa.Array) -> pa.Array:
        bounds = _bounds(words)
        pieces = self.pattern.findall(words.buffers()[2][bounds[0] : bounds[-1]].to_pybytes().decode())
        packed = self._pack_pieces(pieces)
        ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
        word_ends = np.cumsum(pc.utf8_length(words).to_numpy().astype(np.int64))
        cuts = np.cumsum(np.fromiter(map(len, packed), np.int64, len(packed)))
        edges = np.append(0, cuts[np.searchsorted(ends, word_ends)])
        return packed_array(edges, b"".join(packed))

    def _agreed(self, point: str) -> bool:
        """Whether the pattern takes a code point for what the tokenizer does: letter, digit, space or other."""
        if point not in self.agreed:
            split, find = self.tokenizer.pre_tokenizer.pre_tokenize_str, self.any_script.findall
            self.agreed[point] = all(
                (len(split(before + point)) == 1) == (len(find(before + point)) == 1) for before in "a1!"
            )
        return self.agreed[point]

    def _pack_odd(self, words: list[str]) -> list[bytes]:
        held = {w: self.merged.get(w) for w in words}
        new = [w for w, ids in held.items() if ids is None]
        later = [w for w in new if not _SETTLED.fullmatch(w)]
        doubtful = {c for c in set().union(*later) if not self._agreed(c)}
        # where the two differ on what is a letter, the tokenizer has the say
        rest = [w for w in later if not doubtful.isdisjoint(w)] if doubtful else []
        coded = self.tokenizer.encode_batch_fast(rest, add_special_tokens=False) if rest else []
        held.update((w, array("I", c.ids).tobytes()) for w, c in zip(rest, coded, strict=True))
        known = [w for w in new if held[w] is None]
        pieces = list(map(self.any_script.findall, known))
        packed = iter(self._pack_pieces(list(chain.from_iterable(pieces))))
        held.update((w, b"".join(islice(packed, len(own)))) for w, own in zip(known, pieces, strict=True))
        self.merged.update((w, held[w]) for w in new if len(w) <= MAX_WORD)
        return [held[w] for w in words]

    def pack(self, words: pa.Array, remembered: int) -> pa.Array:
        """The packed ids of distinct words; what is known of earlier ones is given up beyond ``remembered``."""
        for held in (self.merged, self.pieces):
            if len(held) > remembered:
                held.clear()
        if not len(words):
            return pa.array([], pa.large_binary())
        plain = _plain(words)
        if plain.all():
            return self._pack_plain(words)
        odd = self._pack_odd(strings(words.filter(pa.array(~plain))))
        parts = [pa.array(odd, pa.large_binary())]
        if plain.any():
            parts.insert(0, self._pack_plain(words.filter(pa.array(plain))))
        # back to the order of the words
        place = np.argsort(np.argsort(~plain, kind="stable"), kind="stable")
        return pa.concat_arrays(parts).take(pa.array(place))
