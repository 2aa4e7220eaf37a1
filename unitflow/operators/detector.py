"""The language detector inside the row: a bounded profile that travels with the tasks.

``profiles.classify`` explodes a text into grams and joins them, which a corpus of votes cannot afford. Here a
trained profile of bounded size is a sorted array of gram keys with a column of scores for each label; an Arrow batch of
texts is looked up in it as a whole. No gram becomes a row, nothing is shuffled, and labels stay beside their text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

PROFILE_BYTES = 64 << 20  # of keys and scores, in the driver and in each Python worker
SLICE_CHARS = 1 << 18  # characters that are looked up at a time
CODE_BITS = 21  # a code point and one: three of them fill a key of 63 bits, so keys are exact


class Profile:
    """Scores of 1 to 3 character grams under each label, as ``profiles.train_profiles`` gives them."""

    def __init__(self, labels: list[str], keys: np.ndarray, scores: np.ndarray):
        by_name, by_key = np.argsort(labels), np.argsort(keys)
        self.labels = [labels[i] for i in by_name]
        self.keys, self.scores = keys[by_key], scores[by_key][:, by_name]
        self.mark = hashlib.sha1(self.keys.tobytes() + self.scores.tobytes()).hexdigest()[:12]

    def __repr__(self) -> str:
        return f"Profile({', '.join(self.labels)}; {len(self.keys)} grams, {self.mark})"

    def detect(self, texts: list[str | None]) -> list[str | None]:
        """The best label of each text, of equals the first by name; null without a known gram or without a text."""
        sums = np.zeros((len(texts), len(self.labels)), dtype=np.int64)
        known = np.zeros(len(texts), dtype=np.int64)
        held: list[tuple[int, str, int]] = []
        size = 0
        for i, text in enumerate(texts):
            for low in range(0, len(text or ""), SLICE_CHARS):
                # the grams that begin in a piece reach two characters into the next one
                piece = text[low : low + SLICE_CHARS + 2]
                held.append((i, piece, min(SLICE_CHARS, len(text) - low)))
                size += len(piece)
                if size >= SLICE_CHARS:
                    self._add(held, sums, known)
                    held, size = [], 0
        if held:
            self._add(held, sums, known)
        best = np.argmax(sums, axis=1).tolist()
        return [self.labels[b] if k else None for b, k in zip(best, known.tolist(), strict=True)]

    def _add(self, held: list[tuple[int, str, int]], sums: np.ndarray, known: np.ndarray) -> None:
        whole = "".join(piece for _, piece, _ in held).encode("utf-32-le", "surrogatepass")
        code = np.frombuffer(whole, dtype="<u4").astype(np.int64) + 1
        lengths = np.array([len(piece) for _, piece, _ in held])
        ends = np.cumsum(lengths)
        left = np.repeat(ends, lengths) - np.arange(len(code))  # characters from here to the piece's end
        starts = np.repeat(np.array([n for *_, n in held]), lengths) - (np.repeat(lengths, lengths) - left) > 0
        owner = np.repeat(np.array([i for i, *_ in held]), lengths)
        key = code
        for n in (1, 2, 3):
            if n > 1:
                ahead = np.zeros_like(code)
                ahead[: len(code) - n + 1] = code[n - 1 :]
                key = key | ahead << (CODE_BITS * (n - 1))
            at = np.flatnonzero(starts & (left >= n))
            place = np.searchsorted(self.keys, key[at])
            place[place == len(self.keys)] = 0
            hit = self.keys[place] == key[at] if len(self.keys) else np.zeros(len(at), dtype=bool)
            whose, place = owner[at[hit]], place[hit]
            if not len(whose):
                continue
            first = np.flatnonzero(np.diff(whose, prepend=-1))
            sums[whose[first]] += np.add.reduceat(self.scores[place], first, axis=0)
            known[whose[first]] += 1


def gram_key(gram: str) -> int:
    return sum((ord(c) + 1) << (CODE_BITS * i) for i, c in enumerate(gram))


def profile_bytes(profiles: DataFrame) -> int:
    """What a trained profile (gram, label ...) takes in memory: a key and a score for each label."""
    return 8 * len(profiles.columns) * profiles.count()


def load_profile(profiles: DataFrame, max_bytes: int = PROFILE_BYTES) -> Profile:
    """The trained profile (gram, label ...) as one object; refused where it has more than ``max_bytes``.

    A larger profile is for ``profiles.classify``, or trained on grams that are less rare.
    """
    labels = [c for c in profiles.columns if c != "gram"]
    size = profile_bytes(profiles)
    if size > max_bytes:
        raise ValueError(f"a profile of {size} bytes is more than {max_bytes}")
    table = profiles.select("gram", *labels).toArrow()
    keys = np.array([gram_key(g) for g in table.column("gram").to_pylist()], dtype=np.int64)
    scores = np.stack([table.column(x).to_numpy() for x in labels], axis=1).astype(np.int64)
    return Profile(labels, keys, scores.reshape(len(keys), len(labels)))


def detected_label(text: Column, profile: Profile) -> Column:
    """The label of a text; null in, null out, without a look-up."""

    @F.arrow_udf(T.StringType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(profile.detect(texts.to_pylist()), pa.string())

    return run(text)


def detected_labels(texts: Column, profile: Profile) -> Column:
    """The labels of an array of texts, in its order."""

    @F.arrow_udf(T.ArrayType(T.StringType()))
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for lists in batches:
            sizes = lists.value_lengths().fill_null(0).to_pylist()
            labels = profile.detect(lists.flatten().to_pylist())
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(labels, pa.string()))

    return run(texts)
