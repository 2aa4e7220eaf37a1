"""Quality classifier: random-indexing word vectors, pooled by document, and a two-layer network.

1. Every term of the corpus has a fixed sparse ternary index vector; a term's vector is the sum of the index
   vectors of its neighbours over all documents. Terms share TERMS hash slots, so a task's sums are one
   small matrix of integers, added up in two rounds, whatever the corpus and in whatever order.
2. A document is the mean of its terms' vectors over all occurrences and over distinct terms.
3. A bounded sample of labelled documents (``sample`` rows) comes to the driver as such means and trains a
   numpy network; part of it sets the temperature that calibrates the probabilities.
4. All documents are scored in one pass, without a shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.bpe import groups
from unitflow.llm.common import text_of
from unitflow.session import materialise

TERMS = 1 << 14
SIZE = 32  # dimensions of an index vector
NONZERO = 6
WINDOW = 2
SAMPLE = 20_000
HIDDEN = 32
STEPS = 400
HELD_OUT_OF = 5
THRESHOLD = 0.3
SEED = 11
BLOCK = 1024  # slots in a row of partial sums
CHARS = 1_000_000

_TERM = re.compile(r"[^\W_]+|[^\w\s]+|_+|\n")


def _index_vectors() -> np.ndarray:
    """TERMS + 1 rows; the last is zero and separates documents."""
    random = np.random.default_rng(SEED)
    out = np.zeros((TERMS + 1, SIZE), dtype=np.int64)
    for row in out[:TERMS]:
        row[random.choice(SIZE, NONZERO, replace=False)] = random.choice([-1, 1], NONZERO)
    return out


def _slot(term: str) -> int:
    """Words count in lower case, but whether one is all capitals is part of the term."""
    shape = b"A" if len(term) > 1 and term.isupper() else b"a"
    return crc32(shape + term.lower().encode("utf-8", "replace")) & (TERMS - 1)


class _Slots(dict):
    """Slots of the terms met so far; forgets all when it has too many."""

    def __missing__(self, term: str) -> int:
        if len(self) > 200_000:
            self.clear()
        self[term] = slot = _slot(term)
        return slot


def _terms(texts: list[str], slots: _Slots) -> list[np.ndarray]:
    return [np.fromiter(map(slots.__getitem__, _TERM.findall(t)), np.int64) for t in texts]


def _batches(batches) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in groups(texts, CHARS):
            yield batch.slice(part.start, part.stop - part.start), texts[part]


def _add_up(blocks: dict[int, np.ndarray]) -> pa.RecordBatch:
    rows = [(b, m.tobytes()) for b, m in sorted(blocks.items())]
    arrays = [
        pa.array([b for b, _ in rows], pa.int32()),
        pa.array([m for _, m in rows], pa.binary()),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["block", "sums"])


def _contexts(batches):
    index, slots = _index_vectors(), _Slots()
    total = np.zeros((TERMS, SIZE + 1), dtype=np.int64)  # the last column counts
    pad = np.full(WINDOW, TERMS)
    for _, texts in _batches(batches):
        for low in range(0, len(texts), 200):
            parts = [x for t in _terms(texts[low : low + 200], slots) for x in (t, pad)]
            ids = np.concatenate([pad, *parts])
            for at in range(WINDOW, len(ids) - WINDOW, 1 << 17):
                here = np.arange(at, min(at + (1 << 17), len(ids) - WINDOW))
                here = here[ids[here] < TERMS]
                if not len(here):
                    continue
                here = here[np.argsort(ids[here], kind="stable")]
                near = sum(index[ids[here + o]] for o in range(-WINDOW, WINDOW + 1) if o)
                own, first = np.unique(ids[here], return_index=True)
                total[own, :SIZE] += np.add.reduceat(near, first, axis=0)
                total[own, SIZE] += np.diff(np.append(first, len(here)))
    yield _add_up({b: total[b * BLOCK : (b + 1) * BLOCK] for b in range(TERMS // BLOCK)})


def _sums(batches):
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for b, sums in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            part = np.frombuffer(sums, dtype=np.int64).reshape(-1, SIZE + 1)
            held[b] = held[b] + part if b in held else part
    if held:
        yield _add_up(held)


def word_vectors(docs: DataFrame) -> np.ndarray:
    """TERMS + 1 unit vectors (or zeros), scaled down for frequent terms, from all texts of ``docs``.

    The result has a fixed size (2 MB), so it may go to the driver and back.
    """
    schema = "block int, sums binary"
    once = materialise(docs.select(text_of().alias("text")).mapInArrow(_contexts, schema), "contexts")
    salted = once.repartition(F.pmod(F.xxhash64("sums"), F.lit(64))).mapInArrow(_sums, schema)
    rows = salted.repartition("block").mapInArrow(_sums, schema).collect()
    total = np.zeros((TERMS + 1, SIZE + 1))
    for row in rows:
        part = np.frombuffer(row.sums, dtype=np.int64).reshape(-1, SIZE + 1)
        total[row.block * BLOCK : (row.block + 1) * BLOCK] = part
    vectors, counts = total[:, :SIZE], total[:, SIZE]
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    share = counts / max(1.0, counts.sum())
    weight = 1e-3 / (1e-3 + share)
    return np.divide(vectors, norm, out=np.zeros_like(vectors), where=norm > 0) * weight[:, None]


def _pooled(texts: list[str], vectors: np.ndarray, slots: _Slots) -> np.ndarray:
    """Features of each text: mean over occurrences, mean over distinct terms, and how many there are."""
    out = np.zeros((len(texts), 2 * SIZE + 2))
    for i, ids in enumerate(_terms(texts, slots)):
        if not len(ids):
            continue
        counts = np.bincount(ids, minlength=TERMS)
        own = np.nonzero(counts)[0]
        some = vectors[own]
        out[i, :SIZE] = counts[own] @ some / len(ids)
        out[i, SIZE : 2 * SIZE] = some.mean(axis=0)
        out[i, -2:] = len(own) / len(ids), np.log1p(len(ids))
    return out


class Network:
    """Standardised features, one hidden layer, a logit, a temperature."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = HIDDEN, steps: int = STEPS):
        random = np.random.default_rng(SEED)
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        fit = random.random(len(x)) >= 0.2 if len(x) >= 50 else np.ones(len(x), dtype=bool)
        z, t = self._standard(x[fit]), y[fit]
        d = z.shape[1]
        params = [
            random.normal(0, d**-0.5, (d, hidden)),
            np.zeros(hidden),
            random.normal(0, hidden**-0.5, hidden),
            np.zeros(1),
        ]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            a, b, c, e = params
            h = np.tanh(z @ a + b)
            error = (1 / (1 + np.exp(-(h @ c + e))) - t) / len(t)
            back = error[:, None] * c * (1 - h * h)
            slopes = [z.T @ back, back.sum(axis=0), h.T @ error, error.sum(keepdims=True)]
            for p, g, m, v in zip(params, slopes, first, second, strict=True):
                g = g + 1e-4 * p
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= 0.01 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.params, self.temperature = params, 1.0
        rest = ~fit if (~fit).any() else fit
        logits, truth = self.logits(x[rest]), y[rest]
        grid = np.geomspace(0.25, 8, 61)
        loss = [np.logaddexp(0, -np.where(truth > 0, 1, -1) * logits / t).mean() for t in grid]
        self.temperature = float(grid[int(np.argmin(loss))])

    def _standard(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -8, 8)

    def logits(self, x: np.ndarray) -> np.ndarray:
        a, b, c, e = self.params
        return np.tanh(self._standard(x) @ a + b) @ c + e

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -40, 40)))


def is_held_out() -> Column:
    """True for the fold that no label is learnt from; a null ``doc_id`` is in no fold."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(HELD_OUT_OF))
    return F.coalesce(rest == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, Network]:
    """Word vectors from all of ``docs``, and a network from at most ``sample`` labelled documents.

    Labels of the held-out fold are not used, nor null ones, nor those of a ``doc_id`` that is labelled both
    ways. If there are more than ``sample``, those with the least hash of their id are taken. Of rows that
    repeat an id, the one with the least hash of its text stands for it.
    """
    vectors = word_vectors(docs)
    sent = docs.sparkSession.sparkContext.broadcast(vectors)
    known = labels.where(~is_held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    known = known.groupBy(F.col("doc_id").cast("long").alias("__id")).agg(
        F.min("quality").cast("double").alias("__label"), F.max("quality").alias("__other")
    )
    known = known.where("__label = __other").orderBy(F.xxhash64("__id"), "__id").limit(sample)

    def features(batches):
        slots = _Slots()
        for batch, texts in _batches(batches):
            x = _pooled(texts, sent.value, slots)
            x = pa.array(list(x), pa.list_(pa.float64()))
            arrays = [batch.column("id"), batch.column("hash"), batch.column("label"), x]
            yield pa.RecordBatch.from_arrays(arrays, ["id", "hash", "label", "x"])

    # at most ``sample`` rows of two numbers
    labelled = docs.join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    labelled = labelled.select(
        F.col("__id").alias("id"),
        F.xxhash64(text_of()).alias("hash"),
        F.col("__label").alias("label"),
        text_of().alias("text"),
    )
    found = labelled.mapInArrow(features, "id long, hash long, label double, x array<double>")
    # one row for each id, however often it repeats; tasks cut their own rows first
    one = found.groupBy("id").agg(F.min(F.struct("hash", "label", "x")).alias("one"))
    rows = one.select("one.label", "one.x").collect()
    if not rows:
        x, y = np.zeros((1, 2 * SIZE + 2)), np.array([0.5])
    else:
        rows.sort(key=lambda r: (r.label, r.x))  # the order of tasks changes nothing
        x, y = np.array([r.x for r in rows]), np.array([r.label for r in rows])
        order = np.random.default_rng(SEED).permutation(len(y))
        x, y = x[order], y[order]
    return vectors, Network(x, y)


def score(docs: DataFrame, vectors: np.ndarray, network: Network) -> DataFrame:
    """(doc_id, score) of each row of ``docs``; the text is all that is looked at."""
    sent = docs.sparkSession.sparkContext.broadcast((vectors, network))

    def run(batches):
        slots = _Slots()
        words, net = sent.value
        for batch, texts in _batches(batches):
            # rounded, as sums of equal rows may differ in the last bit by their place in a block
            found = net.scores(_pooled(texts, words, slots)).round(9)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(found, pa.float64())], ["doc_id", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row of ``docs``.

    ``score`` is the calibrated probability of quality 1 from the whole text (null: empty); ``predicted`` is 1
    from 0.3 on. Rows are scored one by one, so repeats get equal scores; without any usable label every
    score is that of an untrained prior. Other columns than doc_id and text (labels: doc_id, quality) are
    not looked at.
    """
    docs = docs.select("doc_id", "text")
    scored = score(docs, *train(docs, labels.select("doc_id", "quality"), sample))
    return scored.select(
        "doc_id",
        is_held_out().alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
