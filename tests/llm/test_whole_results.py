"""Neighbours in full, bounded samples, and texts and words of any length."""

from __future__ import annotations

import base64
import random

import numpy as np
import pyarrow as pa
import pytest

from unitflow.llm import ann, bpe, quality_model

VECTORS = "vec_id long, embedding array<double>"


def table(spark, rows):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in rows], VECTORS)


def brute(rows, queries, k):
    """query id -> vec_ids, nearest first, ties to the smaller id; an id counts once for each of its vectors."""
    out = {}
    for q, u in queries:
        near = set()
        for i, v in rows:
            if i != q:
                score = float(np.dot(u, v) / (np.linalg.norm(u) * np.linalg.norm(v)))
                near.add((-round(score, 12), i, tuple(v)))
        out[q] = [i for _, i, _ in sorted(near)][:k]
    return out


def found(df):
    out: dict[int, list] = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


def test_few_vectors_are_all_found(spark):
    rng = np.random.default_rng(1)
    rows = list(enumerate(rng.normal(size=(6, 64))))
    df = table(spark, rows)
    assert found(ann.nearest(df, df)) == brute(rows, rows, 5)


def test_a_query_opposite_to_all_vectors(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=64)
    rows = [(i, centre + 0.01 * rng.normal(size=64)) for i in range(1, 201)] + [(0, -centre)]
    df = table(spark, rows)
    queries = [rows[-1], rows[49]]
    got = found(ann.nearest(df, table(spark, queries), probes=1, vector_block=30, query_block=1))
    want = brute(rows, queries, 5)
    assert got[0] == want[0] and len(got[50]) == 5


def test_tied_vectors_give_k_rows_a_block():
    rng = np.random.default_rng(3)
    v = rng.normal(size=8)
    ids = np.arange(3000)
    vectors = pa.table(
        {
            "id": ids,
            "same": ids,
            "members": [[int(i)] for i in ids],
            "vector": [(v * 2.0 ** (i % 9)).tolist() for i in ids],
        }
    )
    queries = pa.table({"id": [1, 5000], "vector": [v.tolist(), (-v).tolist()]})
    got = ann._rerank(5)(vectors, queries).to_pylist()
    assert [r["rep"] for r in got if r["query_id"] == 1] == [0, 2, 3, 4, 5]
    assert [r["rep"] for r in got if r["query_id"] == 5000] == [0, 1, 2, 3, 4]


def test_an_id_with_two_vectors_keeps_the_members_of_both(spark):
    rng = np.random.default_rng(4)
    u, w = rng.normal(size=(2, 16))
    rows = [(7, u), (7, w), (9, w), (50, u + 0.1 * w), (60, -u)]
    got = found(ann.nearest(table(spark, rows), table(spark, [rows[3]])))
    assert got == brute(rows, [rows[3]], 5) and 9 in got[50]


def test_copies_of_the_query_and_ties(spark):
    u = [1.0, 2.0, 3.0, 4.0]
    rows = [(i, u) for i in (3, 50, 51, 52, 53, 54, 55, 56)] + [(8, [x * 2 for x in u]), (9, [-x for x in u])]
    got = found(ann.nearest(table(spark, rows), table(spark, [(50, u)])))
    assert got == {50: [3, 8, 51, 52, 53]}


def test_a_sample_is_bounded_by_rows(spark, monkeypatch):
    seen = []

    class Recorder(quality_model.Network):
        def __init__(self, x, y):
            seen.append(len(y))
            super().__init__(x, y)

    monkeypatch.setattr(quality_model, "Network", Recorder)
    # id 1 and a few more are not in the held-out fold
    docs = spark.range(5000).selectExpr("1L as doc_id", "concat('words of row ', id % 50) as text")
    docs = docs.unionByName(spark.range(2, 12).selectExpr("id as doc_id", "'other words here' as text"))
    labels = spark.range(1, 12).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    vectors, _ = quality_model.train(docs, labels, sample=20)
    assert 1 < seen[0] <= 11
    quality_model.train(docs, labels, sample=1)
    assert seen[1] == 1


@pytest.fixture(scope="module")
def coders():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    tiktoken = pytest.importorskip("tiktoken")
    path = public_tokenizers.path(bpe.VOCABULARY)
    with open(path, "rb") as rows:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in rows if line.strip())}
    library = tiktoken.Encoding(
        "t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    return bpe.DuckBpe(path, public_tokenizers.PATTERN), library


def same(coders, text):
    ours, library = coders
    packed = ours.encode([text])[0]
    assert np.frombuffer(packed, "<i4").tolist() == library.encode_ordinary(text)
    assert ours.decode([packed])[0] == text.encode()


def test_long_words_of_few_and_many_letters(coders):
    rng = random.Random(5)
    for letters in ("ab", "eaotin", "abcdefghijklmnopqrstuvwxyz", "aéßж中"):
        for n in (5, 127, 128, 129, 300, 900):
            for _ in range(6):
                same(coders, "".join(rng.choice(letters) for _ in range(n)))


def test_words_of_a_hundred_thousand_letters(coders):
    rng = random.Random(6)
    same(coders, "a" * 100_000)
    same(coders, " " * 100_001 + "=" * 50_001)
    same(coders, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(100_000)))


def test_a_text_of_some_million_ids(coders):
    ours, _ = coders
    text = "one two, three\n" * 700_000
    packed = ours.encode([text, "", "x"])
    assert len(packed[0]) // 4 > 2 * bpe.STRETCH
    assert ours.decode(packed) == [text.encode(), b"", b"x"]


def test_the_cache_is_bounded_by_bytes(coders):
    ours, library = coders
    small = bpe.DuckBpe.__new__(bpe.DuckBpe)
    small.__dict__.update(ours.__dict__)
    small.known, small.held, small.cached = {}, 0, 5000
    for i in range(40):
        text = " ".join(f"qz{i}w{j}xx" for j in range(20))
        assert np.frombuffer(small.encode([text])[0], "<i4").tolist() == library.encode_ordinary(text)
        assert small.held <= 5000 + 120 * 400
