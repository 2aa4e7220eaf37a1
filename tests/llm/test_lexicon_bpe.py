"""Byte-pair encoding through a lexicon, against the library."""

from __future__ import annotations

import itertools
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from unitflow.llm import lexicon_bpe

MARK = "<|endoftext|>"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def merger():
    return lexicon_bpe.Merger(None)


@pytest.fixture(scope="module")
def encoder(merger, tmp_path_factory):
    words = ["the", " the", "The", " of", " of,", "\nIn", " été", " a", "a", " the.", "x" * 80]
    path = tmp_path_factory.mktemp("lexicon") / "lexicon.bin"
    path.write_bytes(lexicon_bpe.compile_lexicon(words, merger.words))
    return lexicon_bpe.Encoder(merger, lexicon_bpe.Lexicon(str(path)))


def ids_of(packed):
    return np.frombuffer(packed, dtype="<u4").tolist()


def test_automaton_is_least_and_numbers_its_words():
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(0, 7))) for _ in range(500)})
    words = [w.encode() for w in words]
    states = lexicon_bpe.minimal_automaton(words)
    # as many states as there are different sets of endings, the start apart
    prefixes = {w[:i] for w in words for i in range(len(w) + 1)}
    endings = {frozenset(w[len(p) :] for w in words if w.startswith(p)) for p in prefixes}
    assert len(states) in (len(endings), len(endings) + 1)
    lexicon = lexicon_bpe.Lexicon.__new__(lexicon_bpe.Lexicon)
    tables = lexicon_bpe.flat_tables(states)
    for name in ("base", "final", "check", "target", "add"):
        setattr(lexicon, name, tables[name])
    lexicon.start = len(states) - 1
    probes = ["".join(p).encode() for n in range(7) for p in itertools.product("abd", repeat=n)]
    place = {w: i for i, w in enumerate(words)}
    assert lexicon.places(probes).tolist() == [place.get(p, -1) for p in probes]


def test_words_must_ascend():
    with pytest.raises(ValueError):
        lexicon_bpe.minimal_automaton([b"b", b"a"])


TEXTS = [
    "",
    " ",
    "the of the of, été the. The",
    "  the\n\nIn  of \n the\t the \x0b\x1c the",
    f"a{MARK}the {MARK}{MARK} of",
    f"{MARK}",
    "it's we're I'll 'tis 3's  　x",
    "日本語 текст \U0001f600\U0001f600 ՘'s! 1ֈ's",
    "é" * 3000 + " " * 500 + "y" * 3000,
    "\x00\x01 �﻿",
]


def test_encode_and_decode_are_the_library_s(encoder, library):
    for text, packed in zip(TEXTS, encoder.encode(TEXTS), strict=True):
        ids = library.encode(text, add_special_tokens=False).ids
        assert ids_of(packed) == ids, text[:40]
        assert encoder.merger.decode(packed) == library.decode(ids, skip_special_tokens=False)


def test_code_points_between_letters_digits_and_marks(encoder, library):
    points = [c for c in range(0x3000) if not 0xD800 <= c < 0xE000] + list(range(0x1F5F0, 0x1F650))
    texts = [f"a{chr(c)}b {chr(c)} {chr(c)}{chr(c)}x 1{chr(c)}2 {chr(c)}'s!{chr(c)}!  " for c in points]
    packed = encoder.encode(texts)
    coded = library.encode_batch(texts, add_special_tokens=False)
    assert [ids_of(p) for p in packed] == [c.ids for c in coded]


def test_long_texts_are_taken_whole(encoder, library, monkeypatch):
    monkeypatch.setattr(lexicon_bpe, "LONG", 50)
    monkeypatch.setattr(lexicon_bpe, "WORDS_AT_ONCE", 3)
    monkeypatch.setattr(lexicon_bpe, "IDS_AT_ONCE", 5)
    text = " ".join(TEXTS)
    (packed,) = encoder.encode([text])
    assert ids_of(packed) == library.encode(text, add_special_tokens=False).ids
    assert encoder.merger.decode(packed) == text


def test_what_is_remembered_is_bounded(merger, library, monkeypatch):
    monkeypatch.setattr(lexicon_bpe, "REMEMBERED", 10)
    for low in range(0, 100, 5):
        merger.words([f" word{i}" for i in range(low, low + 5)])
        assert len(merger.merged) <= 15 and len(merger.pieces) <= 25


def test_frequent_words_are_the_shared_ones(spark):
    texts = ["a b c"] * 50 + ["a " + " ".join(f"w{i}" for i in range(100))] + [None, "", "x" * 100]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(4)
    counted = {r.word: r.n for r in lexicon_bpe.word_counts(docs).collect()}
    assert counted["a"] == 51 and counted[" b"] == 50 and "x" * 100 not in counted
    assert sorted(lexicon_bpe.frequent_words(docs, share=6)) == [" b", " c", "a"]


def test_documents_with_nulls_repeats_and_other_columns(spark, library):
    rows = [(1, "the of the", "x"), (1, "the of the", "y"), (None, "of", None), (3, None, ""), (4, "", "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    for share in (2, 100_000):
        got = lexicon_bpe.encode_decode(docs, share=share).collect()
        assert sorted(repr((r.doc_id, ids_of(r.ids), r.decoded)) for r in got) == sorted(
            repr((i, library.encode(t or "", add_special_tokens=False).ids, t or "")) for i, t, _ in rows
        )
    assert lexicon_bpe.encode_decode(docs.limit(0)).collect() == []


def test_query_is_the_library_s(spark, small_dir, library):
    import hashlib

    import pyarrow.parquet as pq

    from unitflow.llm.queries import op13_lexicon_bpe

    table = pq.read_table(f"{small_dir}/documents.parquet").to_pydict()
    want = []
    for i, text in zip(table["doc_id"], table["text"], strict=True):
        ids = library.encode(text or "", add_special_tokens=False).ids
        packed = np.array(ids, dtype="<u4").tobytes()
        text = library.decode(ids, skip_special_tokens=False)
        shas = [hashlib.sha256(b).hexdigest() for b in (packed, text.encode())]
        want.append((i, len(ids), *shas))
    assert sorted(map(tuple, op13_lexicon_bpe(spark, small_dir).collect())) == sorted(want)
