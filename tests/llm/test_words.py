"""Words cut on bytes and coded once, against the library."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from unitflow.llm import lexicon_bpe, token_files, words

SETTLED = words.SETTLED
WHITE = words.SPACE + "\x1c\x1f" + chr(0x200B)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def random_texts(n: int) -> list[str]:
    rng = random.Random(5)
    letters = WHITE + "   \n\nabst'éɏɐж語à²12.!\0<"
    return ["", *("".join(rng.choices(letters, k=rng.randint(0, 50))) for _ in range(n))]


def ids_of(packed):
    return [np.frombuffer(p, "<u4").tolist() for p in packed]


def test_random_texts_are_coded_as_the_library_does(library):
    texts = random_texts(3000)
    want = [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]
    tokens = token_files.Tokens(None)
    assert ids_of(tokens.encode(texts)) == want
    # parts of a larger array, in small groups, with what is known by now
    held = pa.array(["other words", *texts]).slice(1)
    got = [(at, ids_of(tokens.encode(some))) for at, some in words.text_groups(held, 200)]
    assert len(got) > 100 and [want[at] for at, _ in got] == [ids for _, ids in got]
    assert list(range(len(texts))) == [i for at, _ in got for i in range(at.start, at.stop)]


def test_words_are_the_text_and_end_before_white_space():
    texts = random_texts(500)
    found, first = words.cut(pa.array(texts, pa.string()))
    found = found.to_pylist()
    for text, low, high in zip(texts, first, first[1:], strict=False):
        own = found[low:high]
        assert "".join(own) == text
        assert all(w[-1] not in words.SPACE and w.strip(words.SPACE) for w in own[:-1])
        assert all(w[0] in words.SPACE for w in own[1:])


def test_a_piece_goes_to_the_model_once_whatever_white_space_the_text_has():
    tokens = token_files.Tokens(None)
    calls = []

    class Model:
        def tokenize(self, piece, own=tokens.model):
            calls.append(piece)
            return own.tokenize(piece)

    texts = [f"head{i % 3} of\tthe words of\x0bthe, words of the" for i in range(200)]
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    tokens.model, tokens.tokenizer = Model(), None
    assert ids_of(tokens.encode(texts)) == want
    assert len(calls) == len(set(calls)) <= 15
    assert len(set(calls)) == len(tokens.pieces)


def test_what_is_known_is_bounded():
    coder = words.WordIds(public_tokenizers.path("byte_bpe_50k.json"))
    for low in range(0, 100, 5):
        coder.pack(pa.array([f" word{i}" for i in range(low, low + 5)] + [f"ж{low}", " " + "x" * 80]), 10)
        assert len(coder.pieces) <= 25 and len(coder.merged) <= 12
        assert " " + "x" * 80 not in coder.pieces


def test_lexicon_codes_arrays_and_only_unseen_words_are_merged_once(library, tmp_path):
    merger = lexicon_bpe.Merger(None)
    held = ["the", " the", " of", "\nIn", " été"]
    (tmp_path / "lexicon.bin").write_bytes(lexicon_bpe.compile_lexicon(held, merger.words))
    encoder = lexicon_bpe.Encoder(merger, lexicon_bpe.Lexicon(str(tmp_path / "lexicon.bin")))
    merged = []
    pack = merger.packed_words
    merger.packed_words = lambda some: merged.append(some.to_pylist()) or pack(some)
    texts = ["the of the été\nIn ofx thx", "the ofx ofx of", "", "the<|endoftext|> ofx", *random_texts(300)]
    got = ids_of(encoder.encode(pa.array(["x", *texts]).slice(1)))
    assert got == [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]
    assert all(len(some) == len(set(some)) and not set(some) & set(held) for some in merged)
    assert sum(" ofx" in some for some in merged) == 1 + 1  # the plain texts together, and the one with a mark


def test_long_texts_and_short_ones_are_counted_alike(spark):
    rows = [("a b\u00a0b " * 200_000,), ("a b " * 10 + "y" * 65 + " z",), ("",), (None,)]
    docs = spark.createDataFrame(rows, "text string").coalesce(1)
    counted = {r.word: r.n for r in lexicon_bpe.word_counts(docs).collect()}
    assert len(rows[0][0]) > lexicon_bpe.LONG
    assert counted == {"a": 2, " a": 200_008, " b": 200_010, "\u00a0b": 200_000, " z": 1, " ": 1}


def test_words_of_any_script_are_coded_as_the_library_does(library):
    rng = random.Random(7)
    points = [c for c in range(SETTLED, 0x110000) if not 0xD800 <= c < 0xE000]
    # unassigned and recent ones too: the two libraries need not be of one Unicode version
    texts = ["".join(f"a{chr(c)}1{chr(c)}{chr(c)} {chr(c)}!{chr(c)}'s" for c in rng.sample(points, 4)) for _ in range(4000)]
    want = [c.ids for c in library.encode_batch(texts, add_special_tokens=False)]
    assert ids_of(token_files.Tokens(None).encode(texts)) == want


def test_words_of_other_scripts_are_cut_into_pieces_that_are_remembered():
    tokens = token_files.Tokens(None)
    texts = [f"{a},{b}" for a in ("слово", "речь", "語言") for b in ("слово", "речь", "語言")]
    want = [tokens.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert ids_of(tokens.encode(texts)) == want
    assert set(tokens.pieces) == {"слово", "речь", "語言", ","}
