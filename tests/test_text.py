"""Golden rows and properties of the text functions."""

import random
import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from unitflow.functions import text

SPACES = [chr(c) for c in range(0x3100) if chr(c).isspace()]


def one_column(spark, values, expr):
    df = spark.createDataFrame(list(enumerate(values)), "i int, t string")
    return [r[0] for r in df.orderBy("i").select(expr(F.col("t"))).collect()]


def test_strip_knows_every_space(spark):
    assert sorted(text.WHITESPACE) == sorted(SPACES) and len(SPACES) == 29
    values = [s + "a b" + s for s in SPACES] + ["".join(SPACES), "", None]
    want = ["a b"] * 29 + ["", "", None]
    assert one_column(spark, values, text.strip_ws) == want


def test_blank(spark):
    values = [None, "", "  \x1c", "​", " x "]
    assert one_column(spark, values, text.is_blank) == [True, True, True, False, False]


def test_normalize_maps_each_character(spark):
    values = [f"a {c} b" for c in text.APOSTROPHES + text.QUOTES + text.DASHES + " "]
    want = ["a ' b"] * 12 + ['a " b'] * 5 + ["a - b"] * 2 + ["a   b"]
    assert one_column(spark, values, text.normalize_uz) == want


@pytest.mark.parametrize(
    "given_text, want",
    [
        ("o?zbek", "o'zbek"),
        ("G?a", "G'a"),
        ("o??a", "o??a"),
        ("a?b?c", "a'b'c"),
        ("why?", "why?"),
        ("?", "?"),
        ("", ""),
        ("o?'", "o''"),
        ("a?'", "a?'"),
        ("o?ʻ", "o''"),
        ("1?b", "1?b"),
        ("o?o?o?o", "o'o'o'o"),
    ],
)
def test_normalize_lost_apostrophes(spark, given_text, want):
    assert one_column(spark, [given_text], text.normalize_uz) == [want]


def lost_apostrophes(value):
    """Brute force, one question mark at a time: marks of the first rule, then of the second."""
    mapped = [
        "'" if c in text.APOSTROPHES
        else '"' if c in text.QUOTES
        else "-" if c in text.DASHES
        else " " if c == " "
        else c
        for c in value
    ]
    letter = lambda c: c.isascii() and c.isalpha()
    for before, after in (
        (lambda c: c in "OoGg", lambda c: letter(c) or c == "'"),
        (letter, letter),
    ):
        marks = [
            i
            for i in range(1, len(mapped) - 1)
            if mapped[i] == "?" and before(mapped[i - 1]) and after(mapped[i + 1])
        ]
        for i in marks:
            mapped[i] = "'"
    return "".join(mapped)


@settings(max_examples=5, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text("oOgGaz?'’ʻ«—  1б", max_size=12), min_size=50, max_size=200))
def test_normalize_equals_brute_force_and_is_idempotent(spark, values):
    once = one_column(spark, values, text.normalize_uz)
    assert once == [lost_apostrophes(v) for v in values]
    assert one_column(spark, once, text.normalize_uz) == once


def test_script_counts(spark):
    values = ["Привет, world 12", "ёЁЀӿԀ", "é ñ", ""]
    got = one_column(spark, values, text.script_counts)
    assert [tuple(r) for r in got] == [(6, 5), (4, 0), (0, 0), (0, 0)]


def test_lines_split_like_a_text_file(spark):
    breaks = ["\n", "\r", "\r\n", "\x0b", "\x0c", "\x1c", "\x1d", "\x1e", "\x85", " ", " "]
    value = "".join(f"l{i}{b}" for i, b in enumerate(breaks)) + "end"
    got = one_column(spark, [value], lambda c: text.split_lines(c, text.LINE_BREAKS))
    assert got == [value.splitlines()]


@pytest.mark.parametrize(
    "runs, new, want",
    [
        ([], "x", ["x"]),
        ([], "", []),
        (["", ""], "x", ["x", ""]),
        (["", "b", "c"], "x", ["", "x", ""]),
        (["a"], "x", ["x"]),
        (["a", "b"], "", ["", ""]),
    ],
)
def test_replace_runs(spark, runs, new, want):
    df = spark.createDataFrame([(runs, new)], "runs array<string>, new string")
    assert df.select(text.replace_runs(F.col("runs"), F.col("new"))).first()[0] == want


def test_tokens_to_text(spark):
    values = [
        ["uzn_Latn", "▁Sa", "lom", "▁do?st"],
        ["__x__", "▁a"],
        ["▁a", "uzn_Latn"],
        ["uzn_Latn"],
        [],
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, t array<string>")
    got = [r[0] for r in df.orderBy("i").select(text.tokens_to_text(F.col("t"))).collect()]
    assert got == ["Salom do'st", "a", "auzn_Latn", "", ""]


def test_final_text(spark):
    df = spark.createDataFrame(
        [("", "o?z"), (None, "o?z"), ("a", "b"), (None, None)], "tr string, t string"
    )
    got = [r[0] for r in df.select(text.final_text(F.col("tr"), F.col("t"))).collect()]
    assert got == ["o'z", "o'z", "a", ""]


def test_grams_equal_brute_force(spark):
    from unitflow.functions.ngrams import char_grams, longest_grams

    rng = random.Random(7)
    values = ["".join(rng.choice("ab é\nЖ😀") for _ in range(n)) for n in (0, 1, 2, 3, 9, 40)]
    assert all(unicodedata.is_normalized("NFC", v) for v in values)
    want = [
        sorted(v[i : i + n] for n in (1, 2, 3) for i in range(len(v) - n + 1)) for v in values
    ]
    assert [sorted(g) for g in one_column(spark, values, char_grams)] == want
    assert one_column(spark, values, longest_grams) == [
        [v[i : i + 3] for i in range(len(v))] for v in values
    ]
