"""Profiles against brute force; the bounded profile and the salted join agree."""

import math
from collections import Counter

import pytest
from conftest import rows
from pyspark.sql import functions as F

from unitflow.operators import profiles

LABELS = ("aa", "bb")
DATA = [(0, 0, "aa", "abab ab"), (0, 1, "aa", "ba"), (1, 0, "bb", "cdcd"), (1, 1, "bb", "c😀d"),
        (2, 0, "bb", "a"), (3, 0, "aa", "ж"), (4, 0, "bb", "")]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame(DATA, "doc_id bigint, unit_idx bigint, lang string, text string")


def grams(text):
    return [text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)]


def brute_profile():
    counts = {x: Counter(g for *_, lang, t in DATA if lang == x for g in grams(t)) for x in LABELS}
    known = set().union(*counts.values())
    return {
        (x, g): round(math.log((c[g] + 1) / (sum(c.values()) + len(known))) * 1e6)
        for x, c in counts.items()
        for g in known
    }


def test_training(units):
    got = profiles.long_profiles(profiles.train_profiles(units, LABELS))
    assert {(r.lang, r.gram): r.logp for r in got.collect()} == brute_profile()


@pytest.mark.parametrize("max_bytes", [0, 10_000])
def test_classification(spark, units, max_bytes):
    trained = profiles.train_profiles(units, LABELS)
    asked = [(9, 0, "abc"), (9, 1, "dcd"), (9, 2, "zzz"), (9, 3, ""), (9, 4, "a😀zb"), (9, 5, "azb")]
    df = spark.createDataFrame(asked, "doc_id bigint, unit_idx bigint, text string")
    got = profiles.classify(df, trained, max_bytes=max_bytes)
    model, want = brute_profile(), []
    for d, u, t in asked:
        known = [g for g in grams(t) if ("aa", g) in model]
        if known:
            score = {x: sum(model[x, g] for g in known) for x in LABELS}
            want.append((d, u, max(sorted(LABELS), key=score.get)))
    assert rows(got, "doc_id", "unit_idx", "label") == want


def test_ties_go_to_the_first_name(spark):
    df = spark.createDataFrame([(1, 1), (1, 2), (None, None)], "b int, a int")
    label = profiles.best_label({"b": F.col("b"), "a": F.col("a")})
    assert [r[0] for r in df.select(label).collect()] == ["a", "a", None]


def test_only_open_units_are_classified(spark):
    trained = spark.createDataFrame([("a", -1, -2), ("ж", -2, -1)], "gram string, en bigint, ru bigint")
    data = [(1, 0, "a" * 30), (1, 1, "a" * 5), (1, 2, "ж" * 30), (1, 3, "a" * 20 + "ж" * 21), (1, 4, " ")]
    df = spark.createDataFrame(data, "doc_id bigint, unit_idx bigint, text string")
    got = profiles.detect_with_profiles(df, trained)
    assert rows(got, "unit_idx", "detected", "src_lang") == [
        (0, "en", "eng_Latn"),
        (1, None, "eng_Latn"),
        (2, None, "rus_Cyrl"),
        (3, "ru", "rus_Cyrl"),
        (4, None, "eng_Latn"),
    ]
