"""The detector inside the row against gram counting and against the joined classifier."""

import random

import numpy as np
import pytest
from conftest import executed_plan, rows
from pyspark.sql import functions as F

from unitflow.operators import detector, inference, profiles, voting
from unitflow.options import ENGLISH, RUSSIAN, Options
from unitflow.plans.corpus import translate_lines, with_voted_source

LABELS = ("ru", "en", "pl")
LETTERS = {"en": "abcdefgh ", "ru": "абвгдежз ", "pl": "ąćęłńóśż "}


def text_of(lang, n, seed):
    rng = random.Random(f"{lang}{seed}")
    return "".join(rng.choice(LETTERS[lang]) for _ in range(n))


@pytest.fixture(scope="module")
def labelled(spark):
    data = [(i, k, lang, text_of(lang, 40, i * 9 + k)) for i, lang in enumerate(LABELS) for k in range(8)]
    return spark.createDataFrame(data, "doc_id bigint, unit_idx bigint, lang string, text string")


@pytest.fixture(scope="module")
def trained(labelled):
    return profiles.train_profiles(labelled, LABELS).cache()


@pytest.fixture(scope="module")
def profile(trained):
    return detector.load_profile(trained)


def test_keys_tell_all_grams_apart():
    grams = ["a", "a\x00", "a\x00\x00", "\x00", "\x00a", "\U0010ffff" * 3, "\U0010ffff", "ab", "ba", "abc"]
    assert len({detector.gram_key(g) for g in grams}) == len(grams)
    assert all(0 < detector.gram_key(g) < 2**63 for g in grams)


def test_labels_are_those_of_the_joined_classifier(spark, trained, profile):
    texts = ["a", "ж", "ab дв", "", "123", "😀a", "q", *[text_of(x, 30, 99) + "b" for x in LABELS]]
    units = spark.createDataFrame(
        [(0, i, t) for i, t in enumerate(texts)], "doc_id bigint, unit_idx bigint, text string"
    )
    joined = dict(profiles.classify(units, trained).select("unit_idx", "label").collect())
    assert profile.detect(texts) == [joined.get(i) for i in range(len(texts))]
    assert profile.detect([None, *texts])[1:] == profile.detect(texts)


def test_pieces_and_batches_change_nothing(profile, monkeypatch):
    texts = [text_of(x, n, n) for x in LABELS for n in (1, 2, 3, 50, 333)] + ["", None]
    want = profile.detect(texts)
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(detector, "SLICE_CHARS", size)
        assert profile.detect(texts) == want
    assert [profile.detect([t])[0] for t in texts] == want


def test_ties_go_to_the_first_name():
    tied = detector.Profile(["b", "a"], np.array([detector.gram_key("x")]), np.array([[5, 5]]))
    assert tied.detect(["x", "y", "xx"]) == ["a", None, "a"]
    empty = detector.Profile(["a"], np.array([], dtype=np.int64), np.zeros((0, 1), dtype=np.int64))
    assert empty.detect(["x"]) == [None]


def test_a_profile_beyond_its_bound_is_refused(trained):
    with pytest.raises(ValueError, match="more than 100"):
        detector.load_profile(trained, 100)


MIXED = "абв abcdefgh abcdefgh " + "ąćęłńóśż" * 2


def test_vote_in_the_row_is_the_vote_over_units(spark, profile):
    texts = ["\n".join([text_of("ru", 30, 1), MIXED, text_of("en", 30, 2)] * k) for k in (1, 2, 30)]
    texts += ["", None, " \n\t", "ж", "абв " * 10 + "\n" + MIXED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    from unitflow.operators.units import explode_paragraphs

    for head in (1, 2, 50):
        opts = Options(profiles=profile, vote_head=head)
        in_row = dict(voting.with_document_source(docs, opts).select("doc_id", "src_lang").collect())
        votes = voting.document_source(explode_paragraphs(docs), head, detector=profile)
        voted = dict(votes.select("doc_id", "src_lang").collect())
        assert in_row == {i: voted.get(i, ENGLISH) for i in range(len(texts))}


def test_jobs_ask_the_detector(spark, labelled, profile):
    class Says:
        """A detector that takes every text it is asked for Russian."""

        labels = ["ru"]

        def detect(self, texts):
            return [None if t is None else "ru" for t in texts]

    opts = Options(profiles=Says(), dedup=False)
    latin = spark.createDataFrame(
        [(0, 0, "plain latin words in a line"), (0, 1, "short"), (1, 0, "1234567890 1234567890 12")],
        "doc_id bigint, unit_idx bigint, text string",
    )
    done = inference.translate_units(latin, inference.stub_translator, opts)
    assert rows(done, "doc_id", "unit_idx", "src_lang") == [(0, 0, RUSSIAN), (0, 1, ENGLISH), (1, 0, ENGLISH)]
    voted = with_voted_source(latin, Options(profiles=Says(), vote_head=1))
    assert rows(voted.select("doc_id", "src_lang").distinct()) == [(0, RUSSIAN), (1, ENGLISH)]
    lines = latin.selectExpr("doc_id as path", "unit_idx as line_idx", "text")
    done = translate_lines(lines, inference.stub_translator, opts)
    assert rows(done.select("path", "src_lang").distinct()) == [(0, RUSSIAN), (1, ENGLISH)]


def test_no_gram_becomes_a_row(spark, profile):
    docs = spark.range(10).select(F.col("id").alias("doc_id"), F.lit(MIXED).alias("text"))
    plan = executed_plan(voting.with_document_source(docs, Options(profiles=profile)))
    assert "Exchange" not in plan and "Generate" not in plan and "Join" not in plan
    assert plan.count("ArrowEvalPython") > 0
