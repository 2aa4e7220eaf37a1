"""Golden rows of the source rule and the votes."""

import pytest
from conftest import rows
from pyspark.sql import functions as F

from unitflow.functions.language import detect_source, effective_source
from unitflow.operators import units, voting
from unitflow.options import ENGLISH, RUSSIAN, Options

OTHER = "xxx_Test"


@pytest.mark.parametrize(
    "value, want",
    [
        ("", OTHER),
        (" 　", OTHER),
        (None, OTHER),
        ("жжж", RUSSIAN),
        ("жж", RUSSIAN),  # too few to decide alone, but more than Latin
        ("жжжжжж aaaaa", RUSSIAN),  # exactly 1.2 x Latin: by count
        ("жжжжжжж aaaaa", RUSSIAN),
        ("жжж aaa", ENGLISH),  # a tie
        ("1" * 19, ENGLISH),  # short: no default
        ("1" * 20, OTHER),  # letterless
        ("1" * 18 + "жж", RUSSIAN),
        ("aaaaa" * 4 + "ж" * 20, ENGLISH),  # long tie
        ("aaaaa" * 4 + "ж" * 21, RUSSIAN),
        ("é" * 20, ENGLISH),
        ("中" * 20, ENGLISH),
    ],
)
def test_detect_source(spark, value, want):
    df = spark.createDataFrame([(value,)], "t string")
    assert df.select(detect_source(F.col("t"), OTHER)).first()[0] == want


@pytest.mark.parametrize(
    "label, want",
    [("ru", RUSSIAN), ("de", ENGLISH), ("uz", ENGLISH), ("bg", RUSSIAN), (None, RUSSIAN)],
)
def test_detector_decides_mixed_texts(spark, label, want):
    df = spark.createDataFrame([("aaaaa" * 4 + "ж" * 21, label)], "t string, label string")
    assert df.select(detect_source(F.col("t"), OTHER, F.col("label"))).first()[0] == want


def test_detector_is_not_asked_elsewhere(spark):
    df = spark.createDataFrame([("ж" * 30, "en"), ("abc", "ru")], "t string, label string")
    got = [r[0] for r in df.select(detect_source(F.col("t"), OTHER, F.col("label"))).collect()]
    assert got == [RUSSIAN, ENGLISH]


def test_effective_source(spark):
    df = spark.createDataFrame([("привет",)], "t string")
    for option, want in (("auto", RUSSIAN), (None, RUSSIAN), ("", RUSSIAN), (ENGLISH, ENGLISH)):
        assert df.select(effective_source(F.col("t"), option)).first()[0] == want
    with pytest.raises(ValueError):
        effective_source(F.col("t"), "deu_Latn")
    with pytest.raises(ValueError):
        Options(source="deu_Latn")


RU, EN = "русский текст", "english text"
DOCS = [
    (1, "\n".join([RU, EN])),  # a tie
    (2, "\n".join(["", " "])),  # no votes
    (3, "\n".join([EN] * 50 + [RU] * 200)),  # votes after the head are ignored
    (4, "\n".join(["", ""] + [RU] * 26 + [EN] * 24)),
    (5, "\n".join([RU, RU, EN])),
    (6, "1" * 25),  # a vote for the default only
]


def test_votes(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    voted = voting.document_source(units.explode_paragraphs(docs), default=OTHER)
    assert rows(voted, "doc_id", "src_lang") == [
        (1, ENGLISH), (3, ENGLISH), (4, RUSSIAN), (5, RUSSIAN), (6, OTHER),
    ]
    in_row = voting.with_document_source(docs, Options())
    assert rows(in_row, "doc_id", "src_lang") == [
        (1, ENGLISH), (2, ENGLISH), (3, ENGLISH), (4, RUSSIAN), (5, RUSSIAN), (6, ENGLISH),
    ]


def test_sentences_of_both_languages(spark):
    english = ["Please close the window before you leave.", "Our train departs at noon.", "Thanks!"]
    russian = ["Закройте окно перед уходом.", "Наш поезд отходит в полдень.", "Спасибо!"]
    df = spark.createDataFrame([(t,) for t in english + russian], "text string")
    got = [r.src_lang for r in voting.with_unit_source(df).collect()]
    assert got == [ENGLISH] * 3 + [RUSSIAN] * 3


def test_empty_documents_and_rejects(spark):
    docs = spark.createDataFrame(DOCS, "doc_id bigint, text string")
    empty = voting.empty_documents(docs, units.explode_paragraphs(docs))
    assert rows(empty, "doc_id") == [(2,)]
    coded = spark.createDataFrame(
        [("a", ENGLISH), ("b", None), ("c", "deu_Latn")], "text string, src_lang string"
    )
    ok, rejected = voting.split_supported(coded)
    assert rows(ok, "text") == [("a",)] and rows(rejected, "text") == [("b",), ("c",)]
    strict, _ = voting.split_supported(coded, strict=True)
    with pytest.raises(Exception, match="unsupported source"):
        strict.collect()


def test_file_source_takes_the_first_five_lines(spark):
    lines = [("f", i, EN) for i in range(5)] + [("f", i, RU) for i in range(5, 60)]
    lines += [("g", 0, RU)]
    df = spark.createDataFrame(lines, "path string, line_idx bigint, text string")
    assert rows(voting.file_source(df)) == [("f", ENGLISH), ("g", RUSSIAN)]
