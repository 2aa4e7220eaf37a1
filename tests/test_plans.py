"""Physical plans: what is read, what is shuffled, what runs in Python."""

import re

import pytest
from conftest import executed_plan
from pyspark.sql import functions as F

from unitflow.operators import inference, units, voting, writeback
from unitflow.options import Options
from unitflow.plans import corpus, fixtures
from unitflow.session import materialise, shared_dir


@pytest.fixture(scope="module")
def docs(spark, small_dir):
    return fixtures.table(spark, small_dir, "documents", "doc_id", "text")


def operators(df, name):
    """Nodes of the plan tree (without their details) that carry a name."""
    tree = executed_plan(df).split("\n\n")[0]
    return len(re.findall(rf"\b{name} \(\d+\)|\b{name}\b", tree))


def test_units_and_votes_in_the_row_need_no_shuffle(docs):
    exploded = units.explode_paragraphs(docs)
    voted = voting.with_document_source(docs, Options())
    detected = voting.with_unit_source(exploded)
    for df in (exploded, voted, detected):
        assert operators(df, "Exchange") == 0 and "Python" not in executed_plan(df)


def test_vote_shuffles_counters_only(docs):
    plan = executed_plan(voting.document_source(units.explode_paragraphs(docs)))
    assert plan.split("\n\n")[0].count("Exchange") == 1
    exchange = re.search(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan).group(1)
    assert "text" not in exchange and "partial_count" in plan


def test_scan_reads_two_columns(docs):
    plan = executed_plan(units.explode_paragraphs(docs))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_translation_is_one_python_step_without_shuffle(docs):
    rows_ = voting.with_unit_source(units.explode_paragraphs(docs))
    done = inference.translate_rows(rows_, inference.stub_translator, Options())
    assert operators(done, "Exchange") == 0 and operators(done, "ArrowEvalPython") == 1
    step = re.search(r"\) ArrowEvalPython\nInput.*\nArguments: (.*)", executed_plan(done)).group(1)
    assert "_body" in step and "src_lang" in step


def test_filter_on_a_translation_does_not_translate_twice(docs):
    rows_ = voting.with_unit_source(units.explode_paragraphs(docs))
    done = inference.translate_rows(rows_, inference.stub_translator, Options())
    assert operators(done.filter(F.col("translated") != ""), "ArrowEvalPython") == 1


def test_corpus_without_dedup_is_one_shuffle(spark, docs):
    done = corpus.translate_corpus(
        spark, docs, inference.stub_translator, Options(dedup=False)
    )
    assert operators(done, "Exchange") == 1


def test_join_of_copies_pushes_no_detection_to_the_scan(spark, docs):
    done = corpus.translate_corpus(spark, docs, inference.stub_translator)
    below = executed_plan(done).split("Generate\n")[0]
    filters = [c for c in re.findall(r"Condition : (.*)", below) if "aggregate(" in c]
    assert filters == []


def test_head_is_cut_before_the_shuffle(docs):
    exploded = units.explode_paragraphs(docs)
    assert operators(units.head_n(exploded, 5), "WindowGroupLimit") == 2
    preview = executed_plan(units.preview(exploded, 5))
    assert "Window" not in preview and "Exchange" not in preview


def test_images_are_combined_before_the_shuffle(docs):
    plan = executed_plan(writeback.page_images(fixtures.images(docs)))
    assert "partial_min" in plan and "Window" not in plan


def test_numbering_spans_shuffles_them_once(spark, docs):
    """Blocks are counted beside it: the other exchanges carry numbers only."""
    layout = materialise(fixtures.layout_docs(docs))
    plan = executed_plan(units.explode_spans(layout))
    shuffled = re.findall(r"\(\d+\) Exchange\nInput \[\d+\]: \[(.*)\]", plan)
    assert len([columns for columns in shuffled if "_spans" in columns]) == 1


def test_shared_folder_is_read_from_the_session(spark):
    assert spark.conf.get("spark.checkpoint.dir") == shared_dir(spark)
