"""Checks within a job, on batches and streams; DOCX files that are odd or damaged."""

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_sources import P, cell, table

from unitflow.operators import quality, writeback
from unitflow.plans.fixtures import docx_bytes
from unitflow.sources import docx



def rules():
    return {"non_empty": quality.non_empty(), "greets": quality.contains_any(["salom"])}


DATA = [("a", "Salom"), ("b", ""), ("c", None), (None, "x"), ("d", "salom d")] * 5


def units(spark):
    return spark.createDataFrame(DATA, "text string, translated string").repartition(3)


def test_observed_counts_are_those_of_check(spark, tmp_path):
    watched = quality.ObservedChecks(rules())
    watched.watch(units(spark)).write.parquet(str(tmp_path / "out"))
    assert rows(watched.report(spark)) == rows(quality.check(units(spark), rules()))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(DATA)


def test_watching_adds_no_job(spark, tmp_path):
    watched = quality.ObservedChecks(rules())
    rows_ = watched.watch(units(spark))
    spark.sparkContext.setJobGroup("watched", "one action")
    rows_.write.parquet(str(tmp_path / "out"))
    watched.report(spark)
    spark.sparkContext.setJobGroup("plain", "the same without")
    units(spark).write.parquet(str(tmp_path / "plain"))
    jobs = [len(spark.sparkContext.statusTracker().getJobIdsForGroup(g)) for g in ("watched", "plain")]
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[0] == jobs[1]


def test_a_stream_is_watched_batch_by_batch(spark, tmp_path):
    for i in range(2):
        units(spark).limit(5 * (i + 1)).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
    stream = (
        spark.readStream.schema("text string, translated string")
        .option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true")
        .parquet(str(tmp_path / "in"))
    )
    watched = quality.ObservedChecks(rules(), "stream_checks")
    query = (
        watched.watch(stream)
        .writeStream.format("parquet")
        .option("checkpointLocation", str(tmp_path / "ckpt"))
        .trigger(availableNow=True)
        .start(str(tmp_path / "out"))
    )
    query.awaitTermination()
    seen = [watched.of_progress(spark, p) for p in query.recentProgress]
    totals = [sum(r.passed + r.failed for r in s.where("rule = 'greets'").collect()) for s in seen if s]
    assert sorted(totals) == [5, 10]


def parsed(spark, content):
    df = spark.createDataFrame([(1, bytearray(content))], "doc_id bigint, content binary")
    return docx.parse_docx(df).orderBy("para_idx").collect()


def test_rows_that_begin_further_right(spark):
    before = '<w:trPr><w:gridBefore w:val="1"/></w:trPr>'
    body = table(
        [cell(P("a")), cell(P("b"), props='<w:vMerge w:val="restart"/>')],
        [cell(P("hidden"), props="<w:vMerge/>")],
    ).replace("<w:tr>", "<w:tr>", 1)
    second = body.rindex("<w:tr>")
    body = body[:second] + "<w:tr>" + before + body[second + len("<w:tr>") :]
    got = [(r.loc, r.runs) for r in parsed(spark, docx_bytes(body)) if r.loc.startswith("table")]
    assert got == [("table0_r0c0p0", ["a"]), ("table0_r0c1p0", ["b"]), ("table0_r1c0p0", ["b"])]


@pytest.mark.parametrize("odd", ["span", "stream", "encrypted", "xml"])
def test_a_bad_file_is_one_row_with_an_error(spark, odd):
    good = docx_bytes(P("text " * 200))
    if odd == "span":
        bad = docx_bytes(table([cell(P("x"), props='<w:gridSpan w:val="many"/>')]))
    elif odd == "stream":
        at = good.index(b"word/document.xml") + 40
        bad = good[:at] + bytes(b ^ 0xFF for b in good[at : at + 20]) + good[at + 20 :]
    elif odd == "encrypted":
        # the flag of an encrypted entry, in both headers
        bad = bytearray(good)
        bad[6] |= 1
        central = good.rindex(b"PK\x01\x02", 0, good.rindex(b"PK\x05\x06"))
        bad[good.index(b"PK\x01\x02") + 8] |= 1
        assert central
    else:
        bad = docx_bytes("<w:p>")
    got = parsed(spark, bytes(bad))
    assert len(got) == 1 and got[0].error and got[0].runs is None and got[0].loc is None


def test_a_document_without_pages(spark):
    pages = spark.createDataFrame([(1, 0), (2, 1), (3, None)], "doc_id bigint, n_pages bigint")
    none = spark.createDataFrame([], "doc_id bigint, unit_idx bigint, kind string, page bigint, bbox array<double>, text string, translated string")
    got = writeback.assemble_pages(none, None, pages)
    assert rows(got, "doc_id", "page", "n_items") == [(2, 0, 0)]
    assert got.agg(F.max("text")).first()[0] == "Sahifa 1"
