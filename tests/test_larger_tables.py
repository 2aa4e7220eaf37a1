"""What the registered queries and their steps need on larger tables."""

from conftest import rows
from pyspark.sql import functions as F

from unitflow.functions import text
from unitflow.operators import inference, memory, units, writeback
from unitflow.options import Options
from unitflow.plans import corpus, folder, queries
from unitflow.sources import ledger

STUB = inference.stub_translator
TEXTS = ["Hello\n\n world? \n", "привет мир\nx", "  \n\t", "о'zbek tili", None]


def _documents(spark, path, parts):
    given = [(i, t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(given, "doc_id bigint, text string").repartition(parts).write.parquet(path)


def test_streams_read_a_table_of_several_files(spark, tmp_path):
    _documents(spark, str(tmp_path / "documents.parquet"), 3)
    for name, want in (("stream_docs", "translate_corpus"), ("stream_lines", None)):
        got = queries.QUERIES[name](spark, str(tmp_path))
        if want:
            assert rows(got) == rows(queries.QUERIES[want](spark, str(tmp_path)))
        assert got.count() > 0


def test_streams_read_a_table_of_one_file(spark, tmp_path):
    _documents(spark, str(tmp_path / "made"), 1)
    (part,) = (tmp_path / "made").glob("part-*.parquet")
    (tmp_path / "documents.parquet").write_bytes(part.read_bytes())
    got = queries.QUERIES["stream_docs"](spark, str(tmp_path))
    assert rows(got) == rows(queries.QUERIES["translate_corpus"](spark, str(tmp_path)))


def test_arriving_pages_are_not_one_file(spark, tmp_path, monkeypatch):
    """one task wrote half of all pages."""
    made = [(i, "\n".join(f"line {i} {k}" for k in range(20))) for i in range(40)]
    table = spark.createDataFrame(made, "doc_id bigint, text string")
    table.repartition(8).write.parquet(str(tmp_path / "documents.parquet"))
    paths = []
    fresh = queries.fresh_path
    monkeypatch.setattr(queries, "fresh_path", lambda s, label: paths.append(fresh(s, label)) or paths[-1])
    monkeypatch.setattr(queries.fixtures, "spread", lambda df, *keys: df)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = queries.QUERIES["stream_layout"](spark, str(tmp_path))
        assert got.count() == 120 and got.filter("status <> 'complete'").count() == 0
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    (pages,) = [p for p in paths if "/pages-" in p]
    assert len(spark.read.parquet(pages).inputFiles()) > 2


def test_a_batch_of_known_texts_writes_no_text(spark, tmp_path, monkeypatch):
    """every batch wrote its texts twice and what is known of them once."""
    rows_ = units.explode_paragraphs(spark.createDataFrame([(1, "a\nb\na"), (2, "b\nc")], "doc_id long, text string"))
    opts = Options(memory=str(tmp_path / "memory"))
    first = rows(inference.translate_units(rows_, STUB, opts, batch="0"), "doc_id", "unit_idx", "translated")
    written, write = [], memory.materialise
    monkeypatch.setattr(memory, "materialise", lambda df, *a: written.extend(df.dtypes) or write(df, *a))
    again = inference.translate_units(rows_, STUB, opts, batch="1")
    assert rows(again, "doc_id", "unit_idx", "translated") == first and len(first) == 5
    assert "string" not in {kind for _, kind in written}


def test_a_small_batch_takes_its_own_out_of_the_memory(spark, tmp_path):
    opts = Options(memory=str(tmp_path / "memory"))
    many = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "unit_idx long, text string")
    inference.translate_units(many, STUB, opts, batch="0").count()
    few = inference.translate_units(many.where("unit_idx < 3"), STUB, opts, batch="1")
    assert [r.translated[-2:] for r in few.sort("unit_idx").collect()] == ["t0", "t1", "t2"]
    held = memory.TranslationMemory(spark, opts.memory, opts)
    keys = inference.counted_keys(inference.with_unit_source(many.where("unit_idx < 3")))
    assert held.told(keys).count() == 3 and held.known().count() == 50


def test_tokens_are_made_once(spark):
    """F8: an expression with a lambda in it was evaluated again at every place that named it."""
    df = spark.createDataFrame([("uzn_Latn o?zbek",)], "t string")
    tokens = F.expr("transform(split(t, ' '), w -> concat('_', w))")
    plan = df.select(text.tokens_to_text(tokens).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(") == 1


def test_lost_apostrophes_in_one_pass(spark):
    made = ["o?zbek g?'alaba", "a?o?b", "o??x", "?o?", "O?'? G?a?g?", "a?1", "qo?n?o?q", "", None]
    df = spark.createDataFrame([(t,) for t in made], "t string")
    twice = F.regexp_replace(
        F.regexp_replace("t", text.LOST_AFTER_O_OR_G, "'"), text.LOST_BETWEEN_LETTERS, "'"
    )
    got = df.select(text.normalize_uz(F.col("t")).alias("a"), twice.alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got]


def test_a_scan_of_few_splits_a_core_is_spread(spark, tmp_path):
    """F8: a table of one row group and many splits stayed in one task."""
    from unitflow.session import spread

    path = str(tmp_path / "one")
    spark.range(50_000).selectExpr("id", "sha2(string(id), 256) as t").coalesce(1).write.parquet(path)
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    size = sum(p.stat().st_size for p in (tmp_path / "one").glob("*.parquet"))
    spark.conf.set(key, size // (spark.sparkContext.defaultParallelism + 1))
    try:
        df = spark.read.parquet(path)
        counts = df.mapInArrow(lambda bs: bs, df.schema).select(F.spark_partition_id().alias("p"))
        assert counts.distinct().count() == 1
        assert spread(df, "id", even=4).select(F.spark_partition_id().alias("p")).distinct().count() > 8
    finally:
        spark.conf.set(key, before)


def test_only_long_pages_are_ranked(spark, monkeypatch):
    """all items were written and cut into ranges for the few pages that have parts."""
    made = [(d, p, i, f"t{i}") for d, p, n in ((1, 0, 5), (1, 1, 2), (2, 0, 1)) for i in range(n)]
    spans = spark.createDataFrame(made, "doc_id long, page long, unit_idx long, text string").selectExpr(
        "*", "'pdf_span' as kind", "array(0D, cast(unit_idx as double), 1D, 1D) as bbox", "text as translated"
    )
    cut = writeback.assemble_pages(spans, part_items=3)
    whole = {(1, 0, 0): 2, (1, 0, 1): 3, (1, 1, 0): 2, (2, 0, 0): 1}  # a page's own row is an item
    assert {(r.doc_id, r.page, r.part): r.n_items for r in cut.collect()} == whole
    assert [r.text for r in cut.where("doc_id = 1 and page = 0").sort("part").collect()][1] == "t2\nt3\nt4"

    def never(items):
        raise AssertionError("no page is long")

    monkeypatch.setattr(writeback, "_ranked", never)
    assert writeback.assemble_pages(spans, part_items=6).count() == 3


def test_paragraphs_keep_what_is_around_an_empty_translation(spark):
    """each paragraph's text went through the join with its translation."""

    def some(options):
        return lambda texts, source, target: ["" if "?" in t else f"<{t}>" for t in texts]

    made = [(1, " \u00a0o?n a?b\t\n\n  \nplain \n\u00a0?\u2003"), (2, " x "), (3, " "), (4, "\u2014o?n\u2014 ")]
    docs = spark.createDataFrame(made, "doc_id long, text string")
    got = corpus.translate_corpus(spark, docs, some)
    assert rows(got) == rows(corpus.translate_corpus(spark, docs, some, Options(dedup=False)))
    assert "_own" in got._jdf.queryExecution().optimizedPlan().toString()


def test_written_tables_are_compressed_hard(spark):
    from unitflow.session import discard, materialise

    made = materialise(spark.range(3))
    assert all(".zstd." in f for f in made.inputFiles())
    discard(made)


def test_commits_are_read_by_one_job(spark, tmp_path):
    """a job for each commit, at every commit."""
    book = ledger.Ledger(spark, str(tmp_path / "book"), spark.range(0).schema)
    for i in range(5):
        book.commit(None, f"b{i}")
    spark.sparkContext.setJobGroup("commits", "commits")
    assert len(book.commits()) == 5
    jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("commits")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(jobs) <= 2


def test_a_wave_reads_its_own_files_alone(spark, tmp_path, monkeypatch):
    """every wave read the list of all files, a file for each few of them."""
    docs = spark.createDataFrame([(i, f"Hello {i}", "en", "web") for i in range(3, 43)], "doc_id long, text string, lang string, source string")
    source = queries.fixtures.docx_folder(docs, str(tmp_path / "in"))
    written, write = {}, folder.materialise
    monkeypatch.setattr(folder, "materialise", lambda df, label, *by: written.setdefault(label, by) and None or write(df, label, *by))
    done = folder.translate_folder(spark, source, str(tmp_path / "out"), STUB, wave_files=15)
    assert done.filter("status = 'translated'").count() == 40
    assert written["folder-files"] == ("wave",)
    assert len(folder.records(spark, str(tmp_path / "out")).commits()) == 3


def test_a_folder_is_listed_by_few_tasks_and_leaves_no_tables(spark, tmp_path, monkeypatch):
    """the list of files was shuffled with a task for every few of them; waves left their tables behind."""
    from unitflow import session

    docs = spark.createDataFrame([(i, f"Hello {i}", "en", "web") for i in range(3, 49)], "doc_id long, text string, lang string, source string")
    source = queries.fixtures.docx_folder(docs, str(tmp_path / "in"))
    made, write = [], session.fresh_path
    monkeypatch.setattr(session, "fresh_path", lambda s, label: made.append(write(s, label)) or made[-1])
    sc, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    sc.setJobGroup("folder", "folder")
    with session.setting(spark, "spark.sql.files.maxPartitionBytes", "65536"):
        done = folder.translate_folder(spark, source, str(tmp_path / "out"), STUB, wave_files=30)
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert done.filter("status = 'translated'").count() == 46
    infos = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("folder") for s in tracker.getJobInfo(j).stageIds]
    assert infos and max(i.numTasks for i in infos if i) <= 4 * sc.defaultParallelism
    assert len(made) > 8 and not [p for p in made if session.exists(spark, p)]


def test_an_empty_translation_leaves_a_paragraph_as_it_is(spark):
    """paragraphs go to their translations without their text."""

    def some(options):
        return lambda texts, source, target: ["" if "?" in t else f"<{t}>" for t in texts]

    given = [(1, 0, "body", [" \u00a0o?n", " a?b\t"]), (1, 1, "body", ["plain"]), (2, 0, "body", [" "]), (2, 1, "body", ["\u2014o?n\u2014 "])]
    paras = spark.createDataFrame(given, "doc_id long, para_idx long, loc string, runs array<string>")
    got = corpus.translate_paras(paras, some)
    assert rows(got) == rows(corpus.translate_paras(paras, some, Options(dedup=False)))
