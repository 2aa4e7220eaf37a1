"""The registered queries: each operator over whole tables of the driver."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow import schemas
from unitflow.functions import language, layout, text
from unitflow.operators import (
    batching,
    detector,
    inference,
    memory,
    placement,
    profiles,
    quality,
    units,
    voting,
    writeback,
)
from unitflow.options import ENGLISH, RUSSIAN, Options
from unitflow.plans import corpus, files, fixtures, folder
from unitflow.session import fresh_path, materialise
from unitflow.sources import docx, lines, manifest, sinks
from unitflow.streaming import documents as document_stream
from unitflow.streaming import layouts as layout_stream
from unitflow.streaming import lines as line_stream

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
STUB = inference.stub_translator
PINNED = Options(source=ENGLISH, dedup=False)


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


# --- scalar functions ---------------------------------------------------------------------------


@query
def strip_ws(spark, d):
    rows = fixtures.padded_lines(fixtures.documents(spark, d))
    return rows.select("doc_id", "i", text.strip_ws(F.col("t")).alias("stripped"))


@query
def normalize_uz(spark, d):
    rows = fixtures.lines(fixtures.noisy_docs(spark, d))
    return rows.select("doc_id", "i", text.normalize_uz(F.col("t")).alias("normalized"))


@query
def script_counts(spark, d):
    rows = fixtures.lines(fixtures.ru_docs(spark, d))
    counts = rows.select("doc_id", "i", text.script_counts(F.col("t")).alias("c"))
    return counts.select(
        "doc_id",
        "i",
        F.col("c.cyr").cast("bigint").alias("cyr"),
        F.col("c.lat").cast("bigint").alias("lat"),
    )


@query
def detect_source(spark, d):
    rows = fixtures.lines(fixtures.ru_docs(spark, d))
    profiled = rows.select("doc_id", "i", language.text_profile(F.col("t")).alias("p"))
    return profiled.select("doc_id", "i", language.source_of(F.col("p")).alias("src_lang"))


@query
def effective_source(spark, d):
    rows = fixtures.lines(fixtures.ru_docs(spark, d))
    return rows.select(
        "doc_id",
        "i",
        language.effective_source(F.col("t"), "auto").alias("auto_source"),
        language.effective_source(F.col("t"), RUSSIAN).alias("pinned_source"),
    )


@query
def final_text(spark, d):
    rows = fixtures.lines(fixtures.noisy_docs(spark, d))
    translated = F.expr("case i % 3 when 0 then '' when 1 then null else concat('[', t, ']') end")
    return rows.select("doc_id", "i", text.final_text(translated, F.col("t")).alias("final"))


@query
def paragraph_text(spark, d):
    paras = fixtures.run_docs(fixtures.documents(spark, d))
    return paras.select("doc_id", "para_idx", text.paragraph_text(F.col("runs")).alias("text"))


@query
def replace_runs(spark, d):
    paras = fixtures.run_docs(fixtures.documents(spark, d))
    new = F.expr("case when para_idx % 7 = 6 then '' else concat('<', para_idx, '>') end")
    runs = paras.select(
        "doc_id", "para_idx", text.replace_runs(F.col("runs"), new).alias("runs")
    )
    return runs.select(
        "doc_id",
        "para_idx",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.array_join("runs", "|").alias("runs"),
    )


@query
def tokens_to_text(spark, d):
    rows = fixtures.lines(fixtures.noisy_docs(spark, d))
    tokens = F.expr(
        """concat(
             case i % 4 when 0 then array('uzn_Latn') when 1 then array('__tag__')
                        when 2 then cast(array() as array<string>) else array('▁eng_') end,
             transform(split(t, ' '), w -> concat('▁', w)))"""
    )
    return rows.select("doc_id", "i", text.tokens_to_text(tokens).alias("text"))


@query
def loc_path(spark, d):
    rows = fixtures.lines(fixtures.documents(spark, d))
    places = rows.selectExpr(
        "doc_id",
        "i",
        "case i % 4 when 0 then 'body' when 1 then 'table' when 2 then 'header' else 'footer' end"
        " as region",
        "cast(doc_id % 3 as int) as s",
        "case when i % 4 = 1 or (i % 4 > 1 and i % 8 > 3) then cast(i % 6 as int) end as t",
        """case when i % 5 = 0
             then array(named_struct('r', cast(i % 3 as int), 'c', cast(i % 2 as int), 'n', 1),
                        named_struct('r', 2, 'c', cast(doc_id % 4 as int), 'n', cast(null as int)))
             else array(named_struct('r', cast(i % 3 as int), 'c', cast(i % 2 as int),
                                     'n', cast(null as int))) end as cells""",
        "cast(i % 10 as int) as p",
    )
    path = layout.loc_path(F.col("region"), F.col("s"), F.col("t"), F.col("cells"), F.col("p"))
    return places.select("doc_id", "i", path.alias("loc"))


@query
def unpack_rgb(spark, d):
    spans = units.explode_spans(fixtures.layout_docs(fixtures.gap_docs(spark, d)))
    rgb = spans.select("doc_id", "unit_idx", layout.unpack_rgb(F.col("color")).alias("c"))
    return rgb.select("doc_id", "unit_idx", "c.r", "c.g", "c.b")


@query
def fit_font_size(spark, d):
    """Both slack values, over boxes and sizes that vary with the line."""
    rows = fixtures.lines(fixtures.documents(spark, d)).withColumn("body", F.col("t"))
    width = F.expr("cast(20 + (doc_id * 31 + i * 17) % 500 as double)")
    height = F.expr("cast(6 + (doc_id + i * 7) % 60 as double)")
    size = F.expr("cast(2 + (i % 40) * 0.75 as double)")
    return rows.select(
        "doc_id",
        "i",
        layout.fit_font_size(width, height, F.col("body"), size).alias("font_size"),
        layout.fit_font_size(
            width, height, F.col("body"), size, layout.SLACK_STRICT
        ).alias("font_size_strict"),
    )


# --- sources, routing, sinks --------------------------------------------------------------------


@query
def explode_paragraphs(spark, d):
    return units.explode_paragraphs(fixtures.gap_docs(spark, d))


@query
def explode_spans(spark, d):
    spans = units.explode_spans(fixtures.layout_docs(fixtures.gap_docs(spark, d)))
    return spans.select(
        "doc_id",
        "unit_idx",
        "uid",
        "kind",
        "page",
        *[F.col("bbox")[k].alias(c) for k, c in enumerate(("x0", "y0", "x1", "y1"))],
        "size",
        F.col("color").cast("bigint").alias("color"),
        "text",
    )


@query
def read_lines(spark, d):
    """Documents written as line files and read again, summed per source folder."""
    path = fresh_path(spark, "lines")
    fixtures.documents(spark, d, fixtures.GAP_DOCS, "source").select("source", "text").write.partitionBy(
        "source"
    ).text(path)
    # the index of a file is gapless when its sum is that of 0 .. n-1
    per_file = lines.read_lines(spark, f"{path}/source=*").groupBy("path").agg(
        F.count("*").alias("n"),
        F.sum("line_idx").alias("idx"),
        F.max("line_idx").alias("last"),
        F.sum(F.length("text")).cast("bigint").alias("chars"),
    )
    return per_file.groupBy(F.regexp_extract("path", "source=([^/]*)/", 1).alias("source")).agg(
        F.sum("n").alias("n_lines"),
        F.sum("chars").alias("n_chars"),
        F.bool_and(
            (F.col("last") == F.col("n") - 1)
            & (F.col("idx") * 2 == F.col("n") * (F.col("n") - 1))
        ).alias("gapless"),
    )


@query
def read_docx(spark, d):
    files = fixtures.docx_docs(fixtures.documents(spark, d, "text", "lang", "source"))
    paras = docx.parse_docx(files)
    return paras.select(
        "doc_id",
        "para_idx",
        "loc",
        F.size("runs").cast("bigint").alias("n_runs"),
        text.paragraph_text(F.col("runs")).alias("text"),
    )


def _files(spark, d):
    return fixtures.documents(spark, d, "text", "source").selectExpr(
        "doc_id",
        """concat('in/', source, '/', case doc_id % 8
             when 0 then 'a.docx' when 1 then 'b.PDF' when 2 then 'c.v2.pdf' when 3 then 'd.txt'
             when 4 then 'plain' when 5 then '.pdf' when 6 then 'e.DocX' else 'f.tar.docx' end)
           as path""",
        """case (doc_id div 8) % 5 when 0 then 'auto' when 1 then 'docx' when 2 then 'PDF'
             when 3 then '' else 'odt' end as requested""",
        "case when doc_id % 11 = 0 then concat('out/', doc_id, '.final.tmp') end as out",
    )


@query
def plan_manifest(spark, d):
    return manifest.plan_manifest(_files(spark, d))


@query
def route_writer(spark, d):
    routed = manifest.route(manifest.plan_manifest(_files(spark, d)))
    return routed.groupBy("writer", "reject_reason").agg(F.count("*").alias("n"))


@query
def side_by_side(spark, d):
    rows = voting.with_unit_source(
        fixtures.ru_docs(spark, d).transform(units.explode_paragraphs)
    )
    # ranges are sampled before they are cut: written first, nothing is translated twice
    done = materialise(inference.translate_rows(rows, STUB, Options(dedup=False)))
    return sinks.side_by_side_lines(done, "doc_id", "unit_idx").select(
        "doc_id", "unit_idx", "value"
    )


@query
def sink_roundtrip(spark, d):
    done = corpus.translate_corpus(spark, fixtures.ru_docs(spark, d), STUB)
    path = fresh_path(spark, "translated")
    sinks.write_translated(
        done.withColumn("out_format", F.expr("case doc_id % 2 when 0 then 'docx' else 'pdf' end")),
        path,
    )
    return spark.read.parquet(path).select("doc_id", "part", "n_pieces", "text", "out_format")


@query
def translate_files(spark, d):
    """Every document as a file by its manifest: result rows and documents of each writer."""
    docs = fixtures.gap_docs(spark, d)
    results = files.translate_files(
        _files(spark, d),
        fixtures.run_docs(docs),
        fixtures.layout_docs(docs),
        STUB,
        images=fixtures.images(docs),
    )
    counted = [
        df.select(F.lit(name).alias("writer"), "doc_id").groupBy("writer", "doc_id").count()
        for name, df in results.items()
    ]
    union = counted[0]
    for df in counted[1:]:
        union = union.unionByName(df)
    return union.groupBy("writer").agg(
        F.count("*").alias("n_docs"), F.sum("count").alias("n_rows")
    )


@query
def translate_folder(spark, d):
    """A folder of DOCX files into a folder of results; the record of each file, and what was written for it."""
    docs = fixtures.documents(spark, d, fixtures.RU_DOCS, "lang", "source")
    source = fixtures.docx_folder(docs, fresh_path(spark, "folder"))
    out = fresh_path(spark, "folder-out")
    done = folder.translate_folder(spark, source, out, STUB)
    chars = F.sum(F.length(text.paragraph_text(F.col("runs")))).cast("bigint")
    written = folder.folder_results(spark, out).groupBy("doc_id").agg(chars.alias("n_chars"))
    joined = done.join(written.withColumnRenamed("doc_id", "path"), "path", "left")
    return joined.select(
        F.regexp_extract("path", "([0-9]+)[.][a-z]+$", 1).cast("bigint").alias("doc_id"),
        "status",
        F.when(F.col("reason").contains("zip"), "damaged").otherwise(F.col("reason")).alias("reason"),
        "src_lang",
        "n_paras",
        "n_units",
        "n_chars",
    )


@query
def document_outcomes(spark, d):
    docs = fixtures.documents(
        spark, d, f"case when doc_id % 5 = 0 then repeat(concat(' ', chr(10)), 3) else {fixtures.RU_DOCS} end"
    )
    opts = Options(part_units=16)
    done = materialise(corpus.translate_corpus(spark, docs, STUB, opts))
    return corpus.document_outcomes(docs, done, opts)


def _remembered(spark, d):
    """Half of the documents, then all, then all once more, through one translation memory."""
    rows = units.explode_paragraphs(fixtures.ru_docs(spark, d))
    opts = Options(memory=fresh_path(spark, "memory"))
    done = None
    for batch, part in (("half", rows.filter("doc_id % 2 = 0")), ("all", rows), ("again", rows), ("all", rows)):
        done = inference.translate_units(part, STUB, opts, batch=batch)
    return done, memory.TranslationMemory(spark, opts.memory, opts)


@query
def translate_remembered(spark, d):
    return _remembered(spark, d)[0].select("doc_id", "unit_idx", "src_lang", "translated")


@query
def memory_growth(spark, d):
    """How many texts each batch has added to a memory: none that it knew."""
    _, held = _remembered(spark, d)
    rows = None
    for commit in held.ledger.commits():
        own = held.ledger.read_of(commit["ids"][0]).select(F.lit(commit["ids"][0]).alias("batch"))
        rows = own if rows is None else rows.unionByName(own)
    return rows.groupBy("batch").agg(F.count("*").alias("n_texts"))


# --- language -----------------------------------------------------------------------------------


@query
def reject_sources(spark, d):
    rows = fixtures.lines(fixtures.documents(spark, d)).withColumn(
        "src_lang",
        F.expr("case (doc_id + i) % 4 when 0 then 'eng_Latn' when 1 then 'rus_Cyrl' "
               "when 2 then 'deu_Latn' end"),
    )
    ok, rejected = voting.split_supported(rows)
    counted = ok.withColumn("status", F.lit("ok")).unionByName(
        rejected.withColumn("status", F.lit("rejected"))
    )
    return counted.groupBy("status", "src_lang").agg(F.count("*").alias("n"))


@query
def document_source(spark, d):
    return voting.document_source(units.explode_paragraphs(fixtures.ru_docs(spark, d)))


@query
def document_source_in_row(spark, d):
    docs = voting.with_document_source(fixtures.ru_docs(spark, d), Options())
    return docs.select("doc_id", "src_lang")


@query
def file_source(spark, d):
    rows = units.explode_paragraphs(fixtures.ru_docs(spark, d))
    return voting.file_source(rows, file="doc_id", idx="unit_idx")


@query
def empty_documents(spark, d):
    docs = fixtures.documents(
        spark, d, "case when doc_id % 5 = 0 then repeat(concat(' ', chr(10)), 3) else text end"
    )
    return voting.empty_documents(docs, units.explode_paragraphs(docs)).select("doc_id")


@query
def language_groups(spark, d):
    rows = units.explode_paragraphs(fixtures.ru_docs(spark, d))
    return voting.language_groups(voting.with_unit_source(rows))


def _labelled(spark, d):
    docs = fixtures.documents(spark, d, fixtures.RU_DOCS, f"{fixtures.LABEL} as lang")
    return units.explode_paragraphs(docs)


@query
def train_profiles(spark, d):
    return profiles.long_profiles(profiles.train_profiles(_labelled(spark, d), fixtures.LABELS))


@query
def classify_accuracy(spark, d):
    rows = _labelled(spark, d)
    trained = materialise(profiles.train_profiles(rows, fixtures.LABELS))
    labels = profiles.classify(rows, trained, ["doc_id", "unit_idx", "lang"])
    return labels.groupBy("lang", "label").agg(F.count("*").alias("n"))


@query
def detect_with_profiles(spark, d):
    rows = _labelled(spark, d)
    trained = materialise(profiles.train_profiles(rows, fixtures.LABELS))
    return profiles.detect_with_profiles(rows, trained).select(
        "doc_id", "unit_idx", "detected", "src_lang"
    )


def _detector(spark, d, where="true"):
    trained = profiles.train_profiles(_labelled(spark, d).where(where), fixtures.LABELS)
    return detector.load_profile(trained)


@query
def held_out_accuracy(spark, d):
    """Labels of documents that the profile was not trained on, found inside the row."""
    known = _detector(spark, d, "doc_id % 5 != 0")
    rows = _labelled(spark, d).where("doc_id % 5 = 0")
    labels = rows.withColumn("label", detector.detected_label(F.col("text"), known))
    return labels.groupBy("lang", "label").agg(F.count("*").alias("n"))


@query
def detect_units(spark, d):
    rows = voting.with_unit_source(_labelled(spark, d), "auto", _detector(spark, d))
    return rows.select("doc_id", "unit_idx", "src_lang")


@query
def document_source_detected(spark, d):
    """The vote inside the document's row, and over its units, with a detector."""
    known, docs = _detector(spark, d), fixtures.ru_docs(spark, d)
    in_row = voting.with_document_source(docs, Options(profiles=known)).select("doc_id", "src_lang")
    votes = voting.document_source(units.explode_paragraphs(docs), detector=known)
    return in_row.join(votes.withColumnRenamed("src_lang", "by_units"), "doc_id")


@query
def file_source_detected(spark, d):
    rows = units.explode_paragraphs(fixtures.ru_docs(spark, d))
    return voting.file_source(rows, file="doc_id", idx="unit_idx", detector=_detector(spark, d))


@query
def translate_corpus_detected(spark, d):
    opts = Options(profiles=_detector(spark, d))
    return corpus.translate_corpus(spark, fixtures.ru_docs(spark, d), STUB, opts)


# --- inference ----------------------------------------------------------------------------------


@query
def translate_units(spark, d):
    rows = units.explode_paragraphs(fixtures.noisy_docs(spark, d))
    done = inference.translate_units(rows, STUB, Options(dedup=False, max_chars=200))
    return done.select("doc_id", "unit_idx", "src_lang", "translated", "over_limit")


@query
def translate_distinct(spark, d):
    rows = units.explode_paragraphs(fixtures.ru_docs(spark, d))
    done = inference.translate_units(rows, STUB, Options())
    return done.select("doc_id", "unit_idx", "src_lang", "translated")


@query
def translate_staged(spark, d):
    """The model as a stage of its own, which sees numbers, bodies and sources."""
    rows = inference.with_body(_sourced(spark, d))
    done = inference.translate_staged(rows, STUB, Options())
    return done.select("doc_id", "unit_idx", "src_lang", text.normalize_uz(F.col("_raw")).alias("translated"))


@query
def translate_long(spark, d):
    """Units beyond the model's limit, in pieces that end at sentences."""
    rows = units.explode_paragraphs(fixtures.noisy_docs(spark, d))
    done = inference.translate_units(rows, STUB, Options(split_chars=60))
    return done.select("doc_id", "unit_idx", "src_lang", "translated", "n_segments")


def _faulty(options):
    """A translator that fails on every batch with a certain text in it."""

    def fn(texts, source, target):
        if any(fixtures.FAULT in t for t in texts):
            raise ValueError("cannot translate")
        return STUB(options)(texts, source, target)

    return fn


@query
def translate_faulty(spark, d):
    rows = units.explode_paragraphs(fixtures.documents(spark, d))
    opts = Options(dedup=False, on_error="row", batch_tokens=2048)
    done = inference.translate_units(rows, _faulty, opts)
    return done.select("doc_id", "unit_idx", "translated", "error")


@query
def translate_with(spark, d):
    rows = fixtures.lines(fixtures.gap_docs(spark, d))
    done = inference.translate_with(rows, lambda texts: [f"<{t}>" for t in texts], "t")
    return done.select("doc_id", "i", "translated")


@query
def translate_text(spark, d):
    turns = fixtures.table(spark, d, "conversations", "conv_id", "turn", "text")
    done = inference.translate_text(spark, turns, STUB, Options(dedup=False))
    return done.select("conv_id", "turn", "src_lang", "translated")


@query
def translate_corpus(spark, d):
    return corpus.translate_corpus(spark, fixtures.ru_docs(spark, d), STUB)


@query
def translate_corpus_per_unit(spark, d):
    opts = Options(mode="per_unit", dedup=False)
    return corpus.translate_corpus(spark, fixtures.gap_docs(spark, d), STUB, opts)


@query
def translate_lines(spark, d):
    rows = units.explode_paragraphs(fixtures.ru_docs(spark, d)).selectExpr(
        "doc_id", "unit_idx as line_idx", "text"
    )
    done = corpus.translate_lines(rows, STUB, Options(), "doc_id")
    return done.select("doc_id", "line_idx", "src_lang", "translated")


# --- write-back and assembly --------------------------------------------------------------------


def _marked(df):
    """A cheap deterministic stand-in for model output, for queries that are not about models."""
    return df.withColumn("translated", F.concat(F.lit("<"), text.strip_ws(F.col("text")), F.lit(">")))


@query
def write_back(spark, d):
    paras = fixtures.run_docs(fixtures.gap_docs(spark, d))
    done = writeback.write_back(paras, _marked(units.paragraph_units(paras)))
    return done.select(
        "doc_id",
        "para_idx",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.array_join("runs", "|").alias("runs"),
    )


@query
def assemble_document(spark, d):
    done = _marked(units.explode_paragraphs(fixtures.gap_docs(spark, d)))
    return writeback.assemble_document(done, "unit_idx", "translated")


def _spans(spark, d):
    return _marked(units.explode_spans(fixtures.layout_docs(fixtures.gap_docs(spark, d))))


@query
def page_images(spark, d):
    kept = writeback.page_images(fixtures.dense_images(fixtures.gap_docs(spark, d)))
    sizes = [F.col(c).cast("bigint").alias(c) for c in ("xref", "width")]
    return kept.select("doc_id", "page", "img_idx", "y0", "height", *sizes)


@query
def assemble_pages(spark, d):
    docs = fixtures.gap_docs(spark, d)
    pages = fixtures.page_counts(fixtures.layout_docs(docs))
    return writeback.assemble_pages(_spans(spark, d), fixtures.images(docs), pages)


@query
def layout_to_pages(spark, d):
    """Layouts through the model: vote, translation and page assembly in one."""
    layouts = fixtures.layout_docs(fixtures.ru_docs(spark, d))
    return corpus.layout_to_pages(layouts, STUB).select("doc_id", "page", "n_items", "text")


@query
def layout_plan(spark, d):
    return placement.layout_plan(_spans(spark, d))


@query
def overflow_report(spark, d):
    return placement.overflow_report(placement.layout_plan(_spans(spark, d)))


@query
def paginate(spark, d):
    return writeback.paginate(_marked(units.explode_paragraphs(fixtures.gap_docs(spark, d))))


# --- batches, counts, quality -------------------------------------------------------------------


def _sourced(spark, d):
    return voting.with_unit_source(units.explode_paragraphs(fixtures.ru_docs(spark, d)))


@query
def head_n(spark, d):
    rows = units.explode_paragraphs(fixtures.documents(spark, d))
    return units.head_n(rows, 5).select("doc_id", "unit_idx", "text")


@query
def preview(spark, d):
    return units.preview(_marked(units.explode_paragraphs(fixtures.gap_docs(spark, d))))


@query
def plan_batches(spark, d):
    return batching.plan_batches(_sourced(spark, d), 8).select(
        "doc_id", "unit_idx", "src_lang", "batch_no", "pos"
    )


@query
def progress(spark, d):
    return batching.progress(_sourced(spark, d), 8)


@query
def unit_counts(spark, d):
    return quality.unit_counts(units.explode_paragraphs(fixtures.gap_docs(spark, d)))


@query
def page_load(spark, d):
    spans = units.explode_spans(fixtures.layout_docs(fixtures.gap_docs(spark, d)))
    return quality.page_load(spans)


def _judged(spark, d):
    """Units of which some came back empty, unchanged or with typographic quotes."""
    return voting.with_unit_source(
        units.explode_paragraphs(fixtures.ru_docs(spark, d))
    ).withColumn(
        "translated",
        F.expr("case unit_idx % 6 when 0 then '' when 1 then text when 2 then concat('«', text)"
               " when 3 then null else concat('Salom ', text) end"),
    )


@query
def quality_report(spark, d):
    return quality.quality_report(_judged(spark, d))


@query
def checks(spark, d):
    rules = {"non_empty": quality.non_empty(), "greets": quality.contains_any(["salom", "qanday"])}
    rows = _judged(spark, d)
    return quality.check(rows, rules).unionByName(quality.batch_check(rows, 4))


@query
def checks_observed(spark, d):
    """The rules' counts, taken while the units are written."""
    rules = {"non_empty": quality.non_empty(), "greets": quality.contains_any(["salom", "qanday"])}
    watched = quality.ObservedChecks(rules)
    materialise(watched.watch(_judged(spark, d)), "watched")
    return watched.report(spark)


# --- streams ------------------------------------------------------------------------------------


def _document_stream(spark, d):
    """The documents table as a stream, one file or a folder of them: its files are taken as they arrive."""
    # a pattern stands for files and folders alike, a plain path of a stream for a folder only
    return spark.readStream.schema(schemas.DOCUMENTS).parquet(f"{d}/documents.parque[t]")


@query
def stream_lines(spark, d):
    docs = _document_stream(spark, d).selectExpr("doc_id", f"{fixtures.RU_DOCS} as text")
    stream = line_stream.translate_stream(units.explode_lines(docs), STUB)
    out = fresh_path(spark, "stream-lines")
    line_stream.start_append(stream, out, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "para_idx", "src_lang", "translated")


@query
def stream_docs(spark, d):
    docs = _document_stream(spark, d).selectExpr("doc_id", f"{fixtures.RU_DOCS} as text")
    out = fresh_path(spark, "stream-docs")
    document_stream.watch_documents(
        docs, STUB, out, fresh_path(spark, "offsets")
    ).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "part", "n_pieces", "text")


@query
def stream_layout(spark, d):
    """Pages of all documents, arriving over several micro-batches, assembled document by document."""
    pages = fixtures.layout_docs(fixtures.ru_docs(spark, d))
    counted = pages.join(fixtures.page_counts(pages), "doc_id")
    folder_, out, first = fresh_path(spark, "pages"), fresh_path(spark, "stream-layout"), 0
    # even pages come first, so that no document of two pages is whole in one batch
    for late in (0, 1):
        counted.where(F.col("page") % 2 == late).write.mode("append").parquet(folder_)
        first = first or len(spark.read.schema(counted.schema).parquet(folder_).inputFiles())
    stream = spark.readStream.schema(counted.schema).option("maxFilesPerTrigger", max(first, 1)).parquet(folder_)
    layout_stream.watch_layouts(stream, STUB, out, fresh_path(spark, "offsets")).awaitTermination()
    return spark.read.parquet(out).select("doc_id", "page", "n_items", "text", "status")
