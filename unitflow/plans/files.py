"""Files of both kinds by manifest: each document through the writer that its formats ask for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitflow.operators.inference import Factory, translate_units
from unitflow.operators.placement import layout_plan
from unitflow.operators.units import explode_spans, paragraph_units
from unitflow.operators.writeback import assemble_pages, paginate, write_back
from unitflow.options import Options
from unitflow.plans.corpus import with_document_columns, with_voted_source
from unitflow.session import materialise
from unitflow.sources.manifest import plan_manifest, route


def translate_files(
    files: DataFrame,
    paras: DataFrame,
    layout: DataFrame,
    make_translator: Factory,
    opts: Options = Options(),
    images: DataFrame | None = None,
) -> dict[str, DataFrame]:
    """Results by writer, and the rejected files.

    files   (doc_id, path) with optional ``requested`` and ``out``; one row per document
    paras   paragraphs of the DOCX files, layout: pages of the PDF files, both by doc_id

    ``replace_paragraphs``: paragraphs with new runs. ``paginate_lines``: lines of a plain
    document. ``rebuild_pages``: flowing text by page. ``replace_spans``: spans to draw.
    ``rejected``: (doc_id, path, reject_reason), files without any text among them.

    Units are written once with their document's writer beside them, so that the branches are
    filters over one table and nothing is translated twice.
    """
    if "requested" not in files.columns:
        files = files.withColumn("requested", F.lit(opts.output_format))
    manifest = materialise(route(plan_manifest(files)), "manifest")
    taken = manifest.filter(F.col("reject_reason").isNull())
    of_suffix = lambda s: taken.filter(F.col("suffix") == s).select("doc_id", "writer")

    def translated(units: DataFrame, suffix: str) -> DataFrame:
        units = materialise(units, "units")
        routed = with_voted_source(units, opts, of_suffix(suffix))
        return materialise(translate_units(routed, make_translator, opts), "translated")

    written = lambda df, name: df.filter(F.col("writer") == name).drop("writer")
    texts = translated(paragraph_units(paras), ".docx")
    spans = translated(explode_spans(layout), ".pdf")
    pages = (
        layout.groupBy("doc_id")
        .agg((F.max("page") + 1).alias("n_pages"))
        .join(written(spans, "rebuild_pages").select("doc_id").distinct(), "doc_id")
    )
    with_text = texts.select("doc_id").union(spans.select("doc_id")).distinct()
    empty = taken.join(with_text, "doc_id", "left_anti").withColumn(
        "reject_reason", F.lit("no text")
    )
    page_pictures = None
    if images is not None:
        page_pictures = images.join(pages.select("doc_id"), "doc_id", "left_semi")
    replaced = written(texts, "replace_paragraphs")
    kept_paras = with_document_columns(paras, replaced.select("doc_id").distinct())
    return {
        "replace_paragraphs": write_back(kept_paras, replaced),
        "paginate_lines": paginate(written(texts, "paginate_lines")),
        "rebuild_pages": assemble_pages(written(spans, "rebuild_pages"), page_pictures, pages),
        "replace_spans": layout_plan(written(spans, "replace_spans")),
        "rejected": manifest.filter(F.col("reject_reason").isNotNull())
        .unionByName(empty)
        .select("doc_id", "path", "reject_reason"),
    }
