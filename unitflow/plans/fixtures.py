"""Inputs that the registered queries derive from the driver's tables.

The ``documents`` table has no Cyrillic, typographic quotes, question marks or blank lines, so
plain queries over it would test little. Each fixture is one expression, written alike for Spark
(here) and for the check (``oracles.py``).
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.sax.saxutils import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from unitflow.functions.text import WHITESPACE
from unitflow.operators.units import explode_lines
from unitflow.session import spread

RU_DOCS = """case
  when doc_id % 3 = 0 then translate(text, 'abvgdezijklmnoprstufhc', 'абвгдезийклмнопрстуфхц')
  when doc_id % 7 = 1 then translate(text, 'aeiont', 'аеионт')
  else text end"""
NOISY_DOCS = "replace(replace(translate(text, 'é*$&#', '’«»—ʻ'), 'on', 'o?n'), 'ed', 'e?d')"
GAP_DOCS = "replace(text, chr(10), concat(chr(10), chr(10)))"
EVEN = 4  # splits for each core from which a scan is taken to be even
FAULT = "ndw"  # texts that hold it make a translator fail
LABEL = "case when doc_id % 3 = 0 then 'ru' else lang end"
LABELS = ("de", "en", "es", "fr", "ru")


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def documents(
    spark: SparkSession, sf_dir: str, expr: str = "text", *more: str, even: int = 1
) -> DataFrame:
    """(doc_id, text, ...) with a derived text, spread over the cores."""
    columns = ["doc_id", "text"] + [c for c in ("lang", "source") if any(c in m for m in more)]
    given = table(spark, sf_dir, "documents", *columns)
    docs = spread(given, "doc_id") if even == 1 else spread(given, "doc_id", even=even)
    return docs.selectExpr("doc_id", f"{expr} as text", *more)


def ru_docs(spark, sf_dir):
    return documents(spark, sf_dir, RU_DOCS)


def noisy_docs(spark, sf_dir):
    """These only pass through column expressions, so that one shuffle may well even out their scan."""
    return documents(spark, sf_dir, NOISY_DOCS, even=EVEN)


def gap_docs(spark, sf_dir):
    return documents(spark, sf_dir, GAP_DOCS)


def lines(docs: DataFrame) -> DataFrame:
    """(doc_id, i, t, ...): all lines, numbered from 0."""
    return explode_lines(docs).withColumnRenamed("para_idx", "i").withColumnRenamed("text", "t")


def padded_lines(docs: DataFrame) -> DataFrame:
    """Lines with a white-space character on each side, all 29 in turn."""
    space = F.lit(WHITESPACE)
    n = len(WHITESPACE)
    return lines(docs).withColumn(
        "t",
        F.concat(
            F.substring(space, (F.col("i") % n + 1).cast("int"), F.lit(1)),
            F.col("t"),
            F.substring(space, (F.col("doc_id") % n + 1).cast("int"), F.lit(1)),
        ),
    )


def layout_docs(docs: DataFrame) -> DataFrame:
    """Page layouts (doc_id, page, blocks): 8 lines a page, 2 spans a line, every 9th an image."""
    listed = docs.selectExpr("doc_id", "split(text, '\\n') as ls").selectExpr(
        "doc_id",
        "transform(ls, (t, i) -> struct(cast(i as bigint) as i, t)) as ls",
    )
    pages = listed.selectExpr(
        "doc_id", "ls", "explode(sequence(0, cast(floor((size(ls) - 1) / 8) as int))) as p"
    )
    span = """struct(
        case when sp = 0 then substring(l.t, 1, cast(floor(length(l.t) / 2) as int))
             else substring(l.t, cast(floor(length(l.t) / 2) as int) + 1) end as text,
        array(cast(72 + 200 * sp as double), cast(50 + 16 * (l.i % 8) as double),
              cast(252 + 200 * sp as double), cast(62 + 16 * (l.i % 8) as double)) as bbox,
        cast(case when l.i % 5 = 0 then 0 else 7 + (l.i % 4) end as double) as size,
        cast((doc_id * 7919 + l.i * 104729) % 16777216 as int) as color)"""
    block = f"""struct(
        case when (doc_id + l.i) % 9 = 0 then 1 else 0 end as type,
        array(struct(transform(array(0, 1), sp -> {span}) as spans)) as lines)"""
    return pages.selectExpr(
        "doc_id",
        "cast(p as bigint) as page",
        f"transform(slice(ls, p * 8 + 1, 8), l -> {block}) as blocks",
    )


def page_counts(layout: DataFrame) -> DataFrame:
    return layout.groupBy("doc_id").agg((F.max("page") + 1).alias("n_pages"))


def images(docs: DataFrame) -> DataFrame:
    """One image for each image block of the layouts; xrefs repeat within a page."""
    return lines(docs).filter("(doc_id + i) % 9 = 0").selectExpr(
        "doc_id",
        "cast(floor(i / 8) as bigint) as page",
        "i as img_idx",
        "cast((doc_id + i div 9) % 5 as int) as xref",
        "cast(50 + 16 * (i % 8) as double) as y0",
        "cast(4 + (i % 3) * 8 as int) as width",
        "20 as height",
    )


def dense_images(docs: DataFrame) -> DataFrame:
    """Three images on each line, so that repeats of one xref on a page are common."""
    return (
        lines(docs)
        .withColumn("k", F.explode(F.expr("sequence(0L, 2L)")))
        .selectExpr(
            "doc_id",
            "cast(floor(i / 8) as bigint) as page",
            "i * 3 + k as img_idx",
            "cast((doc_id + i + k) % 5 as int) as xref",
            "cast(50 + 16 * (i % 8) as double) as y0",
            "cast(4 + ((i + k) % 3) * 8 as int) as width",
            "20 as height",
        )
    )


def run_docs(docs: DataFrame) -> DataFrame:
    """Paragraph table: lines cut into runs, some without runs, some with an empty first run."""
    return lines(docs).selectExpr(
        "doc_id",
        "i as para_idx",
        "'body' as loc",
        """case when i % 5 = 4 then cast(array() as array<string>)
                when i % 4 = 0 then concat(array(''), split(t, ', '))
                else split(t, ', ') end as runs""",
    )


# --- Fixed values: the least parts of a DOCX file ----------------------------------------------
WORD_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
REL_NS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
RELS = "http://schemas.openxmlformats.org/package/2006/relationships"
# ------------------------------------------------------------------------------------------------


def docx_bytes(body: str, header: str | None = None) -> bytes:
    """A DOCX file from body XML (paragraphs, tables) and header paragraphs."""
    refs = '<w:headerReference w:type="default" r:id="rId1"/>' if header is not None else ""
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(
            "word/document.xml",
            f'<w:document xmlns:w="{WORD_NS}" xmlns:r="{REL_NS}"><w:body>{body}'
            f"<w:sectPr>{refs}</w:sectPr></w:body></w:document>",
        )
        if header is not None:
            z.writestr(
                "word/_rels/document.xml.rels",
                f'<Relationships xmlns="{RELS}"><Relationship Id="rId1" '
                f'Type="{REL_NS}/header" Target="header1.xml"/></Relationships>',
            )
            z.writestr("word/header1.xml", f'<w:hdr xmlns:w="{WORD_NS}">{header}</w:hdr>')
    return out.getvalue()


def docx_paragraph(*runs: str) -> str:
    made = "".join(f'<w:r><w:t xml:space="preserve">{escape(r)}</w:t></w:r>' for r in runs)
    return f"<w:p>{made}</w:p>"


def docx_docs(docs: DataFrame) -> DataFrame:
    """(doc_id, content): each line a paragraph, a one-row table (lang, doc_id), a header (source)."""

    @F.pandas_udf(T.BinaryType())
    def build(text: pd.Series, doc: pd.Series, lang: pd.Series, source: pd.Series) -> pd.Series:
        made = []
        for t, d, la, s in zip(text, doc, lang, source):
            cells = "".join(f"<w:tc>{docx_paragraph(c)}</w:tc>" for c in (la, str(d)))
            body = "".join(docx_paragraph(x) for x in t.split("\n"))
            body += f"<w:tbl><w:tr>{cells}</w:tr></w:tbl>"
            made.append(docx_bytes(body, docx_paragraph(s)))
        return pd.Series(made)

    return docs.select("doc_id", build("text", "doc_id", "lang", "source").alias("content"))


def docx_folder(docs: DataFrame, folder: str) -> str:
    """Write the files of ``docx_docs`` as ``<doc_id>.docx``, and a few that no job can take; gives the folder."""
    from pyarrow import fs, record_batch

    def files():
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder))

    def write(batches):
        system, root = files()
        for batch in batches:
            for doc, content in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content"))):
                bad = {0: ("txt", content), 1: ("pdf", content), 2: ("docx", content[:100])}
                suffix, content = bad.get(doc % 50, ("docx", content))
                with system.open_output_stream(f"{root}/{doc}.{suffix}", compression=None) as out:
                    out.write(content)
            yield record_batch({"n": [batch.num_rows]})

    system, root = files()
    system.create_dir(root, recursive=True)
    docx_docs(docs).mapInArrow(write, "n bigint").agg(F.sum("n")).first()
    return folder
