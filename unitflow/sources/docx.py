"""DOCX folders as paragraph tables.

A file is opened in Python (a zip of XML parts) and leaves it as rows of runs and position
numbers; locations, texts and all later work are native expressions.
"""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from unitflow.functions.layout import loc_path

# --- Fixed values: the names that WordprocessingML gives to its parts --------------------------
W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
RELS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
MAIN_PART = "word/document.xml"
RUN_CONTENT = {
    f"{W}tab": "\t",
    f"{W}ptab": "\t",
    f"{W}br": "\n",
    f"{W}cr": "\n",
    f"{W}noBreakHyphen": "-",
}
# ------------------------------------------------------------------------------------------------

ROW = (
    "para_idx bigint, region string, section int, tbl int, "
    "cells array<struct<r: int, c: int, n: int>>, p int, runs array<string>, error string"
)

def run_text(run: ElementTree.Element) -> str:
    out = []
    for child in run:
        if child.tag == f"{W}t":
            out.append(child.text or "")
        elif child.tag == f"{W}br" and child.get(f"{W}type", "textWrapping") != "textWrapping":
            continue
        else:
            out.append(RUN_CONTENT.get(child.tag, ""))
    return "".join(out)


def grid(table: ElementTree.Element) -> list[list[ElementTree.Element]]:
    """Cells by row and grid column: a spanning cell repeats, a merged one is the cell above."""
    rows: list[list[ElementTree.Element]] = []
    lead_above = 0
    for tr in table.findall(f"{W}tr"):
        row: list[ElementTree.Element] = []
        skip = tr.find(f"{W}trPr/{W}gridBefore")
        lead = int(skip.get(f"{W}val", "0")) if skip is not None else 0
        for tc in tr.findall(f"{W}tc"):
            span = tc.find(f"{W}tcPr/{W}gridSpan")
            merge = tc.find(f"{W}tcPr/{W}vMerge")
            width = int(span.get(f"{W}val", "1")) if span is not None else 1
            cell, at = tc, lead + len(row)
            if merge is not None and merge.get(f"{W}val", "continue") == "continue" and rows:
                above, place = rows[-1], at - lead_above
                cell = above[place] if 0 <= place < len(above) else tc
            row.extend([cell] * width)
        rows.append(row)
        lead_above = lead
    return rows


def story(part: ElementTree.Element, region: str, section: int | None) -> Iterator[tuple]:
    """Paragraphs of a body, header or footer, then those of its tables."""
    for p in part.findall(f"{W}p"):
        yield region, section, None, None, None, p
    for t, table in enumerate(part.findall(f"{W}tbl")):
        for cells, p, paragraph in table_paragraphs(table, []):
            yield ("table" if region == "body" else region), section, t, cells, p, paragraph


def table_paragraphs(table: ElementTree.Element, above: list) -> Iterator[tuple]:
    for r, row in enumerate(grid(table)):
        for c, cell in enumerate(row):
            for p, paragraph in enumerate(cell.findall(f"{W}p")):
                yield above + [{"r": r, "c": c, "n": None}], p, paragraph
            for n, nested in enumerate(cell.findall(f"{W}tbl")):
                yield from table_paragraphs(nested, above + [{"r": r, "c": c, "n": n}])


def related_parts(archive: zipfile.ZipFile) -> dict[str, str]:
    folder, name = posixpath.split(MAIN_PART)
    rels = f"{folder}/_rels/{name}.rels"
    if rels not in archive.namelist():
        return {}
    return {
        r.get("Id"): posixpath.normpath(posixpath.join("/" + folder, r.get("Target", ""))).lstrip("/")
        for r in ElementTree.fromstring(archive.read(rels)).findall(f"{RELS}Relationship")
        if r.get("TargetMode") != "External"
    }


def paragraphs(content: bytes) -> Iterator[tuple]:
    """All paragraphs of a file: body, body tables, then header and footer of each section.

    A section without a header of its own shows that of the section before; the first one then
    shows an empty paragraph.
    """
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        body = ElementTree.fromstring(archive.read(MAIN_PART)).find(f"{W}body")
        parts = related_parts(archive)
        yield from story(body, "body", None)
        shown = {"header": None, "footer": None}
        for s, section in enumerate(body.iter(f"{W}sectPr")):
            for region in ("header", "footer"):
                for ref in section.findall(f"{W}{region}Reference"):
                    target = parts.get(ref.get(f"{R}id"))
                    if ref.get(f"{W}type", "default") == "default" and target:
                        shown[region] = ElementTree.fromstring(archive.read(target))
                if shown[region] is None:
                    yield region, s, None, None, None, ElementTree.Element(f"{W}p")
                else:
                    yield from story(shown[region], region, s)


def file_rows(content: bytes) -> list[tuple]:
    """Rows of one file; an unreadable file is one row with an error, so the job goes on."""
    try:
        return [
            (i, region, section, t, cells, p, [run_text(r) for r in paragraph.findall(f"{W}r")], None)
            for i, (region, section, t, cells, p, paragraph) in enumerate(paragraphs(content))
        ]
    except Exception as e:  # damaged streams, odd numbers, encryption: one file never ends the job
        return [(None, None, None, None, None, None, None, f"{type(e).__name__}: {e}")]


FLUSH_ROWS = 4096  # paragraphs per batch that goes back to the JVM


def parse_docx(files: DataFrame, doc: str = "doc_id", content: str = "content") -> DataFrame:
    """(doc_id, para_idx, loc, runs, error) of files given as (doc_id, content)."""
    key = files.schema[doc].dataType.simpleString()
    schema = T.StructType.fromDDL(f"{doc} {key}, {ROW}")
    arrow = to_arrow_schema(schema)

    def parse(batches):
        rows = []
        for batch in batches:
            for name, data in zip(*(batch.column(c).to_pylist() for c in (doc, content))):
                rows += [(name, *row) for row in file_rows(data)]
                if len(rows) >= FLUSH_ROWS:
                    yield to_batch(rows, arrow)
                    rows = []
        if rows:
            yield to_batch(rows, arrow)

    rows = files.select(doc, content).mapInArrow(parse, schema)
    loc = loc_path(F.col("region"), F.col("section"), F.col("tbl"), F.col("cells"), F.col("p"))
    return rows.select(
        doc, "para_idx", F.when(F.col("error").isNull(), loc).alias("loc"), "runs", "error"
    )


def to_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema
    )


def docx_files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, content) of all .docx files below a folder."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.[dD][oO][cC][xX]")
        .option("recursiveFileLookup", "true")
        .load(folder)
        .select("path", "content")
    )


def read_docx(spark: SparkSession, folder: str) -> DataFrame:
    """Paragraph table of a folder of DOCX files, keyed by path."""
    return parse_docx(docx_files(spark, folder), "path").withColumnRenamed("path", "doc_id")
