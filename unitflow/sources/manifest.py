"""Which files are taken, what they become, and which writer makes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.options import FORMATS, MIME_TYPES, OUTPUT_SUFFIX

# --- Fixed values: (input suffix, output format) -> writer -------------------------------------
WRITERS = {
    (".docx", "docx"): "replace_paragraphs",
    (".pdf", "docx"): "rebuild_pages",
    (".pdf", "pdf"): "replace_spans",
    (".docx", "pdf"): "paginate_lines",
}
# ------------------------------------------------------------------------------------------------

FILE_NAME = "([^/]*)$"
SUFFIXED = "^(.+)(\\.[^./]+)$"  # a leading dot alone is no suffix


def path_suffix(path: Column) -> Column:
    """Suffix of the last path component with its dot; '' when it has none."""
    return F.regexp_extract(F.regexp_extract(path, FILE_NAME, 1), SUFFIXED, 2)


def path_stem(path: Column) -> Column:
    name = F.regexp_extract(path, FILE_NAME, 1)
    return F.when(name.rlike(SUFFIXED), F.regexp_extract(name, SUFFIXED, 1)).otherwise(name)


def path_folder(path: Column) -> Column:
    """All up to and with the last slash."""
    return F.regexp_extract(path, "^(.*/)?[^/]*$", 1)


def plan_manifest(files: DataFrame, path: str = "path", requested: str = "requested") -> DataFrame:
    """Add suffix, supported, out_format, out_path, mime, reject_reason.

    ``out`` may hold a wished output path, whose suffix is replaced. A bad file becomes a row with
    a reason, so that it does not end the job of all others.
    """
    suffix = F.lower(path_suffix(F.col(path)))
    wish = F.lower(F.coalesce(F.nullif(F.col(requested), F.lit("")), F.lit("auto")))
    supported = suffix.isin(*[f".{f}" for f in FORMATS])
    known = wish.isin("auto", *FORMATS)
    reason = F.when(~supported, "unsupported input").when(~known, "unknown output format")
    fmt = F.when(wish == "auto", F.substr(suffix, F.lit(2))).otherwise(wish)
    default = F.concat(
        path_folder(F.col(path)), path_stem(F.col(path)), F.lit(OUTPUT_SUFFIX), F.lit("."), fmt
    )
    if "out" in files.columns:
        wished = F.concat(
            path_folder(F.col("out")), path_stem(F.col("out")), F.lit("."), fmt
        )
        target = F.when(F.coalesce(F.col("out"), F.lit("")) != "", wished).otherwise(default)
    else:
        target = default
    mime = F.when(fmt == "pdf", MIME_TYPES["pdf"]).otherwise(MIME_TYPES["docx"])
    return files.select(
        "*",
        suffix.alias("suffix"),
        supported.alias("supported"),
        F.when(reason.isNull(), fmt).alias("out_format"),
        F.when(reason.isNull(), target).alias("out_path"),
        F.when(reason.isNull(), mime).alias("mime"),
        reason.alias("reject_reason"),
    )


def route(manifest: DataFrame) -> DataFrame:
    """Add ``writer``; null for rejected rows."""
    writer = F.lit(None).cast("string")
    for (suffix, fmt), name in WRITERS.items():
        hit = (F.col("suffix") == suffix) & (F.col("out_format") == fmt)
        writer = F.when(hit, name).otherwise(writer)
    return manifest.withColumn("writer", F.when(F.col("reject_reason").isNull(), writer))
