"""A stream of lines, each detected and translated on its own."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from unitflow.functions.text import is_blank, strip_ws
from unitflow.operators.inference import Factory, translate_rows
from unitflow.operators.voting import with_unit_source
from unitflow.options import Options
from unitflow.sources.lines import raw_lines


def line_stream(spark: SparkSession, folder: str) -> DataFrame:
    """(path, text): non-blank lines of the text files that arrive in a folder."""
    raw = spark.readStream.text(folder).select(F.col("_metadata.file_path").alias("path"), "value")
    return raw_lines(raw).select("path", "text")


def translate_stream(
    lines: DataFrame, make_translator: Factory, opts: Options = Options()
) -> DataFrame:
    """Add ``src_lang`` and ``translated`` to a stream with a ``text`` column.

    Stateless, so there is no watermark; blank lines are dropped. Works on batch input alike.
    """
    given = lines.withColumn("text", strip_ws(F.col("text"))).filter(~is_blank(F.col("text")))
    return translate_rows(with_unit_source(given, opts.source, opts.profiles), make_translator, opts)


def start_append(stream: DataFrame, out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to a parquet folder; ``once`` takes what is there and ends."""
    writer = (
        stream.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start()
