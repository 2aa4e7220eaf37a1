"""Column helpers that several operators share.

Conventions of all operators here: a null text is the empty text; a null ``doc_id`` is one document
whose id sorts after all others; rows that repeat a ``doc_id`` are parts of one document and each gets
a row of its own in the result; input columns that an operator does not name pass through or are
dropped as its docstring says, whatever they are called.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that bounds words and line keys.
SPACE = " \t\n\x0b\x0c\r"
SPACE_CLASS = r"[\x20\x09-\x0D]"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

LAST_ID = 2**63 - 1


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_of(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def id_of(name: str = "doc_id") -> Column:
    """The id that decides order: null counts as the last one."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LAST_ID))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once a row.

    Lambdas are evaluated for each element, and the optimizer may put a column's definition into
    them; a lambda variable of a one-element array is a value, not a definition.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(text, SPACE_CLASS + "+"), "")


def count_of(text: Column, pattern: str) -> Column:
    """How often ``pattern`` (which must not match the empty string) is found."""
    return F.size(F.split(text, pattern)) - 1


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z, all else as it is; the dictionary walk only where there is more than ASCII."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )
