"""Levelled sorted runs: an index that takes batches and merges its runs geometrically."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from itertools import accumulate

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from unitflow.llm.common import id_of
from unitflow.session import fresh_path, remove


class LevelledRuns:
    """Runs of rows with unique ``key`` columns, each a Parquet table sorted by key, and their levels.

    A batch is a run of level 0; as soon as a level has ``fanout`` runs, they become one run of the next
    level. A key is in one run only. The driver holds the runs' paths, nothing of their rows.
    ``live``: a condition for the rows of a lent table that belong to its run.
    """

    def __init__(self, spark: SparkSession, key: list[str], fanout: int, live: str = "true"):
        self.spark, self.key, self.fanout, self.made = spark, key, fanout, 0
        self.live, self.lent = live, set()
        self.path = fresh_path(spark, "runs")
        self.runs: list[tuple[int, str]] = []  # (level, path), oldest first
        self.schema = None

    def tables(self) -> list[DataFrame]:
        return [self._read(path) for _, path in self.runs]

    def _read(self, *paths: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*paths).where(self.live)

    def _remove(self, path: str) -> None:
        if path not in self.lent:
            remove(self.spark, path)

    def _write(self, rows: DataFrame, level: int) -> None:
        path = f"{self.path}/level={level}-run={self.made}"
        self.schema = rows.schema
        self.made += 1
        rows.sortWithinPartitions(*self.key).write.parquet(path)
        self.runs.append((level, path))

    def named(self) -> list[tuple[str, DataFrame]]:
        return [(path, self._read(path)) for _, path in self.runs]

    def due(self) -> tuple[list[str], int]:
        """The runs that become one with the next run of level 0, as levels get full, and the level of that."""
        paths, level = [], 0
        while True:
            full = [path for at, path in self.runs if at == level]
            if len(full) + 1 < max(self.fanout, 2):
                return paths, level
            paths += full
            level += 1

    def lend(self, table: DataFrame, level: int = 0, merged: Iterable[str] = ()) -> None:
        """Take the live rows of a written table as a run; the table stays its owner's.

        They are new keys and all rows of the runs ``merged``, which are no runs any more.
        """
        self.schema = table.schema
        self.lent.add(table.written_to)
        self.runs = [run for run in self.runs if run[1] not in merged]
        self.runs.append((level, table.written_to))
        for path in merged:
            self._remove(path)

    def add(self, rows: DataFrame) -> DataFrame:
        """Write the rows whose key no run holds as a run of their own; gives that run."""
        for run in self.tables():
            rows = rows.join(run.select(*self.key), self.key, "left_anti")
        self._write(rows, 0)
        return self.tables()[-1]

    def drop(self) -> None:
        """Delete all runs."""
        for _, path in self.runs:
            self._remove(path)
        self.runs = []

    def compact(self) -> None:
        """Merge each full level into one run of the next; keys are unique, so this is a union."""
        level = 0
        while any(at >= level for at, _ in self.runs):
            full = [path for at, path in self.runs if at == level]
            if len(full) >= self.fanout:
                self.runs = [run for run in self.runs if run[0] != level]
                self._write(self._read(*full).repartition(*self.key), level + 1)
                for path in full:
                    self._remove(path)
            level += 1


def ascending(
    docs: DataFrame, batches: int | Sequence[int], key: Column | None = None
) -> Iterator[DataFrame]:
    """``docs`` in batches by ascending ``key`` (default: ``doc_id``, null last).

    ``batches``: how many, of about equal size, or the share of each.
    """
    key = id_of() if key is None else key
    shares = [1] * batches if isinstance(batches, int) else batches
    at = [done / sum(shares) for done in accumulate(shares[:-1])]
    cuts = docs.select(F.percentile_approx(key, at, 10_000)).first()[0] if at else []
    cuts = sorted(set(cuts or []))
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        batch = docs
        if low is not None:
            batch = batch.where(key > low)
        if high is not None:
            batch = batch.where(key <= high)
        yield batch
