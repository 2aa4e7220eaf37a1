"""Tables that count only once they are committed.

A job writes rows into a folder of its own; they belong to the ledger from the moment a small commit file names that
folder. What a job wrote before it died is in no commit, is never read, and can be swept. Each commit has an
id, so a job that runs again can ask what is done. One writer at a time; readers need no lock.
"""

from __future__ import annotations

import json
import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from unitflow.session import hadoop_path

COMPACT_AT = 64  # commits that a reader has to list before they are made one


class Ledger:
    """Committed tables of one schema under ``path``.

    ``path/data/<folder>`` holds rows, ``path/commits/<number>.json`` names a folder and the ids it stands
    for. The driver holds the commits, never rows.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema

    def commits(self) -> list[dict]:
        """(number, folder, ids) of all commits that count, oldest first."""
        files, folder = hadoop_path(self.spark, f"{self.path}/commits")
        if not files.exists(folder):
            return []
        paths = [status.getPath() for status in files.listStatus(folder)]
        paths = [p.toString() for p in paths if re.fullmatch(r"\d+\.json", p.getName())]
        if not paths:
            return []
        # one job for all of them: a job each would be as many as the square of the commits
        texts = self.spark.read.text(paths, wholetext=True).select("_metadata.file_name", "value").collect()
        found = [{"number": int(name[:-5]), **json.loads(text)} for name, text in texts]
        found.sort(key=lambda c: c["number"])
        # a compacted table stands for all commits before it
        last = max((i for i, c in enumerate(found) if c["whole"]), default=0)
        return found[last:]

    def ids(self) -> set[str]:
        return {i for c in self.commits() for i in c["ids"]}

    def read(self) -> DataFrame:
        """All committed rows."""
        folders = [f"{self.path}/data/{c['folder']}" for c in self.commits() if c["folder"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def read_of(self, id: str) -> DataFrame:
        """The rows that were committed under ``id`` alone; none if it is not committed or was compacted."""
        folders = [c["folder"] for c in self.commits() if c["ids"] == [id] and c["folder"]]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*[f"{self.path}/data/{f}" for f in folders])

    def stage(self, rows: DataFrame) -> str:
        """Write rows into a folder of their own, which no reader sees yet; gives its name."""
        folder = uuid.uuid4().hex
        names = [f.name for f in self.schema]
        rows.select(*names).write.parquet(f"{self.path}/data/{folder}", compression="zstd")
        return folder

    def commit(self, folder: str | None, id: str) -> None:
        """From now on the folder's rows count; without a folder only the id does."""
        commits = self.commits()
        if any(id in c["ids"] for c in commits):
            raise ValueError(f"{id} is committed already")
        self._put({"folder": folder, "ids": [id], "whole": False}, commits)

    def _put(self, entry: dict, commits: list[dict]) -> None:
        number = 1 + max((c["number"] for c in commits), default=-1)
        files, temporary = hadoop_path(self.spark, f"{self.path}/commits/_{uuid.uuid4().hex}")
        out = files.create(temporary, False)
        out.write(json.dumps(entry).encode())
        out.close()
        # a file of its final name is whole: it was written under another one
        _, final = hadoop_path(self.spark, f"{self.path}/commits/{number:010d}.json")
        if files.exists(final) or not files.rename(temporary, final):
            raise RuntimeError(f"{self.path}: another writer has committed {number}")

    def compact(self, rows: DataFrame | None = None) -> None:
        """Make all commits one, which stands for all their ids; old folders are left for ``sweep``.

        ``rows``: what is to stand for them, by default all rows.
        """
        commits = self.commits()
        folder = self.stage(self.read() if rows is None else rows)
        ids = [i for c in commits for i in c["ids"]]
        self._put({"folder": folder, "ids": ids, "whole": True}, commits)

    def sweep(self) -> int:
        """Delete folders that no commit names, and commits that a compacted one stands for; no job may be writing."""
        commits = self.commits()
        kept = {c["folder"] for c in commits}
        numbers = {f"{c['number']:010d}.json" for c in commits}
        gone = 0
        for part, names in (("data", kept), ("commits", numbers)):
            files, folder = hadoop_path(self.spark, f"{self.path}/{part}")
            if files.exists(folder):
                for status in files.listStatus(folder):
                    if status.getPath().getName() not in names:
                        files.delete(status.getPath(), True)
                        gone += 1
        return gone
