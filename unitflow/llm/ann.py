"""Approximate nearest neighbours by cross-polytope hashing.

A table of the index rotates unit vectors by three rounds of random signs and a fast Hadamard transform
and files each under its nearest signed axis. A query probes the axes nearest to it in every table, and
all vectors found there are reranked by their true cosine.

Equal vectors are one row of the index that names the smallest ids of its copies, which is all a result
can need. A cell is cut into blocks of vectors and blocks of queries by their counts, so no task holds a
whole cell, and each pair of blocks gives ``k`` rows for each query, never its pairs, however many tie.

A query that the probed cells give fewer than ``k`` neighbours then probes all other cells of the first
table. Every vector is in one cell of that table, so such a query has seen them all.

A table has 2 d cells. Nearest neighbours that are hardly nearer than others, as in random data, need wide
probing, and the defaults are set for those; where neighbours are close, fewer ``probes`` do.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from unitflow.session import materialise

TABLES = 4
PROBES = 32
NEIGHBOURS = 5
MAX_CELLS = 2**31 - 1  # all cells of a table
VECTOR_BLOCK = 20_000
QUERY_BLOCK = 2_000
ROUNDS = 3
SEED = 7


def _hadamard(x: np.ndarray) -> np.ndarray:
    n, half = x.shape[1], 1
    while half < n:
        pairs = x.reshape(len(x), -1, 2, half)
        a, b = pairs[:, :, 0], pairs[:, :, 1]
        x = np.stack([a + b, a - b], axis=2).reshape(len(x), n)
        half *= 2
    return x / np.sqrt(n)


def _axes(vectors: np.ndarray, table: int) -> np.ndarray:
    """The rotated vectors' coordinates on all signed axes."""
    n, d = vectors.shape
    size = 1 << max(0, d - 1).bit_length()
    x = np.zeros((n, size))
    x[:, :d] = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    random = np.random.default_rng([SEED, table, size])
    for _ in range(ROUNDS):
        x = _hadamard(x * random.choice([-1.0, 1.0], size))
    return np.concatenate([x, -x], axis=1)


def _cells(probes: int, tables: int):
    """Column function: for each table the ``probes`` nearest signed axes of a vector."""

    @F.pandas_udf("array<array<int>>")
    def run(vectors: pd.Series) -> pd.Series:
        out: list = [None] * len(vectors)
        sizes = vectors.map(len).to_numpy()
        for d in np.unique(sizes):
            rows = np.nonzero(sizes == d)[0]
            for low in range(0, len(rows), 2000):
                some = rows[low : low + 2000]
                block = np.stack([np.asarray(vectors.iloc[i], dtype=np.float64) for i in some])
                block /= np.abs(block).max(axis=1, keepdims=True)
                found = []
                for table in range(tables):
                    axes = _axes(block, table)
                    k = min(probes, axes.shape[1])
                    found.append(np.argsort(-axes, axis=1, kind="stable")[:, :k])
                for j, i in enumerate(some):
                    out[i] = [f[j].astype(np.int32) for f in found]
        return pd.Series(out)

    return run


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    d = vector.cast("array<double>")
    fine = F.forall(d, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(fine & F.exists(d, lambda x: x != 0), F.lit(False))


_PLACE = ["table", "cell", "dim"]
_KEY = [*_PLACE, "a", "b"]
_FOUND = "query_id long, rep long, same long, members array<long>, score double"
_NAMES = ["query_id", "rep", "same", "members", "score"]
_TYPES = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.float64()]
PAIR_VALUES = 4_000_000  # components of pairs that are scored exactly at a time


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    out = flat.reshape(len(column), -1)
    return out / np.abs(out).max(axis=1, keepdims=True)  # no overflow; cosines stay as they are


def _rerank(keep: int):
    """For each query of a block its ``keep`` nearest vectors of a block, with exact cosines.

    A vector whose only id is the query's own is none of them; ties go to the smallest id besides that.
    """

    def run(vectors: pa.Table, queries: pa.Table) -> pa.Table:
        if not vectors.num_rows or not queries.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in _TYPES], _NAMES)
        v, q = _matrix(vectors["vector"]), _matrix(queries["vector"])
        v_norm, q_norm = np.sqrt((v * v).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        ids, q_ids = vectors["id"].to_numpy(), queries["id"].to_numpy()
        members = vectors["members"].combine_chunks()
        starts = members.offsets.to_numpy()[:-1]
        copies = np.diff(members.offsets.to_numpy())
        # the second id of a vector; the first where there is no second
        second = members.values.to_numpy()[starts + (copies > 1)]
        alone = np.where(copies == 1, ids, np.iinfo(np.int64).min)
        step = max(1, PAIR_VALUES // v.shape[1])
        k = min(keep, len(v))
        picked = []
        for low in range(0, len(q), 256):
            mine = q_ids[low : low + 256]
            near = (q[low : low + 256] @ v.T) / q_norm[low : low + 256, None] / v_norm
            near[mine[:, None] == alone] = -np.inf
            least = np.partition(near, len(v) - k, axis=1)[:, len(v) - k]
            r, c = np.nonzero((near >= least[:, None] - 1e-12) & (near > -np.inf))
            exact = [
                (q[r[i : i + step] + low] * v[c[i : i + step]]).sum(axis=1)
                / (q_norm[r[i : i + step] + low] * v_norm[c[i : i + step]])
                for i in range(0, len(r), step)
            ]
            score = np.clip(np.concatenate([*exact, np.zeros(0)]), -1.0, 1.0)
            first = np.where(ids[c] == mine[r], second[c], ids[c])
            order = np.lexsort((first, -score, r))
            r, c, score = r[order], c[order], score[order]
            nth = np.arange(len(r)) - np.searchsorted(r, r)
            ok = nth < k
            picked.append((r[ok] + low, c[ok], score[ok]))
        r, c, score = (np.concatenate(column) for column in zip(*picked, strict=True))
        arrays = [
            pa.array(q_ids[r]),
            pa.array(ids[c]),
            vectors["same"].combine_chunks().take(pa.array(c)),
            members.take(pa.array(c)),
            pa.array(score),
        ]
        return pa.Table.from_arrays([a.cast(t) for a, t in zip(arrays, _TYPES, strict=True)], _NAMES)

    return run


def _search(
    filed: DataFrame, probing: DataFrame, k: int, vector_block: int, query_block: int
) -> DataFrame:
    """The ``k`` nearest of each query in each pair of blocks of the cells that it probes.

    ``probing`` has a row for each query and probed (table, cell).
    """
    v = filed.select("id", "same", "members", "vector", "dim", F.posexplode("cells").alias("table", "cell"))
    sized = lambda df, n: df.groupBy(*_PLACE).agg(F.count("*").alias(n))
    # tables x 2 dims rows: as small for any number of vectors
    cells = sized(v.select(*_PLACE), "nv").join(sized(probing.select(*_PLACE), "nq"), _PLACE)
    cells = cells.select(
        *_PLACE,
        F.ceil(F.col("nv") / vector_block).cast("int").alias("va"),
        F.ceil(F.col("nq") / query_block).cast("int").alias("qb"),
    )
    cells = F.broadcast(materialise(cells, "cells"))
    part = lambda key, n: F.pmod(key, n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    v = v.join(cells, _PLACE).select(
        "*", part(F.xxhash64("id", "same"), F.col("va")).alias("a"), every(F.col("qb")).alias("b")
    )
    q = probing.join(cells, _PLACE).select(
        "*", part(F.xxhash64("id"), F.col("qb")).alias("b"), every(F.col("va")).alias("a")
    )
    return (
        v.select(*_KEY, "id", "same", "members", "vector")
        .groupBy(*_KEY)
        .cogroup(q.select(*_KEY, "id", "vector").groupBy(*_KEY))
        .applyInArrow(_rerank(k), _FOUND)
    )


def nearest(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = NEIGHBOURS,
    tables: int = TABLES,
    probes: int = PROBES,
    vector_block: int = VECTOR_BLOCK,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found for each query, its own row excluded.

    ``vectors`` and ``queries`` have vec_id and embedding; other columns are not looked at. ``score`` is the
    cosine in double precision; ranks start at 1, nearest first, ties to the smaller ``vec_id``. Rows with
    a null id, and vectors that are null, zero or have null or non-finite components take no part; vectors of
    another length than the query's are no candidates. A repeated vec_id counts once for each different
    vector; a query id that repeats asks with all its vectors and gets the nearest to any of them. A query
    has fewer than ``k`` rows only where there are fewer candidates.
    """
    vector = F.col("embedding")
    ok = usable(vector) & F.col("vec_id").isNotNull()
    data = vectors.where(ok).select(F.col("vec_id").cast("long"), "embedding")
    own = Window.partitionBy("embedding").orderBy("vec_id")
    # the limit on the row number is taken before the shuffle as well: a hot vector is never gathered
    firsts = data.withColumn("nth", F.row_number().over(own)).where(F.col("nth") <= k + 1)
    reps = firsts.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("members"))
    asked = queries.where(ok).select(F.col("vec_id").cast("long").alias("id"), "embedding").distinct()

    filed = materialise(
        reps.select(
            F.col("members")[0].alias("id"),
            F.xxhash64("embedding").alias("same"),  # tells vectors of one id apart
            "members",
            F.col("embedding").alias("vector"),
            F.size("embedding").alias("dim"),
            F.flatten(_cells(1, tables)(vector)).alias("cells"),
        ),
        "index",
    )
    probing = materialise(
        asked.select(
            "id",
            F.col("embedding").alias("vector"),
            F.size("embedding").alias("dim"),
            _cells(probes, tables)(vector).alias("cells"),
        ),
        "queries",
    )
    what = ["id", "vector", "dim", "table"]
    probed = probing.select("id", "vector", "dim", F.posexplode("cells").alias("table", "each"))
    probed = probed.select(*what, F.explode("each").alias("cell"))
    near = _named(_search(filed, probed, k, vector_block, query_block))
    found = materialise(_rank(near, k), "near")
    full = found.where(F.col("rank") == k).select(F.col("query_id").alias("id"))
    # ids and vectors of few queries, unless the table is small
    short = materialise(probing.join(full, "id", "left_anti"), "short")
    if not short.isEmpty():
        other = F.array_except(_cells(MAX_CELLS, 1)(F.col("vector"))[0], F.col("cells")[0])
        rest = short.select("id", "vector", "dim", F.lit(0).alias("table"), F.explode(other).alias("cell"))
        more = _search(filed, rest, k, vector_block, query_block)
        mine = found.join(short.select(F.col("id").alias("query_id")).distinct(), "query_id", "left_semi")
        # the first pass has seen some of these vectors through other tables
        both = _named(more).unionByName(mine.drop("rank"))
        mended = _rank(both.groupBy("query_id", "same", "vec_id").agg(F.max("score").alias("score")), k)
        whole = found.join(full.withColumnRenamed("id", "query_id"), "query_id", "left_semi")
        found = whole.unionByName(mended)
    return found.select("query_id", "rank", "vec_id", "score")


def _named(found: DataFrame) -> DataFrame:
    """(query_id, same, vec_id, score) of the vectors found, each once; not the query's own id."""
    once = found.groupBy("query_id", "rep", "same").agg(F.max(F.struct("score", "members")).alias("best"))
    return once.select(
        "query_id",
        "same",
        F.explode("best.members").alias("vec_id"),
        F.col("best.score").alias("score"),
    ).where("vec_id != query_id")


def _rank(named: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return named.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
