"""SimHash near-dedup with pivot distance tables.

Every distinct fingerprint gets a row of Hamming distances to reference fingerprints (pivots). Two
fingerprints at distance k have distances to any pivot that differ by at most k, so a pair with a larger
difference in any coordinate is discarded before its bits are compared.

A pivot table alone has no equality key and would mean comparing all pairs, so candidates meet by blocks:
the 64 bits are cut into ``max_bits + 3`` blocks, two linked fingerprints agree in at least three whole
blocks, and each choice of three blocks is an equi-join. Copies are one row before that, so a group of
copies costs nothing; a crowded key is split by adaptive execution, as both sides are plain shuffles.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import LAST_ID, id_of, text_of
from unitflow.llm.graph import components
from unitflow.session import materialise

WIDTH = 3
MAX_BITS = 3
PIVOTS = 16
SEED = 42
CHUNK = 1 << 16


def _fingerprint(text: str, width: int) -> int:
    words = text.encode("utf-8", "replace").lower().split()
    n = max(1, len(words) - width + 1)
    if not words:
        return 0
    counts = np.zeros(64, dtype=np.int64)
    for low in range(0, n, CHUNK):
        high = min(n, low + CHUNK)
        part = words[low : high + width - 1]
        shingles = zip(*(part[k:] for k in range(width)), strict=False)
        joined = map(b" ".join, shingles) if len(part) >= width else [b" ".join(part)]
        hashes = np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in joined), np.uint64)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    ones = np.packbits(2 * counts > n, bitorder="little")
    return int(ones.view(np.int64)[0])


def fingerprint(text: Column, width: int = WIDTH) -> Column:
    """The signed 64-bit SimHash of word shingles; 0 for a null text or one without a word.

    Words are runs without ASCII white space, A-Z lower-cased. A bit is set if it is set in over half of
    the XXH64 hashes of all shingles, repeats included. A text of fewer words than ``width`` is one shingle.
    """

    @F.pandas_udf("long")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([_fingerprint(t, width) for t in texts], dtype="int64")

    return run(F.coalesce(text.cast("string"), F.lit("")))


def _pivot(j: int) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(b"pivot %d" % j)).view(np.int64))


def pivot_table(fp: Column, pivots: int = PIVOTS) -> list[Column]:
    """Distances of ``fp`` to the pivots, eight to a long."""
    packed = []
    for low in range(0, pivots, 8):
        word = F.lit(0).cast("long")
        for j in range(low, min(low + 8, pivots)):
            near = F.bit_count(fp.bitwiseXOR(F.lit(_pivot(j)))).cast("long")
            word = word.bitwiseOR(F.shiftleft(near, 8 * (j - low)))
        packed.append(word.alias(f"pivots{low // 8}"))
    return packed


def _within(max_bits: int, pivots: int) -> Column:
    """No pivot distance of the two rows a and b differs by more than ``max_bits``."""
    byte = lambda side, j: F.shiftright(F.col(f"{side}.pivots{j // 8}"), 8 * (j % 8)).bitwiseAND(
        F.lit(255).cast("long")
    )
    ok = F.lit(True)
    for j in range(pivots):
        ok = ok & (F.abs(byte("a", j) - byte("b", j)) <= max_bits)
    return ok


def _masks(max_bits: int) -> list[int]:
    blocks = max_bits + 3
    edges = [64 * k // blocks for k in range(blocks + 1)]
    block = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:], strict=False)]
    return [int(np.uint64(sum(c)).view(np.int64)) for c in combinations(block, blocks - max_bits)]


def links(prints: DataFrame, max_bits: int = MAX_BITS, pivots: int = PIVOTS) -> DataFrame:
    """Pairs (a, b) of the ``node`` ids whose ``fp`` differ in 1 to ``max_bits`` bits, each once.

    ``prints``: one row for each distinct fingerprint.
    """
    fp = F.col("fp")
    keys = F.array(*[fp.bitwiseAND(F.lit(m)) for m in _masks(max_bits)])
    rows = prints.select("node", "fp", *pivot_table(fp, pivots)).select(
        "*", F.posexplode(keys).alias("table", "key")
    )
    a, b = rows.alias("a"), rows.alias("b")
    met = (
        (F.col("a.table") == F.col("b.table"))
        & (F.col("a.key") == F.col("b.key"))
        & (F.col("a.fp") < F.col("b.fp"))
    )
    near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= max_bits
    return (
        a.join(b, met & _within(max_bits, pivots) & near)
        .select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
        .distinct()
    )


def near_groups(
    docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS, pivots: int = PIVOTS
) -> DataFrame:
    """(doc_id, fp, component_id) of each row of ``docs``; other columns are not looked at.

    ``component_id`` is the smallest ``doc_id`` that links of at most ``max_bits`` bits reach, itself
    included. Null ids count as the last id and give a null component only where no other id is reached.
    Null and empty texts have fingerprint 0 and are linked like any other; repeated rows get a row each.
    """
    rows = materialise(
        docs.select("doc_id", id_of().alias("id"), fingerprint(text_of(), width).alias("fp")),
        "fingerprints",
    )
    prints = materialise(rows.groupBy("fp").agg(F.min("id").alias("node")), "prints")
    roots = components(links(prints, max_bits, pivots))
    named = prints.join(roots, "node", "left").select(
        "fp", F.coalesce("root", "node").alias("component_id")
    )
    return rows.join(named, "fp").select(
        "doc_id", "fp", F.nullif("component_id", F.lit(LAST_ID)).alias("component_id")
    )


def keep_first(docs: DataFrame, width: int = WIDTH, max_bits: int = MAX_BITS) -> DataFrame:
    """The rows of ``docs`` whose document is the first of its group; all columns as they are."""
    groups = near_groups(docs, width, max_bits)
    first = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).select(
        id_of().alias("__first")
    )
    return docs.join(first.distinct(), id_of() == F.col("__first"), "left_semi")
