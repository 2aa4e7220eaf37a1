"""Cases that earlier versions of the operators got wrong."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from unitflow.llm import mixing, runs, suffix_dedup, token_files


def rated_totals(members, history, k):
    rate = mixing.rate_of(F.col("p"), history)
    sums = [F.sum(rate * F.col("n_tokens") * F.get("p", F.lit(i))) for i in range(k)]
    return np.array(members.agg(*sums).first())


def test_domains_that_are_alike_meet_their_targets(spark):
    members = spark.createDataFrame(
        [(100, [0.6, 0.4]), (100, [0.4, 0.6])] * 3, "n_tokens long, p array<double>"
    )
    history = mixing.fit_rates(members, 2, [0.42, 0.58])
    totals = rated_totals(members, history, 2)
    assert np.allclose(totals / totals.sum(), [0.42, 0.58], atol=1e-4)


def test_targets_out_of_reach_give_a_warning(spark):
    members = spark.createDataFrame([(100, [0.6, 0.4]), (9, [0.4, 0.6])], "n_tokens long, p array<double>")
    with pytest.warns(UserWarning, match="do not reach"):
        history = mixing.fit_rates(members, 2, [0.1, 0.9])
    assert (rated_totals(members, history, 2) >= 0).all()


def test_the_classifier_s_sample_is_bounded_and_broadcast(spark):
    rows = [(i, f"word{i % 3}", "abc"[i % 3]) for i in range(300)]
    docs = spark.createDataFrame([*rows, (None, "x", "a"), (1, "word1", None)], "doc_id long, text string, lang string")
    few = mixing.learn_domains(docs, docs.unionByName(docs), sample=9)
    everything = mixing.learn_domains(docs, docs)
    assert len(few.names) <= 3 and everything.names == ["a", "b", "c"]
    assert np.allclose(np.exp(everything.prior).sum(), 1)


def test_each_file_is_read_by_a_task(spark):
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.repeat(F.lit("some words "), 50).alias("text"))
    manifest = token_files.write_tokens(docs, file_bytes=2048)
    n = manifest.count()
    read = token_files.read_tokens(manifest)
    used = read.withColumn("task", F.spark_partition_id()).agg(F.countDistinct("task")).first()[0]
    assert n > 8 and used > n // 2
    assert read.count() == 200


def test_texts_of_one_hash_under_one_id(spark):
    texts = spark.range(300_000).select(F.concat(F.lpad("id", 60, "x"), F.sha2(F.col("id").cast("string"), 256)).alias("t"))
    pair = texts.groupBy(F.hash("t")).agg(F.collect_list("t").alias("ts")).where("size(ts) > 1").first().ts[:2]
    a, b = pair
    shared = "shared words of two documents " * 3
    rows = [(1, a + shared), (2, a + shared), (2, b)]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    kept = sorted((r.doc_id, bytes(r.kept).decode()) for r in got)
    assert kept[0] == (1, a + shared) and ("" in [t for _, t in kept[1:]])
    # nothing of b is in document 1 but the padding, which is under fifty bytes of another text
    longest = max(n for n in range(61) if a[:n] == b[:n])
    assert (2, b if longest < 50 else b[longest:]) in kept


def test_long_segments_are_cut_whole():
    texts = [b"a" * 500, b"x" * 49, b"ab" * 200 + bytes(range(256)), b""]
    row, start, n, _, _ = suffix_dedup._segments(texts, 50, suffix_dedup._Hasher(), 20, 0, 1)
    assert n.max() == suffix_dedup.MAX_SEGMENT
    starts = [(int(r), int(a) + i) for r, a, k in zip(row, start, n, strict=True) for i in range(k)]
    assert sorted(starts) == [(r, i) for r, t in enumerate(texts) for i in range(len(t) - 49)]


def test_runs_of_neighbouring_places():
    place = lambda start, n: start * suffix_dedup.MAX_SEGMENT + n - 1
    low, high = suffix_dedup._runs([place(70, 5), place(0, 64), place(64, 3), place(1, 2), place(75, 1)])
    assert (low.tolist(), high.tolist()) == ([0, 70], [67, 76])


def test_levels_merge_in_the_scan_that_reads_them(spark, monkeypatch):
    """r03: a merge of its own shuffled, sorted and wrote both runs once more."""

    def written(*_):
        raise AssertionError("a run is written apart from its scan")

    lent, lend = [], runs.LevelledRuns.lend

    def noted(self, table, level=0, merged=()):
        lend(self, table, level, merged)
        lent.append((level, len(merged), len(self.runs), self.tables()[-1].count()))

    monkeypatch.setattr(runs.LevelledRuns, "_write", written)
    monkeypatch.setattr(runs.LevelledRuns, "lend", noted)
    texts = [f"{i} " * 60 + "what all of them have, at a length that is well over fifty bytes" for i in range(100, 108)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = suffix_dedup.remove_repeats(df, batches=8, slices=1).orderBy("doc_id").collect()
    assert [x[:3] for x in lent] == [(0, 0, 1), (1, 1, 1), (0, 0, 2), (2, 2, 1), (0, 0, 2), (1, 1, 2), (0, 0, 3)]
    assert lent[3][3] > lent[1][3] > lent[0][3] and lent[2][3] < lent[1][3]
    assert bytes(got[0].kept).decode() == texts[0]
    # the numbers differ, the space after the last does not
    assert all(bytes(r.kept).decode() == texts[r.doc_id][:239] for r in got[1:])


def test_strings_come_by_segment(spark):
    """r03: Python gave a row for each string, not one for each segment."""
    text = "".join(map(chr, range(33, 113)))  # 80 bytes without a repeat: 31 strings
    place = lambda start, n: {"anchor": 5, "place": start * suffix_dedup.MAX_SEGMENT + n - 1}
    rows = [
        (1, 0, text + "-" + text, [place(0, 31), place(81, 31), place(31, 50)]),
        (2, 0, "x" + text, [place(1, 31)]),
        (3, 0, "", []),
    ]
    df = spark.createDataFrame(
        rows, "doc long, version long, text string, parts array<struct<anchor: long, place: long>>"
    ).coalesce(1)
    got = suffix_dedup.strings(df).collect()
    starts = lambda r: sorted([r.start, *(r.start + away for away in r.more or [])])
    assert sorted((r.doc, starts(r), len(r.strings)) for r in got) == [
        (1, [0, 81], 31),
        (1, [31], 50),
        (2, [1], 31),
    ]
    whole = [r.strings for r in got if len(r.strings) == 31]
    assert whole[0] == whole[1] and len(set(whole[0])) == 31 and {r.anchor for r in got} == {5}
    apart = suffix_dedup.strings(df, step=1).collect()
    assert len(apart) == 4 and {tuple(r.strings) for r in apart} == {tuple(r.strings) for r in got}


def test_batches_double(spark):
    """r03: four equal batches read two and a half times the corpus, as each scan reads all that came before."""
    df = spark.range(80).withColumnRenamed("id", "doc_id")
    sizes = lambda batches: [part.count() for part in runs.ascending(df, batches)]
    assert sizes(4) == [20] * 4
    assert sizes(suffix_dedup.BATCHES) == [10, 10, 20, 40]


def test_blocks_hold_the_strings_that_meet(spark):
    """r03: every string of a segment in doubt was a row of its own, most of them of no other document."""
    rng = np.random.default_rng(3)
    words = lambda n: "".join(map(chr, rng.integers(33, 126, n)))
    shared, period = words(70), "ab" * 40
    texts = [words(40) + shared + words(40) + period, words(25) + shared + words(60), period + words(30), words(300)]
    row, start, n, anchor, _ = suffix_dedup._segments(
        [t.encode() for t in texts], 50, suffix_dedup._Hasher(), suffix_dedup.ANCHOR, 0, 1
    )
    place = (start * suffix_dedup.MAX_SEGMENT + n - 1).tolist()
    parts = [
        [{"anchor": a, "place": p} for r, a, p in zip(row, anchor.view(np.int64).tolist(), place) if r == i]
        for i in range(len(texts))
    ]
    df = spark.createDataFrame(
        [(i, 0, t, own) for i, (t, own) in enumerate(zip(texts, parts))],
        "doc long, version long, text string, parts array<struct<anchor: long, place: long>>",
    )
    found, blocks, total = {}, 0, 0
    for r in suffix_dedup.strings(df).collect():
        assert [b.nth for b in r.blocks] == [sum(x.n for x in r.blocks[:k]) for k in range(len(r.blocks))]
        assert sum(b.n for b in r.blocks) == len(r.strings)
        blocks, total = blocks + len(r.blocks), total + len(r.strings)
        for b in r.blocks:
            assert b.n <= suffix_dedup.BLOCK
            for k in range(b.nth, b.nth + b.n):
                found.setdefault(texts[r.doc][r.start + k :][:50], set()).add((r.anchor, b.seg))
    common = {shared[i : i + 50] for i in range(21)} | {period[i : i + 50] for i in range(2)}
    assert common <= found.keys() and all(len(keys) == 1 for keys in found.values())
    assert blocks < total / 3


def test_strings_of_one_anchor_are_not_one_task(spark):
    schema = "doc long, version long, text string, parts array<struct<anchor: long, place: long>>"
    df = spark.createDataFrame([(0, 0, "", [])], schema)
    docs, doubt = df.select("doc", "version", "text"), df.selectExpr("doc", "version", "0L anchor", "0L place")
    plan = suffix_dedup._compared(docs, doubt, 50)._jdf.queryExecution().executedPlan().toString()
    last = next(line for line in plan.splitlines() if "Exchange hashpartitioning" in line)
    assert "seg" in last and "anchor" in last
