"""Operators on small made tables: nulls, empty and long texts, ties, repeats, other columns, and brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from unitflow.llm import (
    ann,
    bpe,
    graph,
    line_dedup,
    mixing,
    pii,
    quality_model,
    quality_rules,
    simhash,
    suffix_dedup,
    token_files,
)

SCHEMA = "doc_id long, text string, lang string, id string, count int, kept string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu".split()


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice("abcdefgh") for _ in range(n)) + "."


@pytest.fixture(scope="module")
def rows():
    long = "\n".join(prose(s, 40) for s in range(100, 300))
    shared = prose(7, 20)
    texts = [
        (5, shared + "\n" + prose(1, 30)),
        (2, prose(2, 30) + "\n" + shared.upper() + " "),
        (3, None),
        (4, ""),
        (None, shared),
        (6, prose(3, 50)),
        (6, prose(3, 50)),
        (6, prose(4, 50) + "\n" + shared),
        (7, long),
        (8, long),
        (9, "é" * 60 + " ß\t\x0b \r\n  "),
        (10, "aaaa" * 40),
        (11, "b" + "aaaa" * 40),
    ]
    return [(i, t, "x", "clash", 1, "clash") for i, t in texts]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def order(i):
    return 2**63 - 1 if i is None else i


def test_suffix_dedup_is_brute_force(docs, rows):
    seen: dict[bytes, int] = {}
    for i, t, *_ in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            seen[b[p : p + 50]] = min(order(i), seen.get(b[p : p + 50], order(i)))
    expected = []
    for i, t, *_ in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen[b[p : p + 50]] < order(i):
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        expected.append((i, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), kept))
    for batches, slices in ((1, 1), (4, 3)):
        got = suffix_dedup.remove_repeats(docs, batches=batches, slices=slices).collect()
        assert sorted(map(repr, map(tuple, [(*r[:4], bytes(r.kept)) for r in got]))) == sorted(
            map(repr, expected)
        )


def brute_repeats(rows):
    seen: dict[bytes, int] = {}
    for i, t in rows:
        for p in range(len(t) - 49):
            seen[t[p : p + 50]] = min(i, seen.get(t[p : p + 50], i))
    for i, t in rows:
        gone = bytearray(len(t))
        for p in range(len(t) - 49):
            if seen[t[p : p + 50]] < i:
                gone[p : p + 50] = b"\1" * 50
        yield i, sum(gone), bytes(c for c, g in zip(t, gone, strict=True) if not g)


def test_suffix_dedup_of_what_a_document_repeats(spark):
    line = prose(8, 12)
    rows = [
        (10, "a" * 100),
        (11, "a" * 400),
        (20, prose(9, 30) + line + "\n" + prose(10, 30)),
        (21, "\n".join(f"{prose(s, 9)} {line[:-20]} {prose(5, 30)}" for s in (11, 12, 13))),
        (21, f"{prose(14, 9)} {line[:-20]} {prose(5, 30)}"),
        (30, "cd" * 40),
        (31, "x" + "cd" * 300 + "y" + "cd" * 300),
    ]
    want = sorted(brute_repeats([(i, t.encode()) for i, t in rows]))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for batches, slices in ((1, 1), (2, 2), (5, 2)):
        got = suffix_dedup.remove_repeats(df, batches=batches, slices=slices).collect()
        assert sorted((r.doc_id, r.n_removed, bytes(r.kept)) for r in got) == want


def test_line_dedup_is_brute_force(docs, rows):
    def key(line):
        line = line.strip(" \t\n\x0b\x0c\r")
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line)

    owner: dict[str, int] = {}
    for i, t, *_ in rows:
        for line in (t or "").split("\n"):
            owner[key(line)] = min(order(i), owner.get(key(line), order(i)))
    expected = []
    for i, t, *_ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == order(i)]
        expected.append((i, "\n".join(kept), "clash", len(lines), len(lines) - len(kept)))
    for batches, fanout in ((1, 2), (5, 2)):
        got = line_dedup.dedup_lines(docs, batches=batches, fanout=fanout)
        got = got.select("doc_id", "text", "id", "n_lines", "n_dropped").collect()
        assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, expected))


def test_simhash_is_brute_force(docs, rows):
    got = simhash.near_groups(docs).collect()
    prints = {(i, simhash._fingerprint(t or "", 3)) for i, t, *_ in rows}
    everything = sorted(prints, key=lambda x: order(x[0]))
    group = {fp: fp for _, fp in everything}

    def find(x):
        while group[x] != x:
            x = group[x]
        return x

    for _, a in everything:
        for _, b in everything:
            if ((a ^ b) & (2**64 - 1)).bit_count() <= 3:
                group[find(a)] = find(b)
    least = {}
    for i, fp in everything:
        least[find(fp)] = min(order(i), least.get(find(fp), order(i)))
    for r in got:
        assert order(r.component_id) == least[find(r.fp)]
    assert len(got) == len(rows)
    first = {r.doc_id for r in simhash.keep_first(docs).collect()}
    assert 8 not in first and 7 in first


def test_components_of_a_chain(spark):
    edges = spark.range(1, 60).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = graph.components(edges.union(edges.selectExpr("a", "cast(null as long)"))).collect()
    assert {r.node for r in got} == set(range(1, 61)) and {r.root for r in got} == {1}


def test_quality_rules(docs, spark):
    got = {r.text: r for r in quality_rules.judge(docs).collect()}
    assert got[None].base_failed and got[""].base_failed and not got[""].kept
    again = " ".join(["one two three four five"] * 2 + [prose(1, 20)])
    clean = "\n".join(prose(s, 12) for s in range(5))
    menu = "Home | News | About | Help"
    made = [(1, again), (2, clean + "\nSo be it.\n" + menu + "\nSo be it."), (3, "\n".join([menu] * 9))]
    r = {x.doc_id: x for x in quality_rules.judge(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert r[1].n_repeat_words == 10 and r[1].base_failed
    assert r[2].kept and r[2].clean_text == clean + "\nSo be it.\nSo be it."
    assert r[2].n_dup_lines == 1 and r[2].n_symbols == 3 and r[2].n_lines_removed == 1
    assert not r[3].kept


def test_bpe_is_the_library(docs, rows):
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(bpe.VOCABULARY), "rb") as file:
        pairs = [line.split() for line in file]
    ranks = {base64.b64decode(a): int(b) for a, b in pairs}
    own = tiktoken.Encoding(
        "own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
    )
    got = sorted((order(r.doc_id), list(r.ids), bytes(r.decoded)) for r in bpe.encode_decode(docs).collect())
    want = sorted((order(i), own.encode_ordinary(t or ""), (t or "").encode()) for i, t, *_ in rows)
    assert got == want


def test_bpe_long_word():
    import public_tokenizers
    import tiktoken

    one = bpe.DuckBpe(public_tokenizers.path(bpe.VOCABULARY), public_tokenizers.PATTERN)
    ranks = {bytes.fromhex(h): i for i, h in one.con.sql("select id, hex from vocab").fetchall()}
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    word = "".join(random.Random(1).choice("abcdefghij") for _ in range(1500))
    assert np.frombuffer(one.encode([word])[0], "<i4").tolist() == own.encode_ordinary(word)


def test_token_files(docs, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    start, want = 0, []
    for i, t, *_ in sorted(rows, key=lambda r: (order(r[0]), r[1] or "")):
        ids = [*own.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    manifest = token_files.write_tokens(docs, file_bytes=4000)
    back = token_files.read_tokens(manifest).withColumn("crc", F.crc32("ids")).drop("ids")
    assert sorted(map(tuple, back.collect()), key=lambda r: r[1]) == want
    some = token_files.read_tokens(manifest, [7, 10]).collect()
    assert sorted((r.doc_id, r.start) for r in some) == [w[:2] for w in want if w[0] in (7, 10)]


def test_token_file_with_a_wrong_byte_is_refused(docs):
    row = token_files.write_tokens(docs).first()
    with open(row.path.removeprefix("file:"), "r+b") as file:
        file.seek(10)
        byte = file.read(1)
        file.seek(10)
        file.write(bytes([byte[0] ^ 255]))
    with pytest.raises(Exception):
        list(token_files._frames(row.path, None))


def test_special_strings_and_odd_spaces_are_encoded_as_the_library_does():
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path(token_files.VOCABULARY))
    texts = ["a  b   c\n\n d \n e", "x<|endoftext|>y", "\xa0a\tb \x1c!", " \n ", "it's 12 o'clock ...", "ſ İ 语言"]
    packed = token_files.Tokens(None).encode(texts)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == [
        own.encode(t, add_special_tokens=False).ids for t in texts
    ]


def test_pii_base_and_terms(spark):
    base = "mail a.b@c.de or x@y.z_q@w.v, 10.0.0.256 10.0.0.1, 4111 1111 1111 1111, +1 (555) 123-4567 é+49 30 12345678"
    texts = [(1, base), (2, None), (3, ""), (4, "1.2.3.4.5.6.7.8 @ + 4111-1111-1111-1112")]
    filler = [(i, prose(i, 30)) for i in range(100, 160)]
    told = [(i, f"{prose(i, 10)} zanzibarian envoy boss@corp.example.com spoke {prose(i + 1, 5)}") for i in range(10, 16)]
    clean = [(20, "the envoy came " + prose(1, 9))]
    df = spark.createDataFrame(texts + filler + told + clean, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    values = [(s.kind, s.value) for s in got[1].base]
    assert values == [
        ("email", "a.b@c.de"),
        ("email", "x@y.z"),
        ("email", "_q@w.v"),
        ("ip", "10.0.0.1"),
        ("card", "4111 1111 1111 1111"),
        ("phone", "+1 (555) 123-4567"),
        ("phone", "+49 30 12345678"),
    ]
    assert all(base[s.start : s.end] == s.value for s in got[1].base)
    assert [s.value for s in got[4].base] == ["1.2.3.4", "5.6.7.8"] and not got[2].base and not got[3].base
    assert all("zanzibarian" in [s.value for s in got[i].terms] for i in range(10, 16))
    assert not got[20].terms
    out = pii.find_personal_data(df).where("doc_id = 10").select(
        pii.sanitised(F.col("text"), F.col("base"), F.col("terms"), F.col("removed")).alias("t")
    )
    assert "boss@corp" not in out.first().t and "zanzibarian" not in out.first().t


def test_pii_terms_anywhere_in_the_document(spark):
    far = " ".join("abcdefgh"[i % 8] * 5 for i in range(60))
    filler = [(i, far + " the room of " + prose(i, 30)) for i in range(100, 160)]
    told = [(i, f"zanzibar {far} the office of Boss@corp.example {far} zanzibar") for i in range(10, 16)]
    df = spark.createDataFrame(told + filler, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_personal_data(df).collect()}
    for i, text in told:
        places = {(s.start, s.end) for s in got[i].terms}
        assert {(0, 8), (len(text) - 8, len(text))} <= places
        assert not {"the", "of", "aaaaa", "boss", "corp"} & {s.value.lower() for s in got[i].terms}
        assert "zanzibar" in got[i].removed
    assert not any(got[i].terms for i, _ in filler)


def test_pii_terms_of_any_word_and_of_rare_entities(spark):
    filler = [(i, prose(i, 30)) for i in range(100, 160)]
    once = [(1, "Lee 4711 é\u0301x alphaa lee x9@y.de10 betab Lee")]
    twice = [(2, "Kim asks a@b.cd alphaa"), (3, "a@b.cd is betab of KIM")]
    copies = [(i, "Ana: +49 30 12345678 alphaa") for i in range(4, 9)]
    df = spark.createDataFrame(filler + once + twice + copies, "doc_id long, text string")
    got = {r.doc_id: [s.value for s in r.terms] for r in pii.find_personal_data(df).collect()}
    assert got[1] == ["Lee", "4711", "é\u0301x", "lee", "Lee"]
    assert got[2] == ["Kim", "asks"] and got[3] == ["is", "of", "KIM"]
    assert all(got[i] == ["Ana"] for i in range(4, 9))


def test_pii_is_python_re_on_random_text(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("0123456789.@+-( )ab_%") for _ in range(rng.randrange(80))) for _ in range(400)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in df.select("doc_id", pii.base_spans(F.col("text")).alias("spans")).collect()}
    email = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"
    ip = r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"
    phone = r"\+[0-9][\x20().0-9-]+[0-9]"
    for i, t in enumerate(texts):
        want = [("email", *m.span()) for m in re.finditer(email, t)]
        want += [("ip", *m.span()) for m in re.finditer(ip, t) if all(int(x) < 256 for x in m.group().split("."))]
        want += [("phone", *m.span()) for m in re.finditer(phone, t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        assert [(s.kind, s.start, s.end) for s in got[i] if s.kind != "card"] == want


def test_nearest(spark):
    rng = np.random.default_rng(3)
    vectors = rng.normal(size=(300, 10))
    vectors[200:260] = vectors[50]  # copies of a query
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(900, None), (950, [0.0] * 10), (1000, [float("nan")] * 10), (None, [1.0] * 10), (350, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.nearest(df, df.where("vec_id % 50 = 0"), vector_block=40, query_block=2).collect()
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    hit = total = 0
    for q in range(0, 300, 50):
        own = sorted((r.rank, r.vec_id, r.score) for r in got if r.query_id == q)
        assert [r[0] for r in own] == [1, 2, 3, 4, 5] and q not in [r[1] for r in own]
        near = unit @ unit[q]
        assert all(abs(near[v] - s) < 1e-12 for _, v, s in own)
        near[q] = -9
        hit += len({v for _, v, _ in own} & set(np.lexsort((np.arange(300), -near.round(12)))[:5].tolist()))
        total += 5
    assert hit / total >= 0.9
    assert [r[1] for r in sorted((r.rank, r.vec_id) for r in got if r.query_id == 50)] == [200, 201, 202, 203, 204]
    assert not {r.query_id for r in got} - set(range(0, 300, 50))


def test_quality_model(spark):
    good = [(i, prose(i, 30), 1) for i in range(150)]
    bad = [(i, " ".join(w + "&&&" for w in prose(i, 30).split()), 0) for i in range(150, 300)]
    df = spark.createDataFrame(good + bad + [(1000, None, None), (1001, "", 1)], "doc_id long, text string, quality int")
    got = {r.doc_id: r for r in quality_model.classify(df, df).collect()}
    held = [(i, q) for i, _, q in good + bad if got[i].held_out]
    assert held and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert sum(got[i].predicted == q for i, q in held) / len(held) > 0.9
    assert 0 <= got[1000].score <= 1 and got[1000].score == got[1001].score


def test_mixing(spark):
    langs = {"aa": ("red", 300), "bb": ("blue", 100), "cc": ("green", 50)}
    rng = random.Random(2)
    rows = [
        (len(langs) * i + k, " ".join(word + rng.choice("xyz") for _ in range(rng.randrange(5, 40))), lang)
        for k, (lang, (word, n)) in enumerate(langs.items())
        for i in range(n)
    ]
    rows += [(None, None, None), (9999, "", "aa")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labelled = df.where("doc_id % 2 = 0")
    got = mixing.mixing_rates(df, labelled, weights={"aa": 1, "bb": 2, "cc": 1}).collect()
    assert len(got) == len(rows) and all(r.rate >= 0 for r in got)
    totals = np.sum([np.array(r.p) * r.n_tokens * r.rate for r in got], axis=0)
    before = sum(r.n_tokens for r in got)
    assert np.allclose(totals / before, [0.25, 0.5, 0.25], atol=1e-3)
    taken = mixing.mix(df, labelled)
    assert taken.columns == df.columns
    counts = {r.lang: r["count"] for r in taken.groupBy("lang").count().collect()}
    assert counts["cc"] > 50 and counts["aa"] < 300


def test_empty_tables(nothing, spark):
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>")
    labels = spark.createDataFrame([], "doc_id long, quality int")
    for df in (
        suffix_dedup.remove_repeats(nothing),
        line_dedup.dedup_lines(nothing),
        simhash.near_groups(nothing),
        quality_rules.judge(nothing),
        bpe.encode_decode(nothing),
        token_files.read_tokens(token_files.write_tokens(nothing)),
        pii.find_personal_data(nothing),
        ann.nearest(vectors, vectors),
        quality_model.classify(nothing, labels),
        mixing.mixing_rates(nothing, labels),
    ):
        assert df.count() == 0


def test_pipeline_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = corpus_pipeline.run(spark, sf_dir).toPandas()
    first = corpus_pipeline.quality_rules(spark, docs, sf_dir)
    assert first.columns == docs.columns
    rejected = {r.doc_id for r in quality_rules.judge(docs).where("not kept").collect()}
    assert not rejected & set(out.doc_id) and 0 < len(out)
    kept = {r.doc_id: r.text for r in first.collect()}
    assert {hashlib.sha256(kept[i].encode()).hexdigest() for i in list(kept)[:1]}
    assert set(out.doc_id) <= set(kept) and (out.n_tokens == out.ids.map(len)).all()
