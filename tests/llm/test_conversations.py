"""Prefix trie and role repair of conversations, against plain Python."""

from __future__ import annotations

import hashlib
import heapq
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from unitflow.llm import prefix_trie, role_repair
from unitflow.session import materialise

SCHEMA = "conv_id long, turn long, role string, text string, n_convs int, gone_by string"
SPACE = " \t\n\x0b\x0c\r"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], SCHEMA).repartition(4)


def records(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# --- trie ---------------------------------------------------------------------------------------


def brute_trie(rows, splice=True):
    given: dict[int, list] = {}
    for c, t, r, x in rows:
        if c is not None:
            r, x = r or "", x or ""
            key = hashlib.sha256(f"{len(r.encode())}:{r}{x}".encode()).digest()
            given.setdefault(c, []).append((t is not None, t or 0, key, r, x))
    given = {c: [v[3:] for v in sorted(vs)] for c, vs in given.items()}
    members: dict[tuple, list] = {}
    ends: dict[tuple, list] = {}
    for c, own in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        path = given.get(c - int(math.fmod(c, 20)), [])[:h] + own[h:] if splice else own
        ends.setdefault(tuple(path), []).append(c)
        for d in range(len(path) + 1):
            members.setdefault(tuple(path[:d]), []).append(c)
    kids: dict[tuple, list] = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        leaves = 0 if p in kids else 1
        words = len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        saved = (len(members[p]) - 1) * words
        for q in kids.get(p, []):
            more = below(q)
            leaves, saved = leaves + more[0], saved + more[1]
        return leaves, saved

    return sorted(
        (
            (
                min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])),
                *below(p), sha(",".join(map(str, sorted(ends.get(p, []))))),
            )
            for p, m in members.items()
        ),
        key=repr,
    )


@pytest.fixture(scope="module")
def talks():
    rng = random.Random(5)
    rows = []
    for c in [*range(60), *range(61, 200), -3, -20, 1000, 2**40]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 4, 8])):
            role, text = rng.choice(["user", "assistant", None, ""]), rng.choice(["a b", "c", None, "d  e\tf"])
            rows.append((c, t if rng.random() < 0.95 else None, role, text))
    # repeated rows, equal conversations, a long one, no conversation at all
    rows += [(5, 1, "user", "same")] * 3 + [(None, 1, "user", "x")] * 5
    rows += [(c, t, "user", "hot") for c in range(300, 420) for t in range(3)]
    return rows + [(7, 100 + t, "user", f"{t % 3}") for t in range(300)] + [(9, 0, "user", "y " * 30_000)]


def test_trie_is_brute_force(spark, talks):
    want = brute_trie(talks)
    paths = prefix_trie.spliced(prefix_trie.sequences(table(spark, talks)))
    # one range, a few with several merge rounds, and ranges of a path or two
    for shard_turns, fanout in ((250_000, 32), (60, 2), (3, 4)):
        assert records(prefix_trie.prefix_trie(paths, shard_turns, fanout), "*") == want


def test_trie_without_shared_beginnings(spark):
    rows = [(1, 0, "u", "a"), (1, 1, "u", "b"), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 1, "u", "b c"), (4, 0, "v", "a")]
    got = records(prefix_trie.prefix_trie(prefix_trie.sequences(table(spark, rows)), 2, 2), "*")
    assert got == brute_trie(rows, splice=False)
    assert (1, 0, None, 4, 2, 3, 2, sha("")) in got


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(prefix_trie.sequences(table(spark, [(1, 0, "u", "a")]).limit(0))).count() == 0


def test_members_are_hashed_in_blocks(spark, monkeypatch):
    rows = [(c, 0, "user", "hello") for c in range(1, 11_000)]
    root, node = records(prefix_trie.prefix_trie(prefix_trie.sequences(table(spark, rows))), "*")
    assert node[-1] == sha(",".join(map(str, range(1, 11_000)))) and root[-1] == sha("")


def test_tree_inserts_medians_first():
    assert sorted(prefix_trie.medians(10)) == list(range(10)) and next(prefix_trie.medians(9)) == 4
    tree = prefix_trie.TernaryTree()
    for i in prefix_trie.medians(1023):
        tree.insert([i], [1], (1, i, None))

    def height(node):
        return 0 if not node else 1 + max(height(tree.low[node]), height(tree.high[node]))

    assert height(tree.equal[0]) == 10
    assert [tree.turn[n] for n, _, d in tree.walk() if d] == list(range(1023))


# --- repair -------------------------------------------------------------------------------------

COLUMNS = "conv_id gaps blank duplicate truncated illegal cost audit repaired_sha256".split()


def damage(rows):
    for c, t, r, x in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if code == 1 else re.sub("[.!?]", "", x) if code == 2 else x
        yield from [(c, t, "user" if code == 4 else r, x, code == 0)] * (2 if code == 3 else 1)


def brute_repair(rows):
    """Cheapest first through all (row, state) places, by (cost, audit)."""
    talks: dict = {}
    for c, t, r, x, gone in rows:
        talks.setdefault(c, []).extend([] if gone else [(t, r, x)])
    step = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
    names = {"u": "user", "a": "assistant"}
    for c, own in talks.items():
        own.sort(key=lambda v: (v[0] is not None, v[0] or 0, v[1], v[2]))
        turns = [t for t, *_ in own if t is not None]
        seen, faults = set(), []
        for _, r, x in own:
            body = x.rstrip(SPACE)
            faults.append("b" if not body else "d" if (r, x) in seen else "t" if body[-1] not in ".!?" else "")
            seen.add((r, x))
        heap, done = [(0, "", 0, 0, ())], set()
        while True:
            cost, audit, i, state, out = heapq.heappop(heap)
            if (i, state) in done:
                continue
            done.add((i, state))
            if i == len(own) and state in (0, 3):
                break
            ways = [(5, "I", s, i, f"{names[s]}:") for s in names]
            if i < len(own):
                _, r, x = own[i]
                heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, out))
                if faults[i] in ("", "t"):
                    more = 5 if faults[i] else 0
                    ways += [(more, "K", r[:1], i + 1, f"{r}:{x}")]
                    ways += [(more + 1, "R", s, i + 1, f"{n}:{x}") for s, n in names.items()]
            for more, edit, s, at, row in ways:
                if (state, s) in step:
                    heapq.heappush(heap, (cost + more, audit + edit, at, step[state, s], (*out, row)))
        yield (
            c,
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *(faults.count(f) for f in "bdt"),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
            cost,
            audit,
            sha("\n".join(out)),
        )


@pytest.fixture(scope="module")
def chats():
    rng = random.Random(3)
    roles = ["user", "assistant", "user", "assistant", "system", None, "", "tool", "unknown"]
    texts = ["a b.", "c!", "d", "e? ", " \t", None, "f. g", "h.\n", "", "é.", "x　"]
    rows = []
    for c in [*range(300), None, -7]:
        for t in range(rng.choice([0, 1, 1, 2, 3, 5, 9])):
            turn = t * rng.choice([1, 1, 1, 2]) if rng.random() < 0.9 else None
            rows.append((c, turn, rng.choice(roles), rng.choice(texts)))
    rows += [(2**50, t, rng.choice(roles[:5]), f"{rng.choice('abc')}{t}.") for t in range(400)]
    return rows + [(8, 50, "user", "long " * 50_000 + ".")]


def test_repair_is_the_cheapest_of_all(spark, chats):
    damaged = role_repair.damaged(table(spark, chats))
    assert records(damaged, "conv_id", "turn", "role", "text", "gone") == sorted(damage(chats), key=repr)
    got = records(role_repair.repair(damaged), *COLUMNS)
    assert got == sorted(brute_repair(damage(chats)), key=repr)
    assert len(got) == len({c for c, *_ in chats})


def test_repair_of_rows_as_they_are(spark):
    rows = [(1, 0, "system", "s."), (1, 1, "user", "q?"), (1, 2, "assistant", "a."), (2, None, None, None)]
    rows += [(3, 0, "assistant", "a."), (3, 5, "user", "q?"), (4, 0, "user", "q?"), (4, 1, "user", "q?")]
    got = {r.conv_id: r for r in role_repair.repair(table(spark, rows)).collect()}
    assert (got[1].cost, got[1].audit, got[1].symbols) == (0, "KKK", "sua")
    assert got[1].repaired_sha256 == sha("system:s.\nuser:q?\nassistant:a.")
    assert (got[2].blank, got[2].cost, got[2].audit, got[2].gaps) == (1, 2, "D", 0)
    assert (got[3].audit, got[3].cost, got[3].gaps, got[3].illegal) == ("RR", 2, 4, 0)
    assert (got[4].duplicate, got[4].audit, got[4].cost, got[4].illegal) == (1, "DD", 4, 1)
    assert role_repair.repair(table(spark, rows).limit(0)).count() == 0


def test_repaired_turns_are_what_was_hashed(spark, chats):
    damaged = materialise(role_repair.damaged(table(spark, chats)))
    repairs = materialise(role_repair.repair(damaged))
    turns = role_repair.repaired_turns(damaged, repairs)
    rows = F.array_sort(F.collect_list(F.struct("pos", "role", "text")))
    joined = F.array_join(F.transform(rows, lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    whole = {r.conv_id: r.h for r in turns.groupBy("conv_id").agg(F.sha2(joined, 256).alias("h")).collect()}
    for r in repairs.collect():
        assert whole.get(r.conv_id, sha("")) == r.repaired_sha256
    assert turns.where("edit = 'I' and (turn is not null or text != '')").count() == 0


def test_parser_table_is_the_grammar():
    """All role strings of up to seven rows: kept at no cost where the grammar has them."""
    import itertools

    for n in range(7):
        for roles in itertools.product("sua", repeat=n):
            repair = role_repair.Repair()
            for i, r in enumerate(roles):
                repair.add(i, {"s": "system", "u": "user", "a": "assistant"}[r], f"{i}.")
            legal = re.fullmatch("(s?(ua)+)?", "".join(roles)) is not None
            assert (repair.result()["cost"] == 0) == legal


def test_audits_are_compared_as_strings():
    def trail(text, before=None):
        for c in text:
            before = role_repair._Trail(c, "-", before)
        return before

    base = trail("KDR")
    ways = ["", "D", "K", "KI", "DK", "DI", "R", "RD"]
    for a in ways:
        for b in ways:
            for start in (None, base):
                x, y = trail(a, start), trail(b, start)
                assert role_repair._smaller(x, y) == (a < b)
