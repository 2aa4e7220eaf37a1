"""Prefix trie of conversations: ternary search trees over turn ids, one for each range of sequences.

1. Turns become ids: a dictionary of the distinct (role, text) digests numbers them. Texts are hashed where
   they are read and go no further; a turn that very many conversations share is a salted key.
2. Equal sequences become one path with a count, a least member and a digest of its members. Members are
   joined into strings by ranges, so a conversation with very many copies is hashed block by block.
3. Paths are cut into ranges. Each range builds a ternary search tree, the middle path of every stretch
   first, and walks it without recursion: parents before children, then back for members, leaves and savings.
4. Only prefixes of a range's first and last path can go on in other ranges. These boundary nodes are merged
   by groups of FANOUT neighbouring ranges, then groups of groups, until the root is closed.

A task holds the turn ids of SHARD_TURNS turns, or of one conversation where that is longer (about 200 bytes a
turn); a boundary merge holds at most 2 x FANOUT paths.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitflow.llm.common import text_of, words_of
from unitflow.operators.joins import join_copies
from unitflow.session import discard, materialise

SHARD_TURNS = 250_000
FANOUT = 32
BLOCK_IDS = 4096  # member ids joined into one string
OUT_ROWS = 8192

_NODE = pa.schema(
    [
        ("step", pa.int32()),  # 0: a range, n: the n-th boundary merge
        ("shard", pa.int64()),
        ("key", pa.binary()),  # digest of the path, of boundary nodes
        ("parent_key", pa.binary()),  # of nodes under a boundary node
        ("depth", pa.int64()),
        ("conv_id", pa.int64()),
        ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()),
        ("n_children", pa.int64()),
        ("n_leaves", pa.int64()),
        ("saved_tokens", pa.int64()),
        ("words", pa.int64()),
        ("ends", pa.string()),
        ("first", pa.bool_()),
        ("last", pa.bool_()),
        ("open", pa.bool_()),
    ]
)
_NODE_DDL = (
    "step int, shard long, key binary, parent_key binary, depth long, conv_id long, parent_conv_id long, "
    "n_convs long, n_children long, n_leaves long, saved_tokens long, words long, ends string, "
    "first boolean, last boolean, open boolean"
)


# --- sequences ----------------------------------------------------------------------------------


def turn_digest(role: Column, text: Column) -> Column:
    """SHA-256 that tells all (role, text) pairs apart."""
    pair = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    return F.unhex(F.sha2(pair, 256))


def sequences(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as (id, words) of the dictionary.

    Order is by ``turn``, null first; rows of one turn number go by their digest. A null role or text is
    empty. Rows without a ``conv_id`` belong to no conversation and take no part. Other columns are not
    looked at. Ids are numbers without meaning; they differ from run to run.
    """
    role, text = text_of("role"), text_of("text")
    rows = materialise(
        conversations.where(F.col("conv_id").isNotNull()).select(
            F.col("conv_id").cast("long").alias("conv_id"),
            F.col("turn").cast("long").alias("turn"),
            turn_digest(role, text).alias("digest"),
            F.size(words_of(text)).alias("words"),
        ),
        "turn-digests",
    )
    # numbered as it is written: whatever is read later has the numbers of that one file
    numbered = rows.groupBy("digest").agg(F.count("*").alias("_copies"))
    dictionary = materialise(
        numbered.withColumn("id", F.monotonically_increasing_id()), "turn-dictionary"
    )
    coded = join_copies(rows, dictionary, ["digest"])
    order = [F.col("turn").isNotNull(), F.coalesce("turn", F.lit(0)), "digest"]
    in_order = F.sort_array(F.collect_list(F.struct(*order, "id", "words")))
    whole = coded.groupBy("conv_id").agg(in_order.alias("turns"))
    picked = F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words")))
    out = materialise(whole.select("conv_id", picked.alias("turns")), "turn-sequences")
    discard(rows, dictionary)
    return out


def spliced(paths: DataFrame, every: int = 20, heads: int = 4) -> DataFrame:
    """Sequences that share beginnings: the first h turns come from the conversation c - c % ``every``.

    h is crc32 of the decimal id, modulo ``heads``; the conversation's own turns after its first h follow.
    """
    c = F.col("conv_id")
    h = (F.crc32(c.cast("string").cast("binary")) % heads).cast("int")
    donors = paths.where(c % every == 0).select(
        c.alias("_donor"), F.slice("turns", 1, heads - 1).alias("_head")
    )
    met = paths.join(donors, c - c % every == F.col("_donor"), "left")
    own = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    head = F.slice(F.coalesce("_head", F.filter("turns", lambda t: F.lit(False))), F.lit(1), h)
    return met.select("conv_id", F.concat(head, own).alias("turns"))


# --- members of a path --------------------------------------------------------------------------


def _member_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, first, block): ascending ids of one path joined by commas, at most BLOCK_IDS a row."""
    key, run, done = None, [], []

    def cut() -> None:
        if run:
            done.append((key, run[0], ",".join(map(str, run))))

    def rows() -> pa.RecordBatch:
        columns = [pa.array(c, t) for c, t in zip(zip(*done), (pa.binary(), pa.int64(), pa.string()))]
        done.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "first", "block"])

    for batch in batches:
        for own, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist()):
            if own != key or len(run) >= BLOCK_IDS:
                cut()
                key, run = own, []
            run.append(conv)
        if len(done) >= OUT_ROWS:
            yield rows()
    cut()
    if done:
        yield rows()


def _member_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, ends) from blocks in order; a path's blocks are hashed as they pass."""
    key, sha, keys, ends = None, None, [], []

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(ends)], ["key", "ends"])
        keys.clear()
        ends.clear()
        return out

    for batch in batches:
        for own, block in zip(batch.column("key").to_pylist(), batch.column("block").to_pylist()):
            if own != key:
                if sha is not None:
                    keys.append(key)
                    ends.append(sha.hexdigest())
                key, sha = own, hashlib.sha256(block.encode())
            else:
                sha.update(b"," + block.encode())
        if len(keys) >= OUT_ROWS:
            yield rows()
    if sha is not None:
        keys.append(key)
        ends.append(sha.hexdigest())
    if keys:
        yield rows()


def _paths(members: DataFrame) -> DataFrame:
    """(turns, n, least, ends): each distinct sequence once, with what its members tell."""
    ids = F.array_join(F.transform("turns", lambda t: t["id"].cast("string")), ",")
    keyed = materialise(members.withColumn("key", F.unhex(F.sha2(ids, 256))), "trie-members")
    paths = keyed.groupBy("key", "turns").agg(F.count("*").alias("n"), F.min("conv_id").alias("least"))
    order = ["key", "conv_id"]
    ranged = keyed.select(*order).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = ranged.mapInArrow(_member_blocks, "key binary, first long, block string")
    together = blocks.repartition("key").sortWithinPartitions("key", "first")
    ends = together.mapInArrow(_member_digests, "key binary, ends string")
    out = materialise(paths.join(ends, "key").drop("key"), "trie-paths")
    discard(keyed)
    return out


# --- one range ----------------------------------------------------------------------------------


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of every stretch before its two halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


class TernaryTree:
    """Turn sequences. The children of a node are a binary tree by turn id; node 0 is the root, 0 also none."""

    def __init__(self):
        self.turn, self.words = [0], [0]
        self.low, self.equal, self.high = [0], [0], [0]
        self.end: dict[int, tuple] = {}

    def _new(self, turn: int, words: int) -> int:
        self.turn.append(turn)
        self.words.append(words)
        for side in (self.low, self.equal, self.high):
            side.append(0)
        return len(self.turn) - 1

    def insert(self, turns: Sequence[int], words: Sequence[int], end: tuple) -> None:
        at = 0
        for turn, n in zip(turns, words, strict=True):
            link, node = self.equal, at
            while link[node]:
                node = link[node]
                own = self.turn[node]
                if turn == own:
                    break
                link = self.low if turn < own else self.high
            else:
                link[node] = node = self._new(turn, n)
            at = node
        self.end[at] = end

    def walk(self) -> Iterator[tuple[int, int, int]]:
        """(node, its parent's place in this walk, depth): parents first, siblings by ascending turn."""
        place = 0
        todo = [(0, -1, 0, True)]
        while todo:
            node, parent, depth, visit = todo.pop()
            if not visit:
                if self.high[node]:
                    todo.append((self.high[node], parent, depth, False))
                todo.append((node, parent, depth, True))
                if self.low[node]:
                    todo.append((self.low[node], parent, depth, False))
                continue
            yield node, parent, depth
            if self.equal[node]:
                todo.append((self.equal[node], place, depth + 1, False))
            place += 1


class _Nodes:
    """Trie nodes as columns, parents before children; ``settle`` closes what no other range can add to."""

    def __init__(self):
        self.parent, self.depth, self.n, self.least, self.words = [], [], [], [], []
        self.ends, self.key, self.first, self.last = [], [], [], []
        self.kids, self.leaves, self.saved = [], [], []

    def add(self, parent, depth, n, least, words, ends, key=None, kids=0, leaves=0, saved=0) -> int:
        for column, value in (
            (self.parent, parent), (self.depth, depth), (self.n, n), (self.least, least),
            (self.words, words), (self.ends, ends), (self.key, key), (self.first, False),
            (self.last, False), (self.kids, kids), (self.leaves, leaves), (self.saved, saved),
        ):
            column.append(value)
        return len(self.n) - 1

    def count_members(self) -> None:
        for p in range(len(self.n) - 1, 0, -1):
            q = self.parent[p]
            self.n[q] += self.n[p]
            self.least[q] = min(self.least[q], self.least[p])

    def settle(self) -> None:
        """Give every closed node its sums and add them to its parent; open ones keep their closed children's."""
        for p in range(len(self.n) - 1, -1, -1):
            if self.is_open(p):
                continue
            self.leaves[p] = self.leaves[p] if self.kids[p] else 1
            self.saved[p] += (self.n[p] - 1) * self.words[p]
            q = self.parent[p]
            if q >= 0:
                self.kids[q] += 1
                self.leaves[q] += self.leaves[p]
                self.saved[q] += self.saved[p]

    def is_open(self, p: int) -> bool:
        return self.first[p] or self.last[p]

    def rows(self, step: int, shard: int) -> Iterator[pa.RecordBatch]:
        for low in range(0, len(self.n), OUT_ROWS):
            places = range(low, min(low + OUT_ROWS, len(self.n)))
            above = [self.parent[p] for p in places]
            # the parent's own least member is known where the parent is closed too
            waits = [q >= 0 and self.is_open(q) for q in above]
            given = {
                "step": [step] * len(places),
                "shard": [shard] * len(places),
                "key": [self.key[p] for p in places],
                "parent_key": [self.key[q] if w else None for q, w in zip(above, waits)],
                "parent_conv_id": [
                    None if w or q < 0 else self.least[q] for q, w in zip(above, waits)
                ],
                "open": [self.is_open(p) for p in places],
            }
            own = {
                "depth": self.depth, "conv_id": self.least, "n_convs": self.n, "words": self.words,
                "n_children": self.kids, "n_leaves": self.leaves, "saved_tokens": self.saved,
                "ends": self.ends, "first": self.first, "last": self.last,
            }
            given |= {name: column[low : places.stop] for name, column in own.items()}
            yield pa.RecordBatch.from_arrays(
                [pa.array(given[f.name], f.type) for f in _NODE], schema=_NODE
            )


def _mark_path(nodes: _Nodes, path: list[int], turns: Sequence[int], flags: list[bool]) -> None:
    """Keys of the nodes of a path, each a digest of all turns up to it."""
    digest = hashlib.sha256(b"")
    for p, turn in zip(path, [None, *turns], strict=True):
        if turn is not None:
            digest.update(b"%d," % turn)
        nodes.key[p], flags[p] = digest.digest(), True


def _range_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The trie nodes of one range of paths, given in ascending order."""
    turns, words, ends = [], [], []
    for batch in batches:
        column = batch.column("turns")
        flat = column.flatten()
        ids, counts = (flat.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        at = 0
        for n in column.value_lengths().to_pylist():
            turns.append(ids[at : at + n])
            words.append(counts[at : at + n])
            at += n
        ends += zip(*(batch.column(c).to_pylist() for c in ("n", "least", "ends")))
    if not turns:
        return
    tree = TernaryTree()
    for i in medians(len(turns)):
        tree.insert(turns[i].tolist(), words[i].tolist(), ends[i])
    nodes, place = _Nodes(), {}
    for node, parent, depth in tree.walk():
        n, least, digest = tree.end.get(node, (0, 2**63 - 1, None))
        place[depth] = nodes.add(parent, depth, n, least, tree.words[node], digest)
    nodes.count_members()
    # parents first, siblings ascending: the first path comes first, the last one has the last of every depth
    first, last = turns[0].tolist(), turns[-1].tolist()
    _mark_path(nodes, list(range(len(first) + 1)), first, nodes.first)
    _mark_path(nodes, [place[d] for d in range(len(last) + 1)], last, nodes.last)
    nodes.settle()
    yield from nodes.rows(0, TaskContext.get().partitionId())


# --- boundary merges ----------------------------------------------------------------------------


def _merge(step: int, closing: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: (r["depth"], r["key"]))
        low, high = (f(r["shard"] for r in rows) for f in (min, max))
        nodes, place = _Nodes(), {}
        for r in rows:
            p = place.get(r["key"])
            if p is None:
                parent = -1 if r["depth"] == 0 else place[r["parent_key"]]
                p = place[r["key"]] = nodes.add(
                    parent, r["depth"], 0, r["conv_id"], r["words"], None, r["key"]
                )
            nodes.n[p] += r["n_convs"]
            nodes.least[p] = min(nodes.least[p], r["conv_id"])
            nodes.ends[p] = nodes.ends[p] or r["ends"]
            nodes.kids[p] += r["n_children"]
            nodes.leaves[p] += r["n_leaves"]
            nodes.saved[p] += r["saved_tokens"]
            if not closing:
                nodes.first[p] |= r["first"] and r["shard"] == low
                nodes.last[p] |= r["last"] and r["shard"] == high
        nodes.settle()
        return pa.Table.from_batches(list(nodes.rows(step, key[0].as_py())), _NODE)

    return run


def prefix_trie(
    paths: DataFrame, shard_turns: int = SHARD_TURNS, fanout: int = FANOUT
) -> DataFrame:
    """The nodes of the trie of (conv_id, turns) sequences, one row each, as a written table.

    conv_id         the smallest member: id of the conversations that start with the node's turns
    depth           turns from the root (0, without a text); (conv_id, depth) names a node
    parent_conv_id  the parent's ``conv_id``; null at the root
    n_convs         members; a conversation without turns is a member of the root alone
    n_children      child nodes; n_leaves: childless nodes under it, itself included
    saved_tokens    over the node and all below it: (n_convs - 1) x words of the node's last turn
    ends_sha256     SHA-256 of the ids of the members that end here, ascending, joined by commas

    ``conv_id`` is taken as unique. An empty table has no nodes, not even a root.
    """
    paths = _paths(paths)
    total = paths.agg(F.sum(F.size("turns") + 1)).first()[0] or 0
    shards = max(1, -(-total // shard_turns))
    ranged = paths.repartitionByRange(shards, "turns").sortWithinPartitions("turns")
    tables = [materialise(ranged.mapInArrow(_range_nodes, _NODE_DDL), "trie-ranges", "open")]
    top = tables[0].where("open").agg(F.max("shard")).first()[0]
    while top is not None:
        top //= fanout
        step = len(tables)
        grouped = tables[-1].where("open").withColumn("_group", F.floor(F.col("shard") / fanout))
        merged = grouped.groupBy("_group").applyInArrow(_merge(step, top == 0), _NODE_DDL)
        tables.append(materialise(merged, "trie-merge", "open"))
        if top == 0:
            break
    out = materialise(_with_parents(tables), "trie")
    discard(paths, *tables)
    return out


def _with_parents(tables: list[DataFrame]) -> DataFrame:
    """Closed nodes of all steps; those under a boundary node get its least member by an equi-join.

    The join key names the range as well, so that the children of a node that all ranges share are no hot key.
    """
    everything = tables[0]
    for table in tables[1:]:
        everything = everything.unionByName(table)
    closed = everything.where("NOT open")
    known = closed.where("key IS NOT NULL").select("key", F.col("conv_id").alias("_above"))
    asked = everything.where("open").select("step", "shard", "key")
    above = asked.join(known, "key").withColumnRenamed("key", "parent_key")
    under = closed.where("parent_key IS NOT NULL").join(above, ["step", "shard", "parent_key"])
    rest = closed.where("parent_key IS NULL").withColumn("_above", F.col("parent_conv_id"))
    nothing = hashlib.sha256(b"").hexdigest()
    return rest.unionByName(under).select(
        "conv_id",
        "depth",
        F.col("_above").alias("parent_conv_id"),
        "n_convs",
        "n_children",
        "n_leaves",
        "saved_tokens",
        F.coalesce("ends", F.lit(nothing)).alias("ends_sha256"),
    )
