"""Conversation repair by a generalised LR parser with a graph-structured stack.

The roles of a conversation have to spell ``(s?(ua)+)?``. Rows are the parser's input; beside shifting a row as
it is, the parser may delete it, give it another role or insert an empty turn, each at a cost. All ways are
followed at once: the frontier holds one stack top for each parser state, and where two ways reach one state the
top with the smaller (cost, audit) stays, with its link to the stack below. Merging is exact: tops of one state accept the
same continuations, and of two audits of one cost and place none is a prefix of the other, as an insertion is
never free.

Spark sorts the rows of each conversation; a task streams them and holds, for each top, the links of its audit
(about 100 bytes a row of the conversation) and the running hash of its output, never the texts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from unitflow.llm.common import SPACE

#: Costs, and the faults' marks.
RETYPE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
LEGAL = {"su", "ua", "au"}
ENDINGS = ".!?"

#: The parser's table for D -> (nothing) | T | s T and T -> u a | T u a; state 0 is the start.
SHIFT = {
    (0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (4, "u"): 5, (6, "u"): 5, (5, "a"): 7,
}
REDUCE = {3: 2, 7: 3}  # T -> u a and T -> T u a, by the number of symbols that go
GOTO = {0: 4, 1: 6}  # after a T on the state below
ACCEPT = {0, 4, 6}

OUT_ROWS = 1024

_OUT = pa.schema(
    [
        ("conv_id", pa.int64()),
        *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()),
        ("symbols", pa.string()),
        ("repaired_sha256", pa.string()),
    ]
)
_OUT_DDL = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
    "audit string, symbols string, repaired_sha256 string"
)


class _Trail:
    """The edits of one way, last one first; ways share what they have in common."""

    __slots__ = ("edit", "symbol", "before", "size")

    def __init__(self, edit: str, symbol: str, before: _Trail | None):
        self.edit, self.symbol, self.before = edit, symbol, before
        self.size = 1 if before is None else before.size + 1


def _smaller(a: _Trail | None, b: _Trail | None) -> bool:
    """Whether the audit of ``a`` is less than that of ``b``, in ASCII order."""
    longer = (a.size if a else 0) - (b.size if b else 0)
    for _ in range(longer):
        a = a.before
    for _ in range(-longer):
        b = b.before
    # walked backwards: the last difference that is met is the first one of the audits
    less = longer < 0
    while a is not b:
        if a.edit != b.edit:
            less = a.edit < b.edit
        a, b = a.before, b.before
    return less


class _Top:
    """A stack top: parser state, the stack below, and the way that led here."""

    __slots__ = ("state", "below", "cost", "trail", "output", "sha", "source")

    def __init__(self, state, below, cost, trail, source=None, output=None):
        self.state, self.below, self.cost, self.trail = state, below, cost, trail
        self.source, self.output, self.sha = source, output, None

    def digest(self):
        """The running hash of the repaired rows, or None before the first; made when it is asked for."""
        if self.source is not None:
            before, self.source = self.source.digest(), None
            if self.output is None:
                self.sha = before
            elif before is None:
                self.sha = hashlib.sha256(self.output.encode())
            else:
                self.sha = before.copy()
                self.sha.update(b"\n" + self.output.encode())
            self.output = None
        return self.sha


def _shift(top: _Top, symbol: str, edit: str, cost: int, output: str) -> _Top | None:
    """The top after a symbol and the reductions that follow it; None where the grammar has no such turn."""
    state = SHIFT.get((top.state, symbol))
    if state is None:
        return None
    below = (top.state, top.below)
    if state in REDUCE:
        for _ in range(REDUCE[state] - 1):
            state, below = below
        # ``state`` is now the last symbol of the right side, what lies below it stays
        state, below = GOTO[below[0]], below
    return _Top(state, below, top.cost + cost, _Trail(edit, symbol, top.trail), top, output)


def _offer(frontier: dict[int, _Top], top: _Top | None) -> bool:
    """Put a top on the frontier; of two tops of one state the better one stays."""
    if top is None:
        return False
    held = frontier.get(top.state)
    if held is not None and (
        held.cost < top.cost or (held.cost == top.cost and not _smaller(top.trail, held.trail))
    ):
        return False
    frontier[top.state] = top
    return True


def _insertions(frontier: dict[int, _Top]) -> None:
    """All tops that insertions reach; they cost, so this ends."""
    todo = list(frontier.values())
    while todo:
        top = todo.pop()
        if frontier.get(top.state) is not top:
            continue
        for symbol, role in ROLES.items():
            new = _shift(top, symbol, "I", INSERT, f"{role}:")
            if _offer(frontier, new):
                todo.append(new)


class Repair:
    """One conversation, row by row in order; ``result`` gives its faults and its cheapest repair."""

    def __init__(self):
        self.tops = {0: _Top(0, None, 0, None)}
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.last_initial = None
        self.seen: set[bytes] = set()

    def add(self, turn: int | None, role: str, text: str) -> None:
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high, self.turns = turn, self.turns + 1
        if self.last_initial is not None and self.last_initial + role[:1] not in LEGAL:
            self.illegal += 1
        self.last_initial = role[:1]
        fault = self._fault(role, text)
        extra = TRUNCATED if fault == "truncated" else 0
        _insertions(self.tops)
        after: dict[int, _Top] = {}
        for top in self.tops.values():
            _offer(after, _Top(top.state, top.below, top.cost + DELETE, _Trail("D", "-", top.trail), top))
            if fault in ("blank", "duplicate"):
                continue
            if role:
                _offer(after, _shift(top, role[0], "K", extra, f"{role}:{text}"))
            for symbol, other in ROLES.items():
                _offer(after, _shift(top, symbol, "R", RETYPE + extra, f"{other}:{text}"))
        for top in after.values():
            top.digest()  # now, so that no text is held longer than its row
        self.tops = after

    def _fault(self, role: str, text: str) -> str | None:
        body = text.rstrip(SPACE)
        key = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
        known = key in self.seen
        self.seen.add(key)
        if not body:
            self.blank += 1
            return "blank"
        if known:
            self.duplicate += 1
            return "duplicate"
        if body[-1] not in ENDINGS:
            self.truncated += 1
            return "truncated"
        return None

    def result(self) -> dict:
        _insertions(self.tops)
        ends: dict[int, _Top] = {}
        for top in self.tops.values():
            if top.state in ACCEPT:
                _offer(ends, _Top(0, None, top.cost, top.trail, top))
        best = ends[0]
        edits, symbols, trail = [], [], best.trail
        while trail is not None:
            edits.append(trail.edit)
            symbols.append(trail.symbol)
            trail = trail.before
        sha = best.digest() or hashlib.sha256()
        return {
            "gaps": 0 if self.low is None else self.high - self.low + 1 - self.turns,
            "blank": self.blank,
            "duplicate": self.duplicate,
            "truncated": self.truncated,
            "illegal": self.illegal,
            "cost": best.cost,
            "audit": "".join(reversed(edits)),
            "symbols": "".join(reversed(symbols)),
            "repaired_sha256": sha.hexdigest(),
        }


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation, from rows that are sorted by conversation and place."""
    nothing = object()
    conv, open_, done = nothing, None, []

    def out() -> pa.RecordBatch:
        arrays = [pa.array([r[f.name] for r in done], f.type) for f in _OUT]
        done.clear()
        return pa.RecordBatch.from_arrays(arrays, schema=_OUT)

    for batch in batches:
        columns = (batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "gone"))
        for own, turn, role, text, gone in zip(*columns, strict=True):
            if own != conv or conv is nothing:
                if open_ is not None:
                    done.append({"conv_id": conv} | open_.result())
                conv, open_ = own, Repair()
            if not gone:
                open_.add(turn, role, text)
        if len(done) >= OUT_ROWS:
            yield out()
    if open_ is not None:
        done.append({"conv_id": conv} | open_.result())
    if done:
        yield out()


PLACE = ("turn", "role", "text")


def damaged(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, gone) with faults put in by a hash of ``conv_id:turn``, modulo 20.

    0 drops the row (it stays as a row that is ``gone``, so that its conversation is not lost), 1 empties the
    text, 2 takes its sentence ends, 3 repeats it, 4 sets the role to user. Nulls count as one space, in the hash
    as in role and text; ``conv_id`` and ``turn`` stay null.
    """
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(filled("conv_id"), F.lit(":"), filled("turn")).cast("binary")) % 20
    text = F.when(F.col("_code") == 1, "").when(
        F.col("_code") == 2, F.translate(filled("text"), ENDINGS, "")
    )
    rows = conversations.withColumn("_code", code).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("_code") == 4, "user").otherwise(filled("role")).alias("role"),
        text.otherwise(filled("text")).alias("text"),
        (F.col("_code") == 0).alias("gone"),
        F.explode(F.array_repeat(F.lit(0), F.when(F.col("_code") == 3, 2).otherwise(1))).alias("_copy"),
    )
    return rows.drop("_copy")


def repair(rows: DataFrame) -> DataFrame:
    """Faults and cheapest repair of each conversation of (conv_id, turn, role, text).

    gaps, blank, duplicate, truncated, illegal   turn numbers that are missing, and rows by their first fault;
                      neighbouring rows whose role initials may not follow one another
    cost, audit       of the cheapest edits, in order: K keep, R other role, D delete, I insert
    symbols           for each edit the initial that it puts into the conversation, ``-`` for a deleted row
    repaired_sha256   SHA-256 of the repaired ``role:text`` rows, joined by line ends

    Rows are in order of ``turn``, null first, then role and text. A null role or text is one space; an empty
    role has no initial and is never kept. A null ``conv_id`` is one conversation. Rows may be marked ``gone``: they
    count for nothing, but their conversation gets its row. Other columns are not looked at; an empty table has no
    conversations.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        filled("role"),
        filled("text"),
        gone.alias("gone"),
    )
    # a row that is gone needs no text
    given = given.withColumn("text", F.when(F.col("gone"), "").otherwise(F.col("text")))
    ordered = given.repartition("conv_id").sortWithinPartitions(
        "conv_id", F.col("turn").asc_nulls_first(), "role", "text"
    )
    return ordered.mapInArrow(_repairs, _OUT_DDL)


def repaired_turns(rows: DataFrame, repairs: DataFrame) -> DataFrame:
    """(conv_id, pos, edit, turn, role, text): the repaired conversations, row by row.

    ``repairs`` is a written result of ``repair(rows)``. ``pos`` counts the rows of the result from 0; an inserted
    row has no ``turn`` and an empty text. Edits meet their rows by the row's number, an equi-join.
    """
    gone = F.col("gone") if "gone" in rows.columns else F.lit(False)
    filled = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    given = rows.where(~gone).select("conv_id", "turn", filled("role"), filled("text"))
    place = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = given.withColumn("_row", F.row_number().over(place).cast("long"))
    edits = repairs.select("conv_id", F.posexplode(F.split("audit", "")).alias("_at", "edit"), "symbols")
    edits = edits.where("edit != ''").withColumn("_symbol", F.expr("substring(symbols, _at + 1, 1)"))
    before = W.partitionBy("conv_id").orderBy("_at").rowsBetween(W.unboundedPreceding, W.currentRow)
    edits = edits.select(
        "conv_id",
        "edit",
        "_symbol",
        F.when(F.col("edit") != "I", F.count_if(F.col("edit") != "I").over(before)).alias("_row"),
        (F.count_if(F.col("edit") != "D").over(before) - 1).alias("pos"),
    ).where("edit != 'D'")
    same = numbered["conv_id"].eqNullSafe(edits["conv_id"]) & (numbered["_row"] == edits["_row"])
    met = edits.join(numbered.withColumnRenamed("role", "_role"), same, "left")
    role = F.when(F.col("_symbol") == "u", ROLES["u"]).when(F.col("_symbol") == "a", ROLES["a"])
    return met.select(
        edits["conv_id"],
        "pos",
        "edit",
        "turn",
        F.when(F.col("edit") == "K", F.col("_role")).otherwise(role).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
