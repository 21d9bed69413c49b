"""Conversations brought into legal order by the cheapest edits, with an audit of what was done.

Roles of a repaired conversation read ``(s?(ua)+)?`` by their initials. A row is kept, gets another role or
is deleted, and empty turns may be inserted anywhere. A dynamic programme goes over the rows with one
cell per state of the grammar; a cell has a cost and an audit, the initials of its edits. Audits are linked
nodes that share their prefixes, each with a rolling hash of all letters so far and its ancestors 1, 2, 4, ...
steps up. Equal costs are decided by the audits: the longest common prefix is searched over the ancestors'
hashes, verified letter by letter as far as the nodes are not the same, and the next letter decides.

Rows are range-partitioned by conversation and turn, so a conversation with any share of all rows lies in
several partitions, and is cut into pieces of some thousand rows. A piece that is all of its conversation is
done where it is. For the others each piece gives the cheapest edits from every state to every state; one
pass over these small tables, in order, chooses the states between pieces with the same linked audits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType, StructType

from corpus_spark.llm.arrow import map_arrow
from corpus_spark.llm.scratch import written

# States of the grammar: nothing yet, after a system turn, after a user turn, after an assistant turn.
STEPS: tuple[dict[str, int], ...] = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ENDS = (0, 3)
NAMES = {"u": "user", "a": "assistant"}
ORDERLY = ("su", "ua", "au")
RENAME, DELETE, INSERT, CUT_SHORT = 2, 3, 2, 1
# Rows, and bytes of text, of one piece of a conversation.
PIECE_ROWS = 4096
PIECE_BYTES = 8 << 20
BLANKS = "\t\n\x0b\x0c\r "
_PRIME, _BASE = (1 << 61) - 1, 1_000_003


class Audit:
    """Edits up to here: the last letters, and linked nodes for all before them."""

    __slots__ = ("letters", "depth", "hash", "up", "mark")

    def __init__(self, letters: str = "", parent: Audit | None = None, mark=None):
        self.letters, self.mark = letters, mark
        if parent is None:
            self.depth, self.hash, self.up = 0, 0, ()
            return
        self.depth = parent.depth + 1
        value = parent.hash
        for letter in letters:
            value = (value * _BASE + ord(letter)) % _PRIME
        # The number of letters tells an empty step from none.
        self.hash = (value * _BASE + len(letters)) % _PRIME
        up = [parent]
        while len(up[-1].up) >= len(up):
            up.append(up[-1].up[len(up) - 1])
        self.up = tuple(up)

    def at(self, depth: int) -> Audit:
        """The node of this depth on the way here."""
        node = self
        while node.depth > depth:
            node = node.up[min(len(node.up), (node.depth - depth).bit_length()) - 1]
        return node

    def path(self, above: int = 0) -> list[Audit]:
        """The nodes of more than this depth, in order."""
        found, node = [], self
        while node.depth > above:
            found.append(node)
            node = node.up[0]
        return found[::-1]

    def text(self, above: int = 0) -> str:
        return "".join([node.letters for node in self.path(above)])


def _first_difference(a: Audit, b: Audit) -> int:
    """The depth of the last common node, or what hashes take for one, of two nodes of one depth that differ."""
    step = len(a.up)
    while step:
        step -= 1
        if step < min(len(a.up), len(b.up)) and a.up[step].hash != b.up[step].hash:
            a, b = a.up[step], b.up[step]
    return a.depth - 1


def before(a: Audit, b: Audit) -> bool:
    """Whether the letters of one audit come before those of the other."""
    level = min(a.depth, b.depth)
    low, high = a.at(level), b.at(level)
    common = level if low.hash == high.hash else _first_difference(low, high)
    # Equal hashes are believed only where the letters are equal, up to a node that both share.
    low, high = low.at(common), high.at(common)
    while low is not high:
        if low.letters != high.letters:
            common = low.depth - 1
        low, high = low.up[0], high.up[0]
    if common < level:
        x, y = a.at(common + 1).letters, b.at(common + 1).letters
        if not x.startswith(y) and not y.startswith(x):
            return x < y
    return a.text(common) < b.text(common)


Cells = dict[int, tuple[int, Audit]]


def _better(cells: Cells, state: int, cost: int, letters: str, parent: Audit, mark=None) -> bool:
    """Put the audit that goes on with these letters into the cell, if it costs less or comes before."""
    held = cells.get(state)
    if held and held[0] < cost:
        return False
    audit = Audit(letters, parent, mark)
    if held and held[0] == cost and not before(audit, held[1]):
        return False
    cells[state] = (cost, audit)
    return True


def _insert(cells: Cells) -> Cells:
    """With empty turns inserted as long as that reaches a state at less cost, or at the same with an audit before."""
    changed = list(cells)
    while changed:
        state = changed.pop()
        cost, audit = cells[state]
        for initial, after in STEPS[state].items():
            if initial in NAMES and _better(cells, after, cost + INSERT, "I", audit):
                changed.append(after)
    return cells


class Row:
    """A turn, and what is wrong with it first: blank, duplicate, truncated or nothing."""

    __slots__ = ("role", "text", "fault")

    def __init__(self, role: str, text: str | None, fault: str | None):
        self.role, self.text, self.fault = role, text, fault


def fault_of(text: str, seen: bool) -> str | None:
    last = text.rstrip(BLANKS)[-1:]
    if not last:
        return "blank"
    return "duplicate" if seen else None if last in ".!?" else "truncated"


def edits(rows: list[Row], state: int = 0) -> Cells:
    """For each state that the rows can be brought to from the given one, the least cost and its first audit."""
    cells = _insert({state: (0, Audit())})
    for row in rows:
        after: Cells = {}
        for own, (cost, audit) in cells.items():
            _better(after, own, cost + DELETE, "D", audit)
            if row.fault in ("blank", "duplicate"):
                continue
            short = CUT_SHORT if row.fault == "truncated" else 0
            steps = STEPS[own]
            if row.role[:1] in steps:
                _better(after, steps[row.role[:1]], cost + short, "K", audit)
            for initial, reached in steps.items():
                if initial in NAMES:
                    _better(after, reached, cost + RENAME + short, "R", audit)
        cells = _insert(after)
    return cells


def chosen(cells: Cells) -> tuple[int, Audit] | None:
    """The cheapest cell that a conversation may end with, ties by audit."""
    best = None
    for cell in (cells[state] for state in ENDS if state in cells):
        if best is None or cell[0] < best[0] or cell[0] == best[0] and before(cell[1], best[1]):
            best = cell
    return best


def applied(rows: list[Row], audit: str, state: int = 0) -> list[tuple[str, str, str]]:
    """(edit, role, text) of each turn that the edits leave or insert."""
    found, remaining = [], iter(rows)
    for letter in audit:
        row = None if letter == "I" else next(remaining)
        if letter == "D":
            continue
        if letter == "K":
            found.append(("K", row.role, row.text))
            state = STEPS[state][row.role[:1]]
        else:
            initial = next(each for each in STEPS[state] if each in NAMES)
            found.append((letter, NAMES[initial], row.text if row else ""))
            state = STEPS[state][initial]
    return found


def _lines(turns: list[tuple[str, str, str]]) -> str | None:
    return "\n".join(f"{role}:{text}" for _, role, text in turns) if turns else None


class Piece:
    """Rows of one conversation that follow each other, and their counts."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.rows: list[Row] = []
        self.size = 0
        self.turns: list[int] = []  # first, last and number of different ones
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = 0

    def add(self, turn: int | None, row: Row) -> None:
        if turn is not None:
            if not self.turns:
                self.turns = [turn, turn, 1]
            elif turn != self.turns[1]:
                self.turns = [self.turns[0], turn, self.turns[2] + 1]
        if self.rows:
            self.illegal += self.rows[-1].role[:1] + row.role[:1] not in ORDERLY
        if row.fault:
            self.faults[row.fault] += 1
        self.rows.append(row)
        self.size += len(row.text or "")

    def full(self) -> bool:
        return len(self.rows) >= PIECE_ROWS or self.size >= PIECE_BYTES


def _gaps(first: int, last: int, n: int) -> int:
    return min(last - first + 1 - n, (1 << 63) - 1)


_TURNS = "array<struct<edit:string,role:string,text:string>>"
_TOTALS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"
_PIECES = (
    "number long, open boolean, " + _TOTALS + ", repaired_sha256 string, turns " + _TURNS + ", first long, last long, n_turns long, "
    "begins string, ends string, costs array<long>, audits array<string>, rows array<struct<role:string,text:string,fault:string>>"
)


def _records(schema: StructType, rows: list[dict]) -> pa.RecordBatch:
    kinds = [(field.name, to_arrow_type(field.dataType)) for field in schema.fields]
    return pa.RecordBatch.from_arrays([pa.array([row.get(name) for row in rows], kind) for name, kind in kinds], schema.names)


def _whole(piece: Piece, turns: bool) -> dict:
    cost, audit = chosen(edits(piece.rows))
    left = applied(piece.rows, audit.text())
    return {
        "conv_id": piece.conv_id, "open": False, "gaps": _gaps(*piece.turns) if piece.turns else 0, **piece.faults, "illegal": piece.illegal,
        "cost": cost, "audit": audit.text(), "repaired_sha256": hashlib.sha256((_lines(left) or "").encode()).hexdigest(),
        "turns": [dict(zip(("edit", "role", "text"), turn)) for turn in left] if turns else None,
    }


def _open(piece: Piece) -> dict:
    costs, audits = [], []
    for state in range(len(STEPS)):
        cells = edits(piece.rows, state)
        for reached in range(len(STEPS)):
            cost, audit = cells.get(reached, (None, None))
            costs.append(cost)
            audits.append(audit.text() if audit else None)
    first, last, n_turns = piece.turns or (None, None, 0)
    return {
        "conv_id": piece.conv_id, "open": True, **piece.faults, "illegal": piece.illegal, "first": first, "last": last, "n_turns": n_turns,
        "begins": piece.rows[0].role[:1], "ends": piece.rows[-1].role[:1], "costs": costs, "audits": audits,
        "rows": [{"role": row.role, "text": row.text, "fault": row.fault} for row in piece.rows],
    }


def _pieces(batches, schema: StructType, turns: bool) -> Iterator[pa.RecordBatch]:
    """Rows in order of conversation and turn as pieces. A conversation at either end of the partition may go on
    in another one, so it is open, as is one of more than a piece."""
    number = TaskContext.get().partitionId() << 32
    held, done, first = None, [], True

    def record(piece: Piece, open_: bool) -> None:
        nonlocal number
        done.append({**(_open(piece) if open_ else _whole(piece, turns)), "number": number})
        number += 1

    cut = False
    for batch in batches:
        for conv_id, turn, role, text, n, seen in zip(*(column.to_pylist() for column in batch.columns)):
            if held is None or conv_id != held.conv_id:
                if held is not None:
                    record(held, first or cut)
                    first = False
                held, cut = Piece(conv_id), False
            for copy in range(n):
                if held.full():
                    record(held, True)
                    held, cut = Piece(conv_id), True
                fault = fault_of(text, seen or copy > 0)
                # What has to go needs no text, and nothing of its role but the initial.
                gone = fault in ("blank", "duplicate")
                held.add(turn, Row(role[:1] if gone else role, None if gone else text, fault))
        if done:
            yield _records(schema, done)
            done = []
    if held is not None:
        record(held, True)
    if done:
        yield _records(schema, done)


_CHOICES = "number long, state int, audit_of_piece string, at_end boolean, " + _TOTALS


def _choices(batches, schema: StructType) -> Iterator[pa.RecordBatch]:
    """The states between the pieces of each open conversation, and its totals with the last piece."""
    conv_id, cells, totals = None, None, {}

    def finished() -> pa.RecordBatch:
        cost, audit = chosen(cells)
        first, last, n_turns = totals.pop("turns") or (0, 0, 1)
        totals.pop("ends")
        nodes = audit.path()
        rows = [{"conv_id": conv_id, "number": node.mark[0], "state": node.mark[1], "audit_of_piece": node.letters, "at_end": False} for node in nodes]
        rows[-1] |= {**totals, "at_end": True, "gaps": _gaps(first, last, n_turns), "cost": cost, "audit": audit.text()}
        return _records(schema, rows)

    for batch in batches:
        for row in batch.to_pylist():
            if cells is None or row["conv_id"] != conv_id:
                if cells is not None:
                    yield finished()
                conv_id, cells = row["conv_id"], {0: (0, Audit())}
                totals = {"blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0, "turns": None, "ends": None}
            for name in ("blank", "duplicate", "truncated", "illegal"):
                totals[name] += row[name]
            if totals["ends"] is not None:
                totals["illegal"] += totals["ends"] + row["begins"] not in ORDERLY
            totals["ends"] = row["ends"]
            if row["n_turns"]:
                first, last, n = totals["turns"] or (row["first"], None, 0)
                totals["turns"] = (first, row["last"], n + row["n_turns"] - (last == row["first"]))
            after: Cells = {}
            for state, (cost, audit) in cells.items():
                for reached in range(len(STEPS)):
                    at = state * len(STEPS) + reached
                    if row["costs"][at] is not None:
                        _better(after, reached, cost + row["costs"][at], row["audits"][at], audit, (row["number"], state))
            cells = after
    if cells is not None:
        yield finished()


def _applied(batches, schema: StructType) -> Iterator[pa.RecordBatch]:
    """What the chosen edits leave of each piece."""
    for batch in batches:
        for row in batch.to_pylist():
            left = applied([Row(**each) for each in row.pop("rows")], row.pop("audit_of_piece"), row.pop("state"))
            yield _records(schema, [{**row, "turns": [dict(zip(("edit", "role", "text"), turn)) for turn in left]}])


def _digested(batches, schema: StructType) -> Iterator[pa.RecordBatch]:
    """One row per conversation from its pieces in order; the digest takes one piece at a time."""
    digest, lines = hashlib.sha256(), 0
    for batch in batches:
        for row in batch.to_pylist():
            for turn in row.pop("turns"):
                digest.update(f"{'\n' if lines else ''}{turn['role']}:{turn['text']}".encode())
                lines += 1
            if row["at_end"]:
                yield _records(schema, [{**row, "repaired_sha256": digest.hexdigest()}])
                digest, lines = hashlib.sha256(), 0


def _schema(kind: DataType, fields: str) -> StructType:
    return StructType(StructType().add("conv_id", kind).fields + StructType.fromDDL(fields).fields)


def _placed(df: DataFrame, conv_id: str, turn: str, role: str, text: str, turns: bool) -> DataFrame:
    """All pieces, written to the shared folder: whole conversations repaired, open ones with their tables."""
    blank = F.lit(" ")
    rows = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).cast("long").alias("turn"), F.coalesce(F.col(role), blank).alias("role"),
        F.coalesce(F.col(text), blank).alias("text"),
    )
    rows = rows.withColumn("key", F.md5("text"))
    # Texts that a role says in several turns, by their digests: written, so that Spark knows how few they are and
    # need not shuffle the texts to find them.
    place = F.struct(F.col("turn").isNotNull(), F.col("turn"))
    again = written(
        rows.groupBy("conv_id", "role", "key").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter("first <> last")
        .select(*[F.col(name).alias(f"{name}_2") for name in ("conv_id", "role", "key")], "first"),
        "said-again",
    )
    same = F.expr("conv_id <=> conv_id_2 AND role = role_2 AND key = key_2")
    # Rows that are the same in everything are one row and a number, however many there are.
    counted = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"), F.first("key").alias("key"))
    order = [F.asc_nulls_first(name) for name in ("conv_id", "turn", "role", "key")]
    marked = counted.join(again, same, "left").select("conv_id", "turn", "role", "text", "n", F.coalesce(place > F.col("first"), F.lit(False)).alias("seen"), "key")
    sorted_rows = marked.repartitionByRange(*order).sortWithinPartitions(*order).drop("key")
    schema = _schema(sorted_rows.schema["conv_id"].dataType, _PIECES)
    return written(map_arrow(sorted_rows, lambda batches: _pieces(batches, schema, turns), schema), "conversation-pieces")


def _finished(pieces: DataFrame) -> DataFrame:
    """The open pieces with what is left of them, and the totals of their conversation with the last one."""
    kind = pieces.schema["conv_id"].dataType
    own = pieces.filter("open")
    light = own.drop("open", "rows", "turns", "gaps", "cost", "audit", "repaired_sha256").repartition("conv_id").sortWithinPartitions("conv_id", "number")
    schema = _schema(kind, _CHOICES)
    picked = written(map_arrow(light, lambda batches: _choices(batches, schema), schema), "conversation-choices")
    done = _schema(kind, "number long, at_end boolean, " + _TOTALS + ", turns " + _TURNS)
    return map_arrow(picked.join(own.select("number", "rows"), "number"), lambda batches: _applied(batches, done), done)


_RESULT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def repair(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) per conversation.

    Rows are taken by turn, nulls first, and within a turn by role and digest of the text. The first
    fault of a row counts: ``blank`` (no character but blanks), ``duplicate`` (role and text seen earlier),
    ``truncated`` (the last character that is not blank is none of ``.!?``). ``gaps`` are the turns missing
    between the smallest and the largest, ``illegal`` the neighbours whose initials are not su, ua or au.
    Keeping costs 0, another role (user or assistant) 2, deleting 3, inserting an empty turn 2, a truncated row
    that is not deleted 1 more; blank and duplicate rows have to go. ``audit`` has the initials of the cheapest
    edits, of equally cheap ones the first in ASCII order; the digest is of the repaired ``role:text``
    lines.

    A null role or text is one space, an empty role is never legal; a null id is a conversation of its own.
    Turns are whole numbers. Rows that are the same in everything are duplicates of one another. An
    empty table gives an empty table; other columns are not read. Runs jobs when called. A conversation of
    any size is repaired in pieces; only its audit, which is one value, and the bytes of its digest,
    which have an order, pass through one task, a piece at a time.
    """
    pieces = _placed(df, conv_id, turn, role, text, turns=False)
    whole = pieces.filter("NOT open").select(*_RESULT)
    left = _finished(pieces).repartition("conv_id").sortWithinPartitions("conv_id", "number")
    schema = _schema(pieces.schema["conv_id"].dataType, _TOTALS + ", repaired_sha256 string")
    return whole.unionByName(map_arrow(left, lambda batches: _digested(batches, schema), schema).select(*_RESULT))


def repaired_turns(df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, place, edit, role, text): the turns of the repaired conversations.

    ``place`` grows along a conversation, with gaps; ``edit`` is K for a turn as it was, R for one with another
    role, I for an inserted one. Everything else is as in ``repair``.
    """
    pieces = _placed(df, conv_id, turn, role, text, turns=True)
    both = pieces.filter("NOT open").select("conv_id", "number", "turns").unionByName(_finished(pieces).select("conv_id", "number", "turns"))
    place: Column = F.struct("number", "pos").alias("place")
    return both.select("conv_id", "number", F.posexplode("turns").alias("pos", "row")).select("conv_id", place, "row.edit", "row.role", "row.text")
