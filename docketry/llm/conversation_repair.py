"""Repair of the structure of conversations: faults, cheapest edits, the result.

1. Equal rows of a conversation become one row with their number, and the first
   place of every role and text a marker; both are aggregates that combine before
   the shuffle, so a text or turn that a third of all rows share is a few rows.
2. Rows and markers are dealt by ranges of conversation and place.  A range task
   reads them in order: a conversation that lies within it is run-length coded by
   symbols of role and fault, each run is advanced by the binary powers of its
   min-plus transition, and the cheapest edits are unrolled.
3. A long conversation, or one at the border of two ranges, is cut into pieces
   of at most ``PIECE_TURNS`` turns or ``PIECE_BYTES``, of which the transition
   is kept.  The small transitions go through the pieces backwards; then each
   piece, in order, has its edits unrolled.  Both walks stream with a state of a
   few numbers.  The hash of the repaired text needs its pieces one after the
   other; nothing but that and the audit, which is one value, follows one key.

``conversation_repair`` returns one row for each conversation, ``repaired_turns``
the turns themselves.
"""

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F, types as T

from docketry.llm.frames import named, small_batches, written
from docketry.llm.turn_grammar import (
    END, GONE, KEEP, NAMES, NEXT, START, STATES, advance, applied, symbol, tail, transition, unroll,
)

PIECE_TURNS = 4096
PIECE_BYTES = 1 << 20
#: Pairs of role initials that may follow each other.
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\f\r"

_COUNTS = "blank bigint, duplicate bigint, truncated bigint, illegal bigint"
_DONE = f"gaps bigint, {_COUNTS}, cost bigint, audit string, repaired_sha256 string"
_TURNS = "turns array<struct<role: string, text: string, edit: string>>"
_PIECE = (
    f"part bigint, piece bigint, {_COUNTS}, first string, last string, low bigint, high bigint, "
    "distinct bigint, matrix array<bigint>, symbols array<int>, times array<bigint>, "
    "roles array<string>, texts array<string>"
)
_MOST = (1 << 63) - 1


class Piece:
    """Consecutive turns of one conversation."""

    def __init__(self, part: int = 0, piece: int = 0):
        self.part, self.piece = part, piece
        self.blank = self.duplicate = self.truncated = self.illegal = 0
        self.first = self.last = None  # initials
        self.low = self.high = None  # turns
        self.distinct = 0
        self.symbols: list[int] = []
        self.times: list[int] = []
        self.roles: list[str] = []  # of turns that may stay
        self.texts: list[str] = []
        self.bytes = 0

    def add(self, turn, role: str, text: str, initial: str, copies: int, first: bool, blank: bool, ended: bool):
        """``copies`` equal rows; ``first`` if none with this role and text came before."""
        self.illegal += copies - 1 + (self.last is not None and self.last + initial not in LEGAL)
        self.first, self.last = self.first if self.first is not None else initial, initial
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if blank:
            self.blank += copies
            self._run(GONE, copies)
            return
        if first:
            self.truncated += not ended
            self._run(symbol(initial, not ended), 1)
            self.roles.append(role)
            self.texts.append(text)
            self.bytes += len(text) + len(role)
            copies -= 1
        self.duplicate += copies
        self._run(GONE, copies)

    def _run(self, kind: int, times: int):
        if not times:
            return
        if self.symbols and self.symbols[-1] == kind:
            self.times[-1] += times
        else:
            self.symbols.append(kind)
            self.times.append(times)

    def full(self) -> bool:
        return len(self.symbols) >= PIECE_TURNS or len(self.roles) >= PIECE_TURNS or self.bytes >= PIECE_BYTES

    def runs(self) -> list[tuple[int, int]]:
        return list(zip(self.symbols, self.times))

    def row(self) -> dict:
        return {
            **{k: getattr(self, k) for k in ("part", "piece", "blank", "duplicate", "truncated", "illegal",
                                             "first", "last", "low", "high", "distinct", "symbols", "times",
                                             "roles", "texts")},
            "matrix": [c for line in transition(self.runs()) for c in line],
        }


class Repair:
    """One conversation, its pieces in order."""

    def __init__(self, with_turns: bool):
        self.with_turns = with_turns
        self.state, self.audit, self.cost = START, [], 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.distinct = 0
        self.last = self.low = self.high = None
        self.hash, self.some = hashlib.sha256(), False

    def add(self, piece: Piece, after: tuple[int, ...]) -> list[dict]:
        """Takes the next piece, the costs after which are known; its repaired turns."""
        for k in ("blank", "duplicate", "truncated", "illegal", "distinct"):
            setattr(self, k, getattr(self, k) + getattr(piece, k))
        if piece.first is not None:
            self.illegal += self.last is not None and self.last + piece.first not in LEGAL
            self.last = piece.last
        if piece.low is not None:
            self.distinct -= self.high == piece.low
            self.low, self.high = piece.low if self.low is None else self.low, piece.high
        out: list[dict] = []
        edits, end = unroll(piece.runs(), after, self.state)
        state, line = self.state, 0
        for kind, letters, times in edits:
            self.audit.append(letters * times)
            if kind == GONE and letters == "D":
                continue
            for _ in range(times):
                for letter in letters:
                    if letter == "K":
                        self._line(out, piece.roles[line], piece.texts[line], letter)
                        state = KEEP[piece.roles[line][0]][1]
                    elif letter != "D":
                        state = NEXT[state]
                        self._line(out, NAMES[state], piece.texts[line] if letter == "R" else "", letter)
                line += kind != GONE
        self.state = end
        return out

    def finish(self) -> tuple[dict, list[dict]]:
        out: list[dict] = []
        for letter in tail(self.state):
            self.state = NEXT[self.state]
            self._line(out, NAMES[self.state], "", letter)
            self.audit.append(letter)
        gaps = 0 if self.low is None else min(self.high - self.low + 1 - self.distinct, _MOST)
        return {
            "gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated,
            "illegal": self.illegal, "cost": self.cost, "audit": "".join(self.audit),
            "repaired_sha256": self.hash.hexdigest(),
        }, out

    def _line(self, out: list[dict], role: str, text: str, edit: str):
        self.hash.update((("\n" if self.some else "") + f"{role}:{text}").encode())
        self.some = True
        if self.with_turns:
            out.append({"role": role, "text": text, "edit": edit})


def _same(a, b) -> bool:
    return a == b or (a != a and b != b)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns])


class _Out:
    """Rows collected into Arrow batches of one schema."""

    def __init__(self, schema: pa.Schema):
        self.schema, self.rows, self.bytes = schema, [], 0

    def add(self, row: dict, size: int) -> bool:
        self.rows.append(row)
        self.bytes += size
        return len(self.rows) >= 1000 or self.bytes >= 8 * PIECE_BYTES

    def take(self) -> pa.RecordBatch:
        rows, self.rows, self.bytes = self.rows, [], 0
        return pa.RecordBatch.from_pylist(rows, self.schema)


def _pieces(rows: DataFrame, with_turns: bool) -> DataFrame:
    """Finished conversations, and the pieces of the others, from ordered rows."""
    schema = T.StructType([T.StructField("key", rows.schema["key"].dataType)])
    for part in (_DONE, _TURNS, _PIECE):
        for field in T._parse_datatype_string(part).fields:
            if field.name not in schema.names:
                schema = schema.add(field)
    schema = schema.add("whole", T.BooleanType())

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        out = _Out(to_arrow_schema(schema))
        part = TaskContext.get().partitionId()
        key, piece, cut, border, marked = None, None, False, True, False

        def close(last: bool) -> dict:
            """The row of the conversation so far; ``last`` if no more of it can follow."""
            if border or not last or cut:
                return {"key": key, "whole": False, **piece.row()}
            repair = Repair(with_turns)
            costs = END
            for kind, times in reversed(piece.runs()):
                costs = advance(kind, times, costs)
            repair.cost = costs[START]
            turns = repair.add(piece, END)
            done, more = repair.finish()
            return {"key": key, "whole": True, **done, "turns": turns + more if with_turns else None}

        for next_key, turn, role, text, copies, initial, blank, ended in _rows(batches):
            if piece is None or not _same(key, next_key):
                if piece is not None:
                    if out.add(close(True), piece.bytes):
                        yield out.take()
                    border = False
                # Pieces are numbered through the task, so part and piece are a key.
                key, piece, cut, marked = next_key, Piece(part, piece.piece + 1 if piece else 0), False, False
            if copies < 0:
                marked = True
                continue
            if copies:
                piece.add(turn, role, text, initial, copies, marked, blank, ended)
            marked = False
            if piece.full():
                if out.add(close(False), piece.bytes):
                    yield out.take()
                cut, piece = True, Piece(part, piece.piece + 1)
        if piece is not None:
            border = True
            out.add(close(False), piece.bytes)
            yield out.take()

    return rows.mapInArrow(work, schema)


def _costs_after(pieces: DataFrame) -> DataFrame:
    """``part, piece, after, whole_cost``: the costs to go after each piece."""
    small = pieces.select("key", "part", "piece", "matrix")
    backward = small.repartition("key").sortWithinPartitions(
        "key", F.col("part").desc(), F.col("piece").desc()
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, costs, begun = None, END, False
        for batch in batches:
            found = []
            for next_key, part, piece, matrix in _rows([batch]):
                if not begun or not _same(key, next_key):
                    key, costs, begun = next_key, END, True
                found.append((part, piece, costs, 0))
                costs = applied([matrix[4 * s : 4 * s + 4] for s in STATES], costs)
                found[-1] = (part, piece, found[-1][2], costs[START])
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[k] for f in found], kind) for k, kind in enumerate(
                    (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()))],
                ["part", "piece", "after", "before"],
            )

    return backward.mapInArrow(work, "part long, piece long, after array<bigint>, before long")


def _finished(pieces: DataFrame, with_turns: bool) -> DataFrame:
    """The conversations that lie in several pieces: their rows, in their order."""
    after = written(_costs_after(pieces), "conversation-costs")
    ordered = (
        pieces.drop("matrix").join(after, ["part", "piece"]).repartition("key")
        .sortWithinPartitions("key", "part", "piece")
    )
    schema = T.StructType([T.StructField("key", pieces.schema["key"].dataType)])
    for field in [*T._parse_datatype_string(_DONE).fields, *T._parse_datatype_string(_TURNS).fields]:
        schema = schema.add(field)
    schema = schema.add("place", T.LongType())
    names = ordered.columns

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        key, repair, place = None, None, 0

        def end() -> pa.RecordBatch:
            done, turns = repair.finish()
            return pa.RecordBatch.from_pylist([{"key": key, **done, "turns": turns, "place": place}], arrow)

        for batch in batches:
            for row in range(batch.num_rows):  # one at a time: a piece may be large
                value = batch.slice(row, 1).to_pylist()[0]
                if repair is None or not _same(key, value["key"]):
                    if repair is not None:
                        yield end()
                    key, repair, place = value["key"], Repair(with_turns), 0
                    repair.cost = value["before"]
                piece = Piece()
                for name in names:
                    setattr(piece, name, value[name])
                turns = repair.add(piece, tuple(value["after"]))
                if with_turns and turns:
                    yield pa.RecordBatch.from_pylist([{"key": key, "turns": turns, "place": place}], arrow)
                    place += len(turns)
        if repair is not None:
            yield end()

    return ordered.mapInArrow(work, schema)


def _repaired(rows: DataFrame, conv_id: str, turn: str, role: str, text: str, copies: str | None, with_turns: bool):
    small_batches(rows.sparkSession)
    times = named(copies).cast("long") if copies else F.lit(1)
    seen = lambda c: F.when(F.col("copies") > 0, F.coalesce(c.cast("string"), F.lit(" ")))
    base = rows.select(named(conv_id).alias("key"), F.greatest(F.coalesce(times, F.lit(0)), F.lit(0)).alias("copies"),
                       named(turn).alias("t"), named(role).alias("r"), named(text).alias("x"))
    base = base.select("key", F.when(F.col("copies") > 0, F.col("t").try_cast("long")).alias("turn"),
                       seen(F.col("r")).alias("role"), seen(F.col("x")).alias("text"), "copies")
    equal = base.groupBy("key", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    equal = equal.withColumn("digest", F.md5(F.col("text").cast("binary")))
    firsts = equal.filter("copies > 0").groupBy("key", "role", "digest").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("has"), F.col("turn").alias("turn"))).alias("at")
    )
    marks = firsts.select("key", F.col("at.turn").alias("turn"), "role", F.lit(None).cast("string").alias("text"),
                          F.lit(-1).cast("long").alias("copies"), "digest")
    place = ["key", "turn", "role", "digest"]
    ordered = equal.unionByName(marks).repartitionByRange(*place).sortWithinPartitions(*place, "copies")
    trimmed = F.rtrim(F.col("text"), F.lit(BLANKS))
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1))
    ordered = ordered.select(
        "key", "turn", "role", "text", "copies", initial.alias("initial"), (trimmed == "").alias("blank"),
        F.right(trimmed, F.lit(1)).isin(".", "!", "?").alias("ended"),
    )
    pieces = written(_pieces(ordered, with_turns), "conversation-pieces")
    return pieces.filter("whole"), _finished(pieces.filter("NOT whole"), with_turns)


def conversation_repair(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """One row for each conversation: ``conv_id, gaps, blank, duplicate, truncated,
    illegal, cost, audit, repaired_sha256``.

    A conversation's rows are taken by turn, a NULL turn (or one that is no number)
    first, rows of one turn by role and a digest of the text.  NULL roles and texts
    are one blank; an empty role has a blank as its initial, so it can be re-roled
    or deleted but not kept.  Equal rows are repeats, which the repair deletes.
    ``copies`` names a column with the number of times that a row stands; rows
    with 0 or NULL stand not at all, but their conversation is returned: with
    zeros, an empty audit and the hash of an empty text.  NULL is a conversation
    like others.  Other columns are not looked at; an empty table gives an empty
    result.
    """
    whole, rest = _repaired(rows, conv_id, turn, role, text, copies, False)
    names = [f.name for f in T._parse_datatype_string(_DONE).fields]
    ended = rest.filter(F.col("audit").isNotNull())
    return whole.select("key", *names).unionByName(ended.select("key", *names)).withColumnRenamed("key", "conv_id")


def repaired_turns(
    rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    copies: str | None = None,
) -> DataFrame:
    """``conv_id, place, role, text, edit`` of each turn after the repair, places
    from 0; rows are taken as :func:`conversation_repair` states."""
    whole, rest = _repaired(rows, conv_id, turn, role, text, copies, True)
    both = whole.select("key", "turns", F.lit(0).cast("long").alias("place")).unionByName(
        rest.select("key", "turns", "place")
    )
    each = both.select(F.col("key").alias("conv_id"), "place", F.posexplode("turns").alias("n", "turn"))
    return each.select("conv_id", (F.col("place") + F.col("n")).alias("place"), "turn.*")
