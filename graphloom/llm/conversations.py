"""Conversation structure repair at least cost.

What a conversation may look like is an automaton over its roles' initials, and an edit has
a cost: together a weighted automaton that isn't deterministic. It is made so as rows come:
the costs to the end from each of its states, less the least of them, are a vector; a vector
and a row's symbol give the vector before that row and the difference in cost. Vectors are few,
so after the first rows a scan only looks up a table. It runs from a conversation's last row to
its first; the trace runs back against it along the arcs that lose nothing, and takes the least
letter of those.

A conversation that lies in several partitions is scanned in pieces, each for all four states
behind it at once (a vector for each: a matrix). Pieces' matrices give the vector behind every
piece, their traces where each is entered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import BLANKS, arrow_batches, discard, materialize

#: States: nothing yet, after a system row, after a user's, after an assistant's; and where a conversation may end.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
ENDS = (0, 3)
#: What edits cost, and what a truncated row adds that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
ROLES = {"u": "user", "a": "assistant"}
#: The role that a new or changed row gets in each state.
NEW = {q: next(x for x in "ua" if (q, x) in STEPS) for q in range(4)}
#: A row's symbol: 0 must go; else 1 + 2 * place of its initial here (others last) + whether it is truncated.
INITIALS = "sua"
INF = 1 << 40
#: No two states differ by more in what they cost to the end.
FAR = 2 * INSERT + 2 * DELETE
#: Rows that Python is handed at once.
ROWS = 1_000


def _arcs(symbol: int) -> list[tuple[str, int, int, int]]:
    """(letter, state, next state, cost) of the edits of a row with this symbol."""
    arcs = [("D", q, q, DELETE) for q in range(4)]
    if symbol:
        initial, late = (INITIALS + "?")[(symbol - 1) // 2], TRUNCATED * ((symbol - 1) % 2)
        arcs += [("K", q, STEPS[q, initial], KEEP + late) for q in range(4) if (q, initial) in STEPS]
        arcs += [("R", q, STEPS[q, NEW[q]], REROLE + late) for q in range(4)]
    return arcs


ARCS = [_arcs(s) for s in range(9)]
Vector = tuple[int, ...]


def _inserted(v: list[int]) -> list[int]:
    """Costs from each state when rows may be inserted first."""
    for _ in range(3):
        v = [min(v[q], INSERT + v[STEPS[q, NEW[q]]]) for q in range(4)]
    return v


def _before(symbol: int, v: Vector) -> list[int]:
    out = [INF] * 4
    for _, q, to, cost in ARCS[symbol]:
        out[q] = min(out[q], cost + v[to])
    return _inserted(out)


class Automaton:
    """Vectors (or rows of four of them) by number, and the table of their moves."""

    def __init__(self):
        self.vectors: list[Vector] = []
        self.numbers: dict[Vector, int] = {}
        self.moves: dict[int, tuple[int, int]] = {}
        self.steps: dict[int, tuple[str, int]] = {}
        self.end = self.number(_inserted([0 if q in ENDS else INF for q in range(4)]))[0]
        self.unit = self.number([c for x in range(4) for c in _inserted([0 if q == x else INF for q in range(4)])])[0]

    def number(self, v: list[int]) -> tuple[int, int]:
        """Number of a vector less its least cost, and that cost."""
        least = min(v)
        key = tuple(c - least if c < INF else INF for c in v)
        if key not in self.numbers:
            self.numbers[key] = len(self.vectors)
            self.vectors.append(key)
        return self.numbers[key], least

    def move(self, number: int, symbol: int) -> tuple[int, int]:
        """The vector before a row with this symbol, and how much more it costs."""
        key = number * 9 + symbol
        found = self.moves.get(key)
        if found is None:
            v = self.vectors[number]
            out = [c for k in range(0, len(v), 4) for c in _before(symbol, v[k : k + 4])]
            if len(out) > 4:  # an exit that costs so much more than another from the same state is never taken
                least = [min(out[q::4]) for q in range(4)]
                out = [c if c <= least[k % 4] + FAR else INF for k, c in enumerate(out)]
            found = self.moves[key] = self.number(out)
        return found

    def scan(self, symbols: bytes | bytearray, number: int) -> tuple[int, int]:
        """The vector before all these rows, and its least cost."""
        cost, moves = 0, self.moves
        for s in reversed(symbols):
            number, more = moves.get(number * 9 + s) or self.move(number, s)
            cost += more
        return number, cost

    def behind(self, symbols: bytes | bytearray, number: int) -> list[int]:
        """The vector behind each row."""
        out = [number] * len(symbols)
        for k in range(len(symbols) - 1, 0, -1):
            out[k - 1] = self.move(out[k], symbols[k])[0]
        return out

    def step(self, state: int, symbol: int, number: int) -> tuple[str, int]:
        """Letters of the edits up to and with a row, from this state and with this vector behind it; the next state."""
        key = (number * 9 + symbol) * 4 + state
        found = self.steps.get(key)
        if found is None:
            v, letters, q = self.vectors[number], "", state
            here = _before(symbol, v)
            while True:
                tight = [(letter, to) for letter, p, to, cost in ARCS[symbol] if p == q and here[q] == cost + v[to]]
                if here[q] == INSERT + here[STEPS[q, NEW[q]]]:
                    tight.append(("I", -1))
                letter, to = min(tight)
                letters += letter
                if letter != "I":
                    break
                q = STEPS[q, NEW[q]]
            found = self.steps[key] = letters, to
        return found

    def exit(self, symbols: bytes | bytearray, behind: list[int], state: int) -> int:
        for s, n in zip(symbols, behind, strict=True):
            state = self.step(state, s, n)[1]
        return state

    def repaired(self, symbols: bytes | bytearray, behind: list[int], state: int, kept: list[tuple[str, str]], last: bool) -> tuple[str, list[dict]]:
        """Letters of all edits, and the rows that they leave; last: the conversation ends here."""
        audit, rows = [], []

        def new(q: int, text: str) -> int:
            rows.append({"role": ROLES[NEW[q]], "text": text})
            return STEPS[q, NEW[q]]

        for s, n, (role, text) in zip(symbols, behind, kept, strict=True):
            letters, to = self.step(state, s, n)
            audit.append(letters)
            for letter in letters:
                if letter == "I":
                    state = new(state, "")
                elif letter == "R":
                    new(state, text)
                elif letter == "K":
                    rows.append({"role": role, "text": text})
            state = to
        while last and state not in ENDS:
            audit.append("I")
            state = new(state, "")
        return "".join(audit), rows


# Rows


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows with faults of a kind that crc32 of 'conv_id:turn' decides; a dropped row stays as one that is `gone`. Nulls in role and text are one space."""
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("fault") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"),
        (F.col("fault") == 0).alias("gone"),
        F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
    ).drop("copy")


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order over all partitions, written: part, at (their order), digest, blank, truncated."""
    rows = rows.select("conv_id", "turn", "role", "text", "gone", F.md5("text").alias("digest"), F.monotonically_increasing_id().alias("id"))
    order = ["conv_id", "turn", "role", "digest", "id"]  # nulls first; a hot conversation, and equal rows too, are cut anywhere
    told = F.rtrim("text", F.lit(BLANKS))
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("id")
    return materialize(
        rows.select(
            F.spark_partition_id().alias("part"),
            F.monotonically_increasing_id().alias("at"),
            *rows.columns,
            (told == "").alias("blank"),
            ((told != "") & ~F.substring(told, -1, 1).isin(".", "!", "?")).alias("truncated"),
        ),
        "conversation-rows",
    )


_SLIM = ("part", "at", "kind", "conv_id", "turn", "initial", "gone", "blank", "truncated")


def _symbols(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[tuple]:
    """(part, conv_id, turn, initial, fault, symbol, role and text, what is known of the piece) of each row; symbol None: gone. A duplicate's mark comes before its row."""
    marked = -1
    for batch in batches:
        columns = {name: batch.column(i).to_pylist() for i, name in enumerate(batch.schema.names)}
        known = [columns.get(c, [None] * batch.num_rows) for c in ("vector", "state", "last")]
        rows = zip(*(columns[c] for c in _SLIM), columns["role"] if texts else columns["part"], columns["text"] if texts else columns["part"], *known, strict=True)
        for part, at, kind, conv, turn, initial, gone, blank, truncated, role, text, *told in rows:
            if kind == 0:
                marked = at
                continue
            if gone:
                yield part, conv, turn, None, None, None, None, told
                continue
            fault = "blank" if blank else "duplicate" if at == marked else "truncated" if truncated else ""
            place = INITIALS.find(initial) if initial else -1
            symbol = 0 if fault in ("blank", "duplicate") else 1 + 2 * (place if place >= 0 else 3) + (fault == "truncated")
            yield part, conv, turn, initial, fault, symbol, (role, text), told


class _Piece:
    """The rows of a conversation in one partition: counts, symbols and what is kept of rows."""

    def __init__(self, part: int, conv, told: list):
        self.part, self.conv, self.told = part, conv, told
        self.symbols, self.kept = bytearray(), []
        self.faults = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.turns, self.first_turn, self.last_turn = 0, None, None
        self.illegal, self.first, self.last = 0, None, None

    def add(self, turn: int | None, initial: str, fault: str, symbol: int, kept: tuple | None) -> None:
        self.symbols.append(symbol)
        if kept is not None:
            self.kept.append(kept)
        if fault:
            self.faults[fault] += 1
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.first_turn = turn if self.first_turn is None else self.first_turn
            self.last_turn = turn
        if self.last is not None:
            self.illegal += not legal(self.last, initial)
        else:
            self.first = initial
        self.last = initial


def legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


def gaps(turns: int, first: int | None, last: int | None) -> int:
    return 0 if first is None else min(last - first + 1 - turns, (1 << 63) - 1)


def _pieces(batches: Iterator[pa.RecordBatch], texts: bool) -> Iterator[_Piece]:
    """The pieces of a partition that is sorted by part and at."""
    piece, key = None, None
    for part, conv, turn, initial, fault, symbol, kept, told in _symbols(batches, texts):
        if piece is None or (part, conv) != key:
            if piece is not None:
                yield piece
            piece, key = _Piece(part, conv, told), (part, conv)
        if symbol is not None:
            piece.add(turn, initial, fault, symbol, kept if texts else None)
    if piece is not None:
        yield piece


_COUNTS = {"gaps": "long", "blank": "long", "duplicate": "long", "truncated": "long", "illegal": "long", "cost": "long"}
_REPAIRED = "audit string, repaired array<struct<role:string,text:string>>"
_ARROW_ROWS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def _batched(rows: Iterator[tuple], schema: pa.Schema, most: int = ROWS, weight=None) -> Iterator[pa.RecordBatch]:
    """Record batches of so many rows, or of as many as 4 MB of weight allow."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += weight(row) if weight else 0
        if len(held) >= most or size > 4 << 20:
            yield _table(held, schema)
            held, size = [], 0
    if held:
        yield _table(held, schema)


def _weight(row: tuple) -> int:
    return sum(len(x["text"]) for x in row[-1])


def repair(rows: DataFrame) -> DataFrame:
    """conv_id, part, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired (role, text) of each conversation.

    rows: conv_id, turn, role, text (no nulls in the last two; an empty role counts as one of
    no known initial), and gone: rows that only tell that there is a conversation. A
    conversation's rows are ordered by turn, nulls first; those of one turn by role and by md5
    of the text. A conversation that lies in one partition gives one row; one that lies in
    several gives a row for each (its piece), in order of part: the counts are in the first of
    them and null in the others, audit and repaired are parts to be put together (see `digests`).

    A task holds a conversation's rows in its partition at most, so a conversation may have
    any number of rows. Equal rows after the first of them are duplicates, wherever they lie.
    A null conv_id is a conversation; null turns count for nothing in gaps. Conversations without
    rows have zeros, an empty audit and nothing repaired. An empty table gives no rows.
    """
    rows = _ordered(rows)
    there = rows.where("NOT gone AND NOT blank")
    firsts = materialize(there.groupBy("conv_id", "role", "digest").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "conversation-firsts")
    f = firsts.select(F.col("conv_id").alias("of"), F.col("role").alias("by"), F.col("digest").alias("like"), "first")
    slim = there.select("part", "at", "conv_id", "role", "digest")
    marks = slim.join(f, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("role") == F.col("by")) & (F.col("digest") == F.col("like"))).where("at > first").select("part", "at", "conv_id")
    # At most as many as there are bounds between partitions.
    spans = rows.groupBy("conv_id").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select(F.col("conv_id").alias("of"), "hi")
    initial = F.when(F.col("role") == "", " ").otherwise(F.substring("role", 1, 1)).alias("initial")
    stream = rows.select("part", "at", F.lit(1).alias("kind"), "conv_id", "turn", initial, "gone", "blank", "truncated", "role", "text")
    stream = stream.unionByName(marks.withColumn("kind", F.lit(0)), allowMissingColumns=True)
    stream = stream.join(F.broadcast(spans), F.col("conv_id").eqNullSafe(F.col("of")), "left").withColumn("spans", F.col("hi").isNotNull()).drop("of")
    kind = rows.schema["conv_id"].dataType.simpleString()
    out = f"conv_id {kind}, part int, {', '.join(f'{k} {v}' for k, v in _COUNTS.items())}, {_REPAIRED}"
    conv = pa.int64() if kind == "bigint" else None
    counts = [(k, pa.int64()) for k in _COUNTS]
    ids = conv or _arrow(rows, "conv_id")
    with arrow_batches(rows.sparkSession, ROWS):
        whole = _dealt(stream.where("NOT spans").drop("spans", "hi")).mapInArrow(_whole(ids, counts), out)
        whole = materialize(whole, "conversations")
        split = materialize(stream.where("spans").drop("spans"), "conversation-split")
        pieces = materialize(_split(split, ids, counts, kind, out), "conversation-pieces")
    discard(rows, firsts, split)
    return whole.unionByName(pieces)


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema[column].dataType)


def _dealt(stream: DataFrame) -> DataFrame:
    return stream.repartition("part").sortWithinPartitions("part", "at", "kind")


def _whole(ids: pa.DataType, counts: list):
    schema = pa.schema([("conv_id", ids), ("part", pa.int32()), *counts, ("audit", pa.string()), ("repaired", _ARROW_ROWS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def made() -> Iterator[tuple]:
            for p in _pieces(batches, True):
                number, cost = automaton.scan(p.symbols, automaton.end)
                cost += automaton.vectors[number][0]
                audit, rows = automaton.repaired(p.symbols, automaton.behind(p.symbols, automaton.end), 0, p.kept, True)
                yield p.conv, p.part, gaps(p.turns, p.first_turn, p.last_turn), *p.faults.values(), p.illegal, cost, audit, rows

        yield from _batched(made(), schema, weight=_weight)

    return run


# Conversations in several partitions

_MADE = "turns long, first_turn long, last_turn long, blank long, duplicate long, truncated long, illegal long, first string, last string, matrix array<long>, cost long"


def _split(split: DataFrame, ids: pa.DataType, counts: list, kind: str, out: str) -> DataFrame:
    """The pieces' rows: matrices first, then exits by state, then the edits. What pieces tell of themselves is a row for each, at most two a partition and the hot one's."""
    slim = split.select(*_SLIM)
    made = _dealt(slim).mapInArrow(_matrices(ids), f"conv_id {kind}, part int, {_MADE}")
    lists = made.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", *(c.split()[0] for c in _MADE.split(", "))))).alias("pieces"))
    told = f"conv_id {kind}, part int, {', '.join(f'{k} {v}' for k, v in _COUNTS.items())}, vector array<long>, last boolean"
    vectors = materialize(lists.mapInArrow(_vectors(ids, counts), told), "conversation-vectors")
    known = F.broadcast(vectors.select(F.col("conv_id").alias("of"), F.col("part").alias("p"), "vector", "last"))
    on = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("part") == F.col("p"))
    exits = _dealt(slim.join(known, on).drop("of", "p")).mapInArrow(_exits(ids), f"conv_id {kind}, part int, exits array<int>")
    lists = exits.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "exits"))).alias("pieces"))
    states = materialize(lists.mapInArrow(_states(ids), f"conv_id {kind}, part int, state int"), "conversation-states")
    known = states.join(vectors.select("part", F.col("conv_id").alias("of"), "vector", "last"), ["part"]).where(F.col("conv_id").eqNullSafe(F.col("of"))).select("of", F.col("part").alias("p"), "vector", "state", "last")
    edits = _dealt(split.drop("hi").join(F.broadcast(known), on).drop("of", "p")).mapInArrow(_edits(ids), f"conv_id {kind}, part int, {_REPAIRED}")
    found = vectors.select(F.col("conv_id").alias("of"), F.col("part").alias("p"), *_COUNTS)
    return edits.join(F.broadcast(found), on).select(*(c.split()[0] for c in out.split(", ", 2)[:2]), *_COUNTS, "audit", "repaired")


def _matrices(ids: pa.DataType):
    n, s = pa.int64(), pa.string()
    schema = pa.schema([("conv_id", ids), ("part", pa.int32()), *((c, n) for c in ("turns", "first_turn", "last_turn", "blank", "duplicate", "truncated", "illegal")), ("first", s), ("last", s), ("matrix", pa.list_(n)), ("cost", n)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def made() -> Iterator[tuple]:
            for p in _pieces(batches, False):
                number, cost = automaton.scan(p.symbols, automaton.unit)
                yield p.conv, p.part, p.turns, p.first_turn, p.last_turn, *p.faults.values(), p.illegal, p.first, p.last, list(automaton.vectors[number]), cost

        yield from _batched(made(), schema)

    return run


def _lists(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)


def _vectors(ids: pa.DataType, counts: list):
    """From the last piece to the first: the costs to the end behind each, and all counts."""
    schema = pa.schema([("conv_id", ids), ("part", pa.int32()), *counts, ("vector", pa.list_(pa.int64())), ("last", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, pieces in _lists(batches):
                v, cost, out = list(Automaton().vectors[0]), 0, []
                for p in reversed(pieces):
                    out.append([p["part"], v, not out])
                    m = p["matrix"]  # four vectors, one for each state behind the piece
                    before = [min(m[4 * x + q] + v[x] for x in range(4)) for q in range(4)]
                    cost += p["cost"] + min(before)
                    v = [c - min(before) for c in before]
                cost += v[0]
                turns, first, last, illegal, role = 0, None, None, 0, None
                for p in pieces:
                    if p["first"] is not None:
                        illegal += p["illegal"] + (role is not None and not legal(role, p["first"]))
                        role = p["last"]
                    if p["first_turn"] is not None:
                        turns += p["turns"] - (last == p["first_turn"])
                        first = p["first_turn"] if first is None else first
                        last = p["last_turn"]
                found = (gaps(turns, first, last), *(sum(p[c] for p in pieces) for c in ("blank", "duplicate", "truncated")), illegal, cost)
                for k, (part, vector, ends) in enumerate(reversed(out)):
                    yield conv, part, *(found if not k else (None,) * 6), vector, ends

        yield from _batched(made(), schema)

    return run


def _known(automaton: Automaton, p: _Piece) -> list[int]:
    return automaton.behind(p.symbols, automaton.number(p.told[0])[0])


def _exits(ids: pa.DataType):
    schema = pa.schema([("conv_id", ids), ("part", pa.int32()), ("exits", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def made() -> Iterator[tuple]:
            for p in _pieces(batches, False):
                behind = _known(automaton, p)
                yield p.conv, p.part, [automaton.exit(p.symbols, behind, q) for q in range(4)]

        yield from _batched(made(), schema)

    return run


def _states(ids: pa.DataType):
    schema = pa.schema([("conv_id", ids), ("part", pa.int32()), ("state", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            for conv, pieces in _lists(batches):
                state = 0
                for p in pieces:
                    yield conv, p["part"], state
                    state = p["exits"][state]

        yield from _batched(made(), schema)

    return run


def _edits(ids: pa.DataType):
    schema = pa.schema([("conv_id", ids), ("part", pa.int32()), ("audit", pa.string()), ("repaired", _ARROW_ROWS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()

        def made() -> Iterator[tuple]:
            for p in _pieces(batches, True):
                audit, rows = automaton.repaired(p.symbols, _known(automaton, p), p.told[1], p.kept, p.told[2])
                yield p.conv, p.part, audit, rows

        yield from _batched(made(), schema, most=64, weight=_weight)

    return run


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, counts, audit, repaired_sha256 of each conversation of `repair`.

    The digest is of the repaired rows as role:text, a line each. One that lies in several
    pieces is hashed as they come in order: SHA-256 can't be put together from parts, so
    its text goes through one task, which holds a batch of it.
    """
    lines = F.array_join(F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"])), "\n")
    kind = repaired.schema["conv_id"].dataType.simpleString()
    ids = _arrow(repaired, "conv_id")
    pieces = repaired.select("conv_id", "part", *_COUNTS, "audit", F.size("repaired").alias("n"), lines.alias("lines"))
    several = repaired.groupBy(F.col("conv_id").alias("of")).agg(F.count("*").alias("pieces")).where("pieces > 1")
    pieces = pieces.join(F.broadcast(several), F.col("conv_id").eqNullSafe(F.col("of")), "left")  # as few as bounds between partitions
    whole = pieces.where("pieces IS NULL").select("conv_id", *_COUNTS, "audit", F.sha2("lines", 256).alias("repaired_sha256"))
    schema = pa.schema([("conv_id", ids), *((c, pa.int64()) for c in _COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made() -> Iterator[tuple]:
            conv, found, audit, digest, begun = None, None, [], None, False
            for batch in batches:
                columns = [batch.column(c) for c in range(batch.num_columns)]
                for k in range(batch.num_rows):
                    row = [c[k].as_py() for c in columns]
                    if digest is None or row[0] != conv:
                        if digest is not None:
                            yield conv, *found, "".join(audit), digest.hexdigest()
                        conv, found, audit, digest, begun = row[0], row[2:8], [], hashlib.sha256(), False
                    audit.append(row[8])
                    if row[9]:
                        digest.update((b"\n" if begun else b"") + row[10].encode())
                        begun = True
            if digest is not None:
                yield conv, *found, "".join(audit), digest.hexdigest()

        yield from _batched(made(), schema)

    order = pieces.where("pieces > 1").drop("of", "pieces").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    parted = order.mapInArrow(run, f"conv_id {kind}, {', '.join(f'{k} {v}' for k, v in _COUNTS.items())}, audit string, repaired_sha256 string")
    return whole.unionByName(parted)
