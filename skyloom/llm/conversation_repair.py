"""Conversation structure repair by Four-Russians block tables.

A conversation shall read ``(s?(ua)+)?`` by the initials of its roles: perhaps a system row, then
user and assistant in turns. Rows are kept, given another role or deleted, and empty ones may be
inserted, at least cost. The cheapest cost from a row on depends on four states only (nothing yet,
after system, after user, after assistant); less its minimum it is one of a few vectors. For every
block of ``BLOCK`` row symbols and every vector a table holds the vector before the block and the
cost between. A conversation is looked up block by block from its end; then the blocks are expanded
from their right borders, and the first edit in ASCII order that keeps the least cost is taken,
so that ties go to the least text of edits.

Conversations stream through a task in order; what is held of one is a byte or two for each row.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyloom.llm.common import column
from skyloom.storage import stage

BLOCK = 4
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\f\r"
LEGAL = ("su", "ua", "au")

_FAR = 10**6
#: State after a row of the class (system, user, assistant, other), from each state.
_KEPT = ((1, None, None, None), (2, 2, None, 2), (None, None, 3, None), (None,) * 4)
#: State after the one role that may be written in each state, and that role.
_NEXT, _ROLE = (2, 2, 3, 2), ("user", "user", "assistant", "user")
#: Symbols: 0 must go; 1 + class for a sound row; 5 + class for a truncated one.
GO, SYMBOLS = 0, 9
FAULTS = ("", "blank", "duplicate", "truncated")


def symbol(initial: str, fault: int) -> int:
    if fault in (1, 2):
        return GO
    return (5 if fault == 3 else 1) + ("sua".find(initial) if initial and initial in "sua" else 3)


def _closed(costs: list[int]) -> tuple[int, ...]:
    for _ in range(3):
        costs = [min(c, INSERT + costs[_NEXT[s]]) for s, c in enumerate(costs)]
    return tuple(costs)


_END = _closed([0, _FAR, _FAR, 0])


def step(after: tuple[int, ...], sym: int) -> tuple[int, ...]:
    """The costs before a row from those after it."""
    out = []
    for s in range(4):
        best = DELETE + after[s]
        if sym != GO:
            extra, kind = (TRUNCATED if sym >= 5 else 0), (sym - 1) % 4
            best = min(best, REROLE + extra + after[_NEXT[s]])
            if _KEPT[kind][s] is not None:
                best = min(best, extra + after[_KEPT[kind][s]])
        out.append(best)
    return _closed(out)


class Tables:
    """Transitions of the normalised vectors over blocks of 1 to ``BLOCK`` symbols."""

    def __init__(self, block: int = BLOCK):
        self.block = block
        vectors, number, moves, costs = [_END], {_END: 0}, [], []
        for vector in vectors:
            row, add = [], []
            for sym in range(SYMBOLS):
                before = step(vector, sym)
                low = min(before)
                before = tuple(c - low for c in before)
                if before not in number:
                    number[before] = len(vectors)
                    vectors.append(before)
                row.append(number[before])
                add.append(low)
            moves.append(row)
            costs.append(add)
        self.vectors = vectors
        # A block's code has its first symbol as the lowest digit; the last one is met first.
        self.move, self.cost = [None, np.array(moves)], [None, np.array(costs)]
        for _ in range(block - 1):
            move, cost = self.move[-1], self.cost[-1]
            self.move.append(self.move[1][move].reshape(len(vectors), -1))
            self.cost.append((cost[:, :, None] + self.cost[1][move]).reshape(len(vectors), -1))
        self.traces: dict[tuple, tuple[str, int]] = {}

    def code(self, symbols: bytes) -> int:
        out = 0
        for sym in reversed(symbols):
            out = out * SYMBOLS + sym
        return out

    def trace(self, state: int, symbols: bytes, vector: int) -> tuple[str, int]:
        """Edits of a block and the state after it, given the vector at its right border."""
        key = (state, symbols, vector)
        if key not in self.traces:
            after = [self.vectors[vector]]
            raw = []
            for sym in reversed(symbols):
                raw.append(step(after[-1], sym))
                low = min(raw[-1])
                after.append(tuple(c - low for c in raw[-1]))
            out = []
            for at, sym in enumerate(symbols):
                here, then = raw[len(symbols) - 1 - at], after[len(symbols) - 1 - at]
                while True:
                    extra, kind = (TRUNCATED if sym >= 5 else 0), (sym - 1) % 4
                    if DELETE + then[state] == here[state]:
                        out.append("D")
                    elif INSERT + here[_NEXT[state]] == here[state]:
                        out.append("I")
                        state = _NEXT[state]
                        continue
                    elif _KEPT[kind][state] is not None and extra + then[_KEPT[kind][state]] == here[state]:
                        out.append("K")
                        state = _KEPT[kind][state]
                    else:
                        out.append("R")
                        state = _NEXT[state]
                    break
            self.traces[key] = "".join(out), state
        return self.traces[key]

    def repair(self, symbols: bytes) -> tuple[int, str]:
        """Least cost, and the least of the cheapest texts of edits."""
        starts = range(len(symbols) % self.block, len(symbols) + 1, self.block)
        cuts = [*([0] if starts[0] else []), *starts]
        vector, cost, borders = 0, 0, array("H", [0])
        for first, last in zip(reversed(cuts[:-1]), reversed(cuts[1:]), strict=True):
            code, size = self.code(symbols[first:last]), last - first
            cost += int(self.cost[size][vector, code])
            vector = int(self.move[size][vector, code])
            borders.append(vector)
        cost += self.vectors[vector][0]
        state, edits = 0, []
        for k, (first, last) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            text, state = self.trace(state, symbols[first:last], borders[len(borders) - 2 - k])
            edits.append(text)
        while state in (1, 2):
            edits.append("I")
            state = _NEXT[state]
        return cost, "".join(edits)


@lru_cache(maxsize=1)
def tables() -> Tables:
    return Tables()


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: by crc32 of ``conv_id:turn`` modulo 20, 0 drops a row
    (no copies), 1 empties its text, 2 takes ``.!?`` out, 3 repeats it, 4 makes it a user's. A
    null is one space, in the checksum too."""
    space = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    return conversations.select(
        "conv_id",
        "turn",
        F.when(kind == 4, "user").otherwise(space("role")).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.translate(space("text"), ".!?", "")).otherwise(space("text")).alias("text"),
        F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def keyed(rows: DataFrame) -> DataFrame:
    """Rows with ``message``, the digest of role and text, which stands for them in all but the last pass."""
    whole = F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text")
    return rows.select("conv_id", "turn", "role", "text", "copies", F.unhex(F.sha2(whole.cast("binary"), 256)).alias("message"))


def marked(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, message, copies, fault of ``keyed`` rows, stored, without their texts.

    A message's first turn is an aggregate by (conversation, digest), which a conversation of many
    rows is spread over. Of rows that are equal the first is told from the others in ``audits``.
    """
    body = F.rtrim("text", F.lit(BLANKS))
    state = F.when(F.length(body) == 0, 1).when(~F.substring(body, -1, 1).isin(".", "!", "?"), 3).otherwise(0)
    slim = stage(rows.select("conv_id", "turn", "role", "message", "copies", state.alias("state")), "conversation-rows")
    place = F.struct(F.col("turn").isNotNull(), "turn")
    first = (
        slim.filter("copies > 0").groupBy("conv_id", "message").agg(F.min(place).alias("first"))
        .select(F.col("conv_id").alias("of"), F.col("message").alias("first_message"), "first")
    )
    fault = F.when(F.col("state") == 1, 1).when(F.col("first") < place, 2).otherwise(F.col("state"))
    same = F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("message") == F.col("first_message"))
    found = slim.join(first, same, "left")
    return stage(found.select("conv_id", "turn", "role", "message", "copies", fault.alias("fault")), "conversation-faults")


_AUDIT = (("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()),
          ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string()))


class _Conversation:
    def __init__(self, conv_id):
        self.conv_id, self.symbols, self.faults, self.illegal = conv_id, bytearray(), [0] * 4, 0
        self.last, self.low, self.high, self.turns = None, None, None, 0
        self.before = None

    def add(self, turn, initial, message, fault, copies):
        if not copies:
            return
        if (turn, message) == self.before and fault != 1:
            fault = 2  # equal rows lie beside each other
        self.before = turn, message
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.faults[fault] += 1
        self.faults[1 if fault == 1 else 2] += copies - 1
        self.symbols.append(symbol(initial, fault))
        self.symbols.extend(bytes(copies - 1))
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.illegal += (copies - 1) * (initial + initial not in LEGAL)
        self.last = initial

    def row(self):
        cost, audit = tables().repair(bytes(self.symbols))
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults[1:], self.illegal, cost, audit)


def _flushed(kind: pa.DataType, ids: list, names: list, rows: list) -> pa.RecordBatch:
    columns = [pa.array([r[k] for r in rows], t) for k, (_, t) in enumerate(names)]
    return pa.RecordBatch.from_arrays([pa.array(ids, kind), *columns], names=["conv_id", *[n for n, _ in names]])


def _id_type(batch: pa.RecordBatch) -> pa.DataType:
    return batch.schema.field("conv_id").type


def _audits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, ids, rows, size, kind = None, [], [], 0, None
    for batch in batches:
        kind = _id_type(batch)
        fields = (column(batch, n) for n in ("conv_id", "turn", "initial", "message", "fault", "copies"))
        for conv_id, *row in zip(*fields, strict=True):
            if now is None or now.conv_id != conv_id:
                if now is not None:
                    ids.append(now.conv_id)
                    rows.append(now.row())
                    size += len(rows[-1][-1]) + 50
                now = _Conversation(conv_id)
                if size > 1_000_000:
                    yield _flushed(kind, ids, _AUDIT, rows)
                    ids, rows, size = [], [], 0
            now.add(*row)
    if now is not None:
        yield _flushed(kind, [*ids, now.conv_id], _AUDIT, [*rows, now.row()])


def audits(faults: DataFrame) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit of each conversation of
    ``marked`` rows."""
    kind = faults.schema["conv_id"].dataType.simpleString()
    ordered = faults.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "message")
    fields = ordered.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "message", "fault", "copies")
    schema = f"conv_id {kind}, " + ", ".join(f"{n} {'string' if n == 'audit' else 'long'}" for n, _ in _AUDIT)
    return fields.mapInArrow(_audits, schema)


def _edited(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch's id type, conversation, role, text, edit) of each edit in order; role and text are
    None at the start of a conversation, where the edit is None too."""
    audit, at, state = "", 0, 0
    for batch in batches:
        kind = _id_type(batch)
        fields = (column(batch, n) for n in ("conv_id", "is_row", "role", "text", "copies"))
        for conv_id, is_row, role, text, copies in zip(*fields, strict=True):
            if not is_row:
                audit, at, state = text, 0, 0
                yield kind, conv_id, None, None, None
            for k in range(copies + 1):
                while audit[at : at + 1] == "I":  # before the first row, or after each
                    yield kind, conv_id, _ROLE[state], "", "I"
                    state, at = _NEXT[state], at + 1
                if k == copies:
                    break
                edit, at = audit[at], at + 1
                new = _ROLE[state] if edit == "R" else role
                if edit != "D":
                    state = _NEXT[state] if edit == "R" else _KEPT["sua".index(role[0])][state]
                yield kind, conv_id, new, text, edit


def _led(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Each conversation's text of edits, then its rows in order. This alone shuffles texts."""
    every = rows.select("conv_id", F.lit(True).alias("is_row"), "turn", "role", "message", "text", "copies")
    none = lambda name: F.lit(None).cast(rows.schema[name].dataType).alias(name)
    lead = found.select(
        "conv_id", F.lit(False).alias("is_row"), none("turn"), none("role"), none("message"), F.col("audit").alias("text"),
        F.lit(0).cast("long").alias("copies"),
    )
    return every.unionByName(lead).repartition("conv_id").sortWithinPartitions("conv_id", "is_row", "turn", "role", "message")


_ROWS = (("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string()))


def _repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, rows, size, place = [], [], 0, 0
    for kind, conv_id, role, text, edit in _edited(batches):
        place = 0 if edit is None else place
        if edit in (None, "D"):
            continue
        ids.append(conv_id)
        rows.append((place, role, text, edit))
        place += 1
        size += len(text) + 50
        if size > 1_000_000:
            yield _flushed(kind, ids, _ROWS, rows)
            ids, rows, size = [], [], 0
    if ids:
        yield _flushed(kind, ids, _ROWS, rows)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    ids, rows, now, first = [], [], None, True
    for kind, conv_id, role, text, edit in _edited(batches):
        if edit is None:
            if now is not None:
                rows.append((now.hexdigest(),))
            if len(rows) >= 10_000:
                yield _flushed(kind, ids, [("repaired_sha256", pa.string())], rows)
                ids, rows = [], []
            ids.append(conv_id)
            now, first = hashlib.sha256(), True
        elif edit != "D":
            now.update(f"{'' if first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
            first = False
    if now is not None:
        yield _flushed(kind, ids, [("repaired_sha256", pa.string())], [*rows, (now.hexdigest(),)])


def repaired_rows(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, place, role, text, edit (K, R or I) of the rows of the repaired conversations."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _led(rows, found).mapInArrow(_repaired, f"conv_id {kind}, place long, role string, text string, edit string")


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, repaired_sha256: hash of the repaired rows as ``role:text``, joined by newlines."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    return _led(rows, found).mapInArrow(_digests, f"conv_id {kind}, repaired_sha256 string")


def repair(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(``keyed`` rows, their ``audits``) of rows with conv_id, turn, role, text, copies.

    Rows of a conversation go by turn (nulls first), then role, then the digest of role and text. A
    conversation whose rows have no copies has zeros and an empty audit. A null conv_id is a
    conversation as well. Role and text must not be null (``damage`` makes them a space); an empty
    role has no initial and is never legal. Very long conversations and texts pass through row by
    row; an audit is one text and so has the length that one value may have. Columns of other
    names are ignored.
    """
    rows = keyed(rows)
    return rows, stage(audits(marked(rows)), "conversation-audits")


def repair_report(conversations: DataFrame) -> DataFrame:
    """The audit and the repaired conversation's digest for every conversation, after damage."""
    rows, found = repair(damage(conversations))
    hashed = digests(rows, found).withColumnRenamed("conv_id", "of")
    return found.join(hashed, found["conv_id"].eqNullSafe(hashed["of"])).drop("of")
