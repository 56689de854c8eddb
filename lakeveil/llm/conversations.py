"""Repair of the role order of conversations, by Hirschberg's divide and conquer.

A repaired conversation has role initials ``(s?(ua)+)?``: an automaton of four states (nothing yet, after s, after
u, after a). Every row is kept, given another role or deleted, with insertions before it; the cheapest edits win, and of
equally cheap ones those whose initials (D, I, K, R) come first in ASCII order.

The half before the middle gives a vector of four costs forwards, the half after it one backwards; where they meet, the
states whose sum is least are the optimal crossings. The left half is solved towards that set, which tells the audit-least crossing
of them, then the right half from there. Memory is linear in the rows; no table of states by row is held.

Conversations up to ``ROWS`` rows and ``BYTES`` bytes are solved where their rows come together. A longer one is cut by
range into pieces, one for each partition it lies in. A piece gives its costs from each state to each state and which of its audits from one state
comes first; these meet along the conversation, at most one a partition, and tell each piece its crossing
states, so that the pieces are solved apart. Rows equal in all columns are one row with a count there.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .checkpoints import durable

INSERT, REROLE, DELETE, TRUNCATED = 3, 3, 4, 3
#: The largest conversation that one task holds.
ROWS, BYTES = 20_000, 8 << 20
#: Names of long conversations are broadcast up to this number, and joined beyond it.
FEW = 100_000
INF = 1 << 60
SPACE = " \t\n\x0b\x0c\r"
#: States: 0 nothing yet, 1 after s, 2 after u, 3 after a. What a kept role leads to, and where an insertion or another role does.
KEEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
AFTER = (2, 2, 3, 2)
NAMES = ("user", "user", "assistant", "user")
#: What ends a conversation from each state, and its cost.
TAIL = ("", "II", "I", "")
END = tuple(INSERT * len(t) for t in TAIL)
INITIALS, MUST_GO = ("s", "u", "a", ""), 8


def _moves(code: int) -> list[list[tuple[int, int, str]]]:
    """From each state: exits, costs and audits of one row, the best for each exit. A row that must go is deleted
    at once: an insertion before it could as well follow it, and D comes before I."""
    if code == MUST_GO:
        return [[(q, DELETE, "D")] for q in range(4)]
    initial, cut = INITIALS[code % 4], TRUNCATED * (code // 4)
    table = []
    for q in range(4):
        best: dict[int, tuple[int, str]] = {}
        at, paid, letters = q, 0, ""
        for _ in range(3):  # two insertions reach every state; more only cost more
            options = [(at, DELETE, "D"), (AFTER[at], REROLE + cut, "R")]
            if (at, initial) in KEEPS:
                options.append((KEEPS[at, initial], cut, "K"))
            for to, cost, letter in options:
                best[to] = min(best.get(to, (INF, "")), (paid + cost, letters + letter))
            at, paid, letters = AFTER[at], paid + INSERT, letters + "I"
        table.append([(to, *found) for to, found in sorted(best.items())])
    return table


MOVES = [_moves(code) for code in range(MUST_GO + 1)]


def row_code(role: str, fault: str | None) -> int:
    """What matters of a row to its repair: its role's initial, and whether it is truncated or must go."""
    if fault in ("blank", "duplicate"):
        return MUST_GO
    return "sua".find(role[:1] or "?") % 4 + 4 * (fault == "truncated")


def fault_of(text: str, seen: bool) -> str | None:
    """The first fault of a row: blank, duplicate (``seen`` before) or truncated."""
    bare = text.rstrip(SPACE)
    if not bare:
        return "blank"
    return "duplicate" if seen else None if bare[-1] in ".!?" else "truncated"


def _forward(codes: bytes, extra: list[int] | None, lo: int, hi: int, costs: list[int]) -> list[int]:
    """Least costs by state after rows lo to hi, from costs before them. ``extra`` counts further equal rows, which are deleted."""
    for k in range(lo, hi):
        found = [INF] * 4
        for q, before in enumerate(costs):
            if before < INF:
                for to, cost, _ in MOVES[codes[k]][q]:
                    if before + cost < found[to]:
                        found[to] = before + cost
        costs = [c + DELETE * extra[k] if c < INF else c for c in found] if extra else found
    return costs


def _backward(codes: bytes, extra: list[int] | None, lo: int, hi: int, costs: list[int]) -> list[int]:
    """Least costs by state before rows lo to hi, to costs after them."""
    for k in range(hi - 1, lo - 1, -1):
        costs = [min(cost + costs[to] for to, cost, _ in moves) for moves in MOVES[codes[k]]]
        if extra:
            costs = [c + DELETE * extra[k] for c in costs]
    return costs


def _solve(codes: bytes, extra: list[int] | None, lo: int, hi: int, entry: int, end: list[int], out: list[str]) -> int:
    """Appends the audits of rows lo to hi, from state ``entry`` towards ``end`` costs, and returns the state after them."""
    if hi - lo == 1:
        _, letters, to = min((cost + end[to], letters, to) for to, cost, letters in MOVES[codes[lo]][entry])
        out.append(letters + "D" * (extra[lo] if extra else 0))
        return to
    mid = (lo + hi) // 2
    there = _forward(codes, extra, lo, mid, [0 if q == entry else INF for q in range(4)])
    back = _backward(codes, extra, mid, hi, end)
    least = min(a + b for a, b in zip(there, back))
    crossing = [b if a + b == least else INF for a, b in zip(there, back)]
    at = _solve(codes, extra, lo, mid, entry, crossing, out)
    return _solve(codes, extra, mid, hi, at, end, out)


@lru_cache(1 << 14)
def _short(codes: bytes) -> tuple[str, ...]:
    return tuple(_audits(codes))


def _audits(codes: bytes, extra: list[int] | None = None, entry: int = 0, end: Iterable[int] = END) -> list[str]:
    out: list[str] = []
    if codes:
        _solve(codes, extra, 0, len(codes), entry, list(end), out)
    return out


def audits(codes: bytes) -> list[str]:
    """The audit of each row of a whole conversation; what follows the last row is ``TAIL`` of the state reached."""
    return list(_short(codes)) if len(codes) <= 32 else _audits(codes)


def piece_costs(codes: bytes, extra: list[int]) -> tuple[list[int], list[int]]:
    """Of a piece, by entry and exit state (16 each): the least cost, and the place in ASCII order of its audit
    among those from the same entry. Audits of as many rows are never prefixes of each other, so the earlier rows decide first."""
    costs, ranks = [], []
    for entry in range(4):
        cost, rank = [0 if q == entry else INF for q in range(4)], [0] * 4
        for k, code in enumerate(codes):
            found: list[tuple] = [(INF, 0, "")] * 4
            for q in range(4):
                if cost[q] < INF:
                    for to, c, letters in MOVES[code][q]:
                        found[to] = min(found[to], (cost[q] + c + DELETE * extra[k], rank[q], letters))
            cost = [f[0] for f in found]
            places = sorted((f[1:], q) for q, f in enumerate(found))
            for place, (_, q) in enumerate(places):
                rank[q] = place
        costs += cost
        ranks += rank
    return costs, ranks


def crossings(pieces: list[tuple[list[int], list[int]]]) -> list[tuple[int, int]]:
    """The entry and exit state of each piece of a conversation, from the pieces' costs and ranks in order."""
    back, picks = list(END), []
    for costs, ranks in reversed(pieces):
        best = [min((costs[4 * q + to] + back[to], ranks[4 * q + to], to) for to in range(4)) for q in range(4)]
        picks.append([b[2] for b in best])
        back = [min(b[0], INF) for b in best]
    at, out = 0, []
    for pick in reversed(picks):
        out.append((at, pick[at]))
        at = pick[at]
    return out


FIELDS = "at bigint, edit string, turn bigint, role string, fault string, new_role string, text string, times bigint"


def _edits(at: int, letters: str, state: int, turn: int | None, role: str, text: str, fault: str | None, n: int) -> tuple[list[tuple], int]:
    """The edits of one row and its n - 1 equals, and the state after them. A row's own edit is the last letter that is no D of its equals."""
    out = []
    own = letters[: len(letters) - (n - 1)]
    for letter in own:
        to = AFTER[state] if letter in "IR" else KEEPS.get((state, role[:1]), state) if letter == "K" else state
        new = NAMES[state] if letter in "IR" else role if letter == "K" else None
        inserted = letter == "I"
        out.append((at, letter, None if inserted else turn, None if inserted else role, None if inserted else fault, new, "" if inserted else text if new is not None else None, 1))
        state = to
    if n > 1:
        out.append((at, "D", turn, role, fault if fault == "blank" else "duplicate", None, None, n - 1))
    return out, state


def _tail(at: int, state: int) -> list[tuple]:
    states = (state, AFTER[state])
    return [(at, "I", None, None, None, NAMES[q], "", 1) for q in states[: len(TAIL[state])]]


def _batch(held: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], schema.field(k).type) for k in range(len(schema))], schema=schema)


def _kinds(conv: pa.DataType, fields: str) -> pa.Schema:
    known = {"bigint": pa.int64(), "string": pa.string(), "int": pa.int32(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64()), "array<int>": pa.list_(pa.int32())}
    pairs = [f.split(" ") for f in fields.split(", ")]
    return pa.schema([("conv_id", conv), *((name, known[kind]) for name, kind in pairs)])


def _rows(batches: Iterator[pa.RecordBatch], step: int = 1000) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, step):
            yield from zip(*(c.slice(lo, step).to_pylist() for c in batch.columns))


def _whole(kind: str):
    """Edits of conversations whose rows (conv_id, gone, turn, role, text) come together and in order."""

    def repair(held: list[tuple]) -> Iterator[tuple]:
        conv, rows, seen, faults = held[0][0], [r for r in held if not r[1]], set(), []
        if not rows:
            yield (conv, 0, None, None, None, None, None, None, 0)
            return
        for _, _, _, role, text in rows:
            faults.append(fault_of(text, (role, text) in seen))
            seen.add((role, text))
        found, state = audits(bytes(row_code(r[3], f) for r, f in zip(rows, faults))), 0
        for at, (row, fault, letters) in enumerate(zip(rows, faults, found)):
            edits, state = _edits(at, letters, state, *row[2:], fault, 1)
            yield from ((conv, *e) for e in edits)
        yield from ((conv, *e) for e in _tail(len(rows), state))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        out: list[tuple] = []
        size, schema = 0, None
        for batch in batches:
            schema = schema or _kinds(batch.schema.field(0).type, FIELDS)
            for row in _rows(iter([batch])):
                if held and held[0][0] != row[0]:
                    for edit in repair(held):
                        out.append(edit)
                        size += len(edit[7] or "")
                    held = []
                    if len(out) >= 4000 or size > 4 << 20:
                        yield _batch(out, schema)
                        out, size = [], 0
                held.append(row)
        if held:
            out.extend(repair(held))
        if out:
            yield _batch(out, schema)

    return walk, f"conv_id {kind}, {FIELDS}"


PIECE = "first bigint, codes binary, extra array<bigint>, costs array<bigint>, ranks array<int>"


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of rows (conv_id, at, gone, role, fault, n) in order, one for each conversation of a partition."""
    schema, conv, first, codes, extra = None, None, None, bytearray(), []

    def piece() -> pa.RecordBatch:
        costs, ranks = piece_costs(bytes(codes), extra)
        return _batch([(conv, first, bytes(codes), extra, costs, ranks)], schema)

    for batch in batches:
        schema = schema or _kinds(batch.schema.field(0).type, PIECE)
        for own, at, gone, role, fault, n in _rows(iter([batch])):
            if first is not None and own != conv:
                yield piece()
                first, codes, extra = None, bytearray(), []
            if gone:
                continue
            if first is None:
                conv, first = own, at
            codes.append(row_code(role, fault))
            extra.append(n - 1)
    if first is not None:
        yield piece()


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Entry and exit states of the pieces of conversations given as lists of struct<first, costs, ranks>; the last piece is told."""
    for batch in batches:
        schema = _kinds(batch.schema.field(0).type, "first bigint, entry int, exit int, last int")
        for conv, pieces in _rows(iter([batch]), 10):
            states = crossings([(p["costs"], p["ranks"]) for p in pieces])
            yield _batch([(conv, p["first"], *s, int(k == len(pieces) - 1)) for k, (p, s) in enumerate(zip(pieces, states))], schema)


def _told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The audit of each row of pieces, the state before it, and of a conversation's last row the state after it (else null)."""
    schema = pa.schema([("at", pa.int64()), ("letters", pa.string()), ("state", pa.int32()), ("ends", pa.int32())])
    for batch in batches:
        for first, codes, extra, entry, leave, last in _rows(iter([batch]), 1):
            found = _audits(codes, extra, entry, [0 if q == leave else INF for q in range(4)])
            rows, state = [], entry
            for k, letters in enumerate(found):
                rows.append((first + k, letters, state, None))
                for letter in letters[: len(letters) - extra[k]]:
                    state = AFTER[state] if letter in "IR" else KEEPS[state, INITIALS[codes[k] % 4]] if letter == "K" else state
            if last:
                rows[-1] = (*rows[-1][:3], state)
            for lo in range(0, len(rows), 4000):
                yield _batch(rows[lo : lo + 4000], schema)


def _spread(kind: str):
    """Edits of rows (conv_id, at, gone, turn, role, text, fault, n, letters, state, ends)."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema, out, size = _kinds(batch.schema.field(0).type, FIELDS), [], 0
            for conv, at, gone, turn, role, text, fault, n, letters, state, ends in _rows(iter([batch])):
                edits = [(at, None, None, None, None, None, None, 0)] if gone else _edits(at, letters, state, turn, role, text, fault, n)[0]
                out += [(conv, *e) for e in edits + (_tail(at, ends) if ends is not None else [])]
                size += len(text or "")
                if len(out) >= 4000 or size > 4 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
            if out:
                yield _batch(out, schema)

    return walk, f"conv_id {kind}, {FIELDS}"


def damage(conversations: DataFrame) -> DataFrame:
    """conv_id, gone, turn, role and text of rows damaged by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row (it stays as a
    mark, ``gone``, without turn, role and text), 1 empties its text, 2 removes its ``[.!?]``, 3 repeats it, 4 makes it the user's.

    Nulls of conv_id and turn count as one space in the key, those of role and text become one space; other columns are left out."""
    blank = F.lit(" ")
    part = lambda c: F.coalesce(F.col(c).cast("string"), blank)
    kind = F.crc32(F.concat(part("conv_id"), F.lit(":"), part("turn"))) % 20
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), part("role").alias("role"), part("text").alias("text"), kind.alias("kind"))
    gone = F.col("kind") == 0
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    here = lambda c: F.when(~gone, c)
    rows = rows.withColumn("again", F.explode(F.sequence(F.lit(0), (F.col("kind") == 3).cast("int"))))
    return rows.select("conv_id", gone.alias("gone"), here(F.col("turn")).alias("turn"), here(role).alias("role"), here(text).alias("text"))


def _fault(text: Column, seen: Column) -> Column:
    bare = F.rtrim(F.translate(text, SPACE[1:], " " * (len(SPACE) - 1)))
    return F.when(bare == "", "blank").when(seen, "duplicate").when(~F.right(bare, F.lit(1)).isin(".", "!", "?"), "truncated")


def _long_edits(rows: DataFrame) -> DataFrame:
    """Edits of conversations that no task should hold, in no order."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    same = rows.groupBy("conv_id", "gone", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    place = F.struct(F.col("turn").isNotNull().alias("told"), F.col("turn").alias("turn"))
    firsts = same.where("not gone").groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("text").alias("t")).agg(F.min(place).alias("first"))
    joined = same.join(firsts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("text") == F.col("t")), "left")
    joined = joined.select("conv_id", "gone", "turn", "role", "text", "n", F.when(~F.col("gone"), _fault(F.col("text"), ~F.col("turn").eqNullSafe(F.col("first.turn")))).alias("fault"))
    ranged = joined.repartitionByRange("conv_id", "gone", "turn", F.left("role", F.lit(16)), F.left("text", F.lit(64)))
    ranged = durable(ranged.sortWithinPartitions("conv_id", "gone", "turn", "role", "text").withColumn("at", F.monotonically_increasing_id()))
    pieces = durable(ranged.select("conv_id", "at", "gone", "role", "fault", "n").mapInArrow(_cut, f"conv_id {kind}, {PIECE}"))
    lists = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("first", "costs", "ranks"))).alias("pieces"))  # one a partition at most
    states = lists.mapInArrow(_met, f"conv_id {kind}, first bigint, entry int, exit int, last int").drop("conv_id")
    told = pieces.join(states, "first").select("first", "codes", "extra", "entry", "exit", "last")
    told = told.mapInArrow(_told, "at bigint, letters string, state int, ends int")
    return ranged.join(told, "at", "left").select("conv_id", "at", "gone", "turn", "role", "text", "fault", "n", "letters", "state", "ends").mapInArrow(*_spread(kind))


def _parts(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of conversations that a task can hold, and those of longer ones, None if there are none."""
    sizes = rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("rows"), F.sum(F.coalesce(F.octet_length("text"), F.lit(0))).alias("bytes"))
    long = durable(sizes.where((F.col("rows") > ROWS) | (F.col("bytes") > BYTES)).select(F.col("conv_id").alias("c")))
    n = long.count()
    if not n:
        return rows, None
    names = F.broadcast(long) if n <= FEW else long
    same = F.col("conv_id").eqNullSafe(F.col("c"))
    return rows.join(names, same, "left_anti"), rows.join(names, same, "left_semi")


def _together(rows: DataFrame) -> DataFrame:
    kind = rows.schema["conv_id"].dataType.simpleString()
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(*_whole(kind))


def _in_order(edits: DataFrame) -> DataFrame:
    """Edits of one row keep their order: insertions, the row's own, those of its equals; so do a conversation's last insertions."""
    return edits.withColumn("__k", F.monotonically_increasing_id()).repartition("conv_id").sortWithinPartitions("conv_id", "at", "__k").drop("__k")


def repair(rows: DataFrame) -> DataFrame:
    """The edits of every conversation of ``rows`` (conv_id, gone, turn, role, text, as ``damage`` gives them): conv_id, at (order in the conversation),
    edit (D, I, K or R), the row's turn, role and fault, new_role and text (null where deleted), times (how many equal rows an edit stands for).

    Rows come by turn, nulls first, then by role and text, so that ties have one order; of equal rows all but the first are
    duplicates. Rows of a null conv_id are one conversation. A conversation that lost all rows has one edit of null letter and 0 times."""
    near, far = _parts(rows)
    return _together(near) if far is None else _together(near).unionByName(_long_edits(far))


REPORT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
PRICE = {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}


class _Summary:
    """What the edits of one conversation, told in order, come to. Texts are hashed as they come and not held."""

    def __init__(self, conv) -> None:
        self.conv, self.letters, self.counts, self.cost, self.illegal = conv, [], dict.fromkeys(("blank", "duplicate", "truncated"), 0), 0, 0
        self.sha, self.any, self.last, self.low, self.high, self.turns = hashlib.sha256(), False, None, None, None, 0

    def add(self, edit, turn, role, fault, new_role, text, times) -> None:
        if not times:
            return
        self.letters.append(edit * times)
        self.cost += times * (PRICE[edit] + (TRUNCATED if fault == "truncated" and edit in "KR" else 0))
        if fault:
            self.counts[fault] += times
        if edit != "I":
            initial = role[:1]
            legal = ("su", "ua", "au")
            self.illegal += (self.last is not None and self.last + initial not in legal) + (times - 1)
            self.last = initial
            if turn is not None and turn != self.high:
                self.low, self.high, self.turns = turn if self.low is None else self.low, turn, self.turns + 1
        if new_role is not None:
            self.sha.update(f"{chr(10) if self.any else ''}{new_role}:{text}".encode())
            self.any = True

    def row(self) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        return (self.conv, gaps, *self.counts.values(), self.illegal, self.cost, "".join(self.letters), self.sha.hexdigest())


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, schema, out, size = None, None, [], 0
    for batch in batches:
        schema = schema or _kinds(batch.schema.field(0).type, REPORT)
        for conv, _, edit, turn, role, fault, new_role, text, times in _rows(iter([batch])):
            if now is None or now.conv != conv:
                if now:
                    out.append(now.row())
                    size += len(out[-1][7])
                if len(out) >= 1000 or size > 4 << 20:
                    yield _batch(out, schema)
                    out, size = [], 0
                now = _Summary(conv)
            now.add(edit, turn, role, fault, new_role, text, times)
    if now:
        yield _batch([*out, now.row()], schema)


def report(rows: DataFrame) -> DataFrame:
    """One row for each conversation of ``rows`` (see ``repair``): conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256 (of the repaired ``role:text``, joined by newlines).

    The last two are one value of the whole conversation: a long one's are made by one task, which
    holds its audit and hashes its texts as they come. Nulls, ties and equal rows: see ``repair``; an empty table gives an empty table."""
    kind = rows.schema["conv_id"].dataType.simpleString()
    near, far = _parts(rows)
    told = _together(near).mapInArrow(_summaries, f"conv_id {kind}, {REPORT}")  # the edits come in order
    return told if far is None else told.unionByName(_in_order(_long_edits(far)).mapInArrow(_summaries, f"conv_id {kind}, {REPORT}"))
