"""Repair of conversation structure: the cheapest edits that make a conversation `system? (user assistant)+`.

A row is kept, given the role of user or assistant, or deleted (blank and duplicate rows always are), and empty rows may be put in anywhere. What
has been read leaves one of four states: nothing, after system, after user, after assistant. So any stretch of rows is four by four costs, and
stretches combine. Of equally cheap edits those with the ASCII-least initials win. Edits of a stretch end with the letter of its last row, hence
none is the beginning of another, and to compare two whole audits it is enough to know the order of their first parts.

Edits are found by Hirschberg's divide and conquer: the four-state costs of the first half, forward, and of the second half, backward,
meet in the middle; the state there is the cheapest, by the order of the first parts where several are; both halves are solved alike. That takes
space for two vectors besides the result. Vectors that differ by a constant act alike, so the few that exist are looked up.

A conversation may hold most of the table. Rows are dealt by ranges of (conversation, turn, ...), so it is spread over many tasks, and packed into
blocks of bounded rows and bytes. Each block becomes its four by four costs; blocks are the elements of the same divide and conquer one level
up, in a tree whose nodes have bounded children; its results are the states at the ends of each block, within which its rows are then solved. Only a
digest of a whole conversation reads its blocks in one task, one after the other, since a digest is sequential.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator, Sequence
from functools import lru_cache
from itertools import groupby
from math import inf

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import small_batches, stored

#: Most rows, and about the most UTF-8 bytes, of a block; range partitions below one node of the tree.
BLOCK_ROWS, BLOCK_BYTES, FAN = 256, 1 << 16, 64

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: Costs of the edits; an undeleted truncated row adds TRUNCATED.
COSTS, TRUNCATED = {KEEP: 0, REROLE: 2, DELETE: 3, INSERT: 2}, 1
#: States, and which state a role leads to from each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
_AFTER = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_ROLES = {USER: "user", ASSISTANT: "assistant"}
#: What is put in at the end from each state, so that the conversation is whole.
_CLOSING = {NOTHING: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}
#: A row's code: 0 has to be deleted, else 1 + 2 x initial + truncated; initials in this order, then all others.
INITIALS = "sua"

Vector = tuple[tuple[float, ...], tuple[int, ...]]
Table = tuple[tuple[tuple[float, ...], ...], tuple[tuple[int, ...], ...]]


def _put_in(state: int) -> int:
    """The state after an empty row, whose role the state before decides."""
    return ASSISTANT if state == USER else USER


def _row_edits(code: int) -> list[list[tuple[float, str]]]:
    """Of a row with that code: cheapest (cost, initials) between any two states."""
    best = [[(inf, "")] * 4 for _ in range(4)]
    for start in range(4):
        now = start
        for n in range(3):  # two empty rows lead from any state to any other
            ends = {}
            if code:
                initial, late = (INITIALS + "?")[(code - 1) // 2], TRUNCATED * ((code - 1) % 2)
                if now in _AFTER.get(initial, {}):
                    ends[KEEP] = (_AFTER[initial][now], late)
                ends[REROLE] = (_put_in(now), COSTS[REROLE] + late)
            ends[DELETE] = (now, COSTS[DELETE])
            for letter, (end, cost) in ends.items():
                best[start][end] = min(best[start][end], (cost + n * COSTS[INSERT], INSERT * n + letter))
            now = _put_in(now)
    return best


EDITS = [_row_edits(c) for c in range(9)]
CLOSING = tuple(float(len(_CLOSING[s]) * COSTS[INSERT]) for s in range(4))


def _table(best: list[list[tuple[float, str]]]) -> Table:
    """Costs and the order of the initials; what isn't reached comes last."""
    keys = [[x if c < inf else "~" for c, x in row] for row in best]
    return tuple(tuple(c for c, _ in row) for row in best), tuple(tuple(sorted(row).index(x) for x in row) for row in keys)


TABLES = [_table(e) for e in EDITS]


def _unit(state: int) -> tuple[float, ...]:
    return tuple(0 if s == state else inf for s in range(4))


def ahead(vector: Vector, table: Table) -> Vector:
    """Costs of the states, and the order of their initials, one element on."""
    costs, order = vector
    found = []
    for end in range(4):
        cost, rank, via = min((costs[s] + table[0][s][end], order[s], s) for s in range(4))
        found.append((cost, (rank, table[1][via][end]) if cost < inf else (4, 0)))  # what isn't reached comes last
    ranks = sorted(r for _, r in found)
    return tuple(c for c, _ in found), tuple(ranks.index(r) for _, r in found)


def behind(costs: tuple[float, ...], table: Table) -> tuple[float, ...]:
    """Costs from each state to the end, one element earlier."""
    return tuple(min(table[0][s][end] + costs[end] for end in range(4)) for s in range(4))


def _less(costs: tuple[float, ...]) -> tuple[float, tuple[float, ...]]:
    low = min(costs)
    return (low, tuple(c - low for c in costs)) if low < inf else (0, costs)


@lru_cache(1 << 16)
def _row_ahead(vector: Vector, code: int) -> tuple[float, Vector]:
    costs, order = ahead(vector, TABLES[code])
    low, costs = _less(costs)
    return low, (costs, order)


@lru_cache(1 << 16)
def _row_behind(costs: tuple[float, ...], code: int) -> tuple[float, ...]:
    return _less(behind(costs, TABLES[code]))[1]


def crossings(elements: Sequence, start: int, target: tuple[float, ...], forward: Callable, backward: Callable, table: Callable) -> list[int]:
    """The states after each element, of the cheapest and then ASCII-least edits from `start`; target: what each state costs at the end."""
    if len(elements) == 1:
        costs, order = table(elements[0])
        return [min(range(4), key=lambda s: (costs[start][s] + target[s], order[start][s]))]
    if not len(elements):
        return []
    half = len(elements) // 2
    left: Vector = (_unit(start), (0, 0, 0, 0))
    for e in elements[:half]:
        left = forward(left, e)
    right = target
    for e in reversed(elements[half:]):
        right = backward(right, e)
    middle = min(range(4), key=lambda s: (left[0][s] + right[s], left[1][s]))
    return crossings(elements[:half], start, _unit(middle), forward, backward, table) + crossings(elements[half:], middle, target, forward, backward, table)


def row_states(codes: bytes, start: int, target: tuple[float, ...]) -> list[int]:
    """crossings() of rows."""
    return crossings(codes, start, target, lambda v, c: _row_ahead(v, c)[1], _row_behind, TABLES.__getitem__)


def node_states(tables: list[Table], start: int, target: tuple[float, ...]) -> list[int]:
    """crossings() of stretches of rows."""
    return crossings(tables, start, target, ahead, behind, lambda t: t)


def stretch(codes: bytes) -> Table:
    """Rows as one element."""
    costs, orders = [], []
    for start in range(4):
        total, vector = 0, (_unit(start), (0, 0, 0, 0))
        for c in codes:
            more, vector = _row_ahead(vector, c)
            total += more
        costs.append(tuple(c + total for c in vector[0]))
        orders.append(vector[1])
    return tuple(costs), tuple(orders)


def joined(tables: Iterable[Table]) -> Table:
    """Elements one after the other as one."""
    tables = list(tables)
    costs, orders = [], []
    for start in range(4):
        vector: Vector = (_unit(start), (0, 0, 0, 0))
        for t in tables:
            vector = ahead(vector, t)
        costs.append(vector[0])
        orders.append(vector[1])
    return tuple(costs), tuple(orders)


def edits(codes: bytes, start: int, target: tuple[float, ...]) -> list[tuple[str, list[str], str | None]]:
    """Of each row: the initials up to and with its own, the roles of empty rows before it, its new role (None: as it was, or deleted)."""
    out, now = [], start
    for code, end in zip(codes, row_states(codes, start, target)):
        letters = EDITS[code][now][end][1]
        before = []
        for _ in letters[:-1]:
            now = _put_in(now)
            before.append(_ROLES[now])
        out.append((letters, before, _ROLES[end] if letters[-1] == REROLE else None))
        now = end
    return out


def closing(state: int) -> tuple[str, list[str]]:
    """Initials and roles of the empty rows at the end."""
    letters, roles = _CLOSING[state], []
    for _ in letters:
        state = _put_in(state)
        roles.append(_ROLES[state])
    return letters, roles


# rows to blocks

#: White space of texts.
_SPACE = " \t\n\x0b\x0c\r"


def damage(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with faults by crc32("conv_id:turn") mod 20, nulls being one space there and in role and text.

    0 drops the row, 1 empties its text, 2 removes its marks of sentence ends, 3 repeats it, 4 makes it the user's.
    """
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind, text, role = F.crc32(key) % 20, F.coalesce("text", space), F.coalesce("role", space)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("copy")).drop("copy")


def _cuts(table: pa.Table, most_rows: int, most_bytes: int) -> list[int]:
    """Where blocks begin: at a new conversation, and where a block is full."""
    conv = table.column("conv_id").combine_chunks()
    codes = pc.dictionary_encode(conv, null_encoding="encode").indices.to_numpy()
    size = pc.add(pc.binary_length(table.column("text")), pc.binary_length(table.column("role"))).to_numpy()
    at = [0, *(np.flatnonzero(np.diff(codes)) + 1).tolist(), table.num_rows]
    out = []
    for a, b in zip(at, at[1:]):
        out.append(a)
        if b - a > most_rows or size[a:b].sum() > most_bytes:
            held = 0
            for i in range(a, b):
                if i > out[-1] and (i - out[-1] >= most_rows or held + size[i] > most_bytes):
                    out.append(i)
                    held = 0
                held += size[i]
    return out


def _packing(most_rows: int, most_bytes: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Sorted rows to blocks of one conversation each; the last block of a batch stays open until it is known to end."""

    def packed(table: pa.Table, begins: list[int], part: int, seq: int) -> pa.RecordBatch:
        offsets = np.array([*begins, table.num_rows], np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(offsets), table.column(c).combine_chunks()) for c in ("turn", "role", "text", "d1", "d2")]
        codes = table.column("code").to_numpy().astype(np.uint8).tobytes()
        code = pa.BinaryArray.from_buffers(pa.binary(), len(begins), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(codes)])
        conv = table.column("conv_id").take(pa.array(begins)).combine_chunks()
        where = [pa.array(np.full(len(begins), part), pa.int64()), pa.array(np.arange(seq, seq + len(begins)))]
        return pa.RecordBatch.from_arrays([conv, *where, code, *lists], ["conv_id", "part", "seq", "code", "turn", "role", "text", "d1", "d2"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, held = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if held is None else pa.concat_tables([held, table])
            if not table.num_rows:
                continue
            begins = _cuts(table, most_rows, most_bytes)
            if len(begins) > 1:
                yield packed(table.slice(0, begins[-1]), begins[:-1], part, seq)
                seq += len(begins) - 1
            held = table.slice(begins[-1])
        if held is not None:
            yield packed(held, [0], part, seq)

    return run


def _fields(conv: T.DataType, *rest: str) -> T.StructType:
    """A schema that begins with the conversation's id."""
    return T.StructType([T.StructField("conv_id", conv), *T.StructType.fromDDL(", ".join(rest)).fields])


def blocks(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks of rows (conv_id, turn, role, text) in order, stored: conv_id, part, seq (their order), code (a byte a row), turn, role, text, d1, d2 (arrays).

    Rows are in order of turn, nulls first; rows of one turn by the beginnings of role and text, then by a digest of them.
    """
    space = F.lit(" ")
    rows = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"))
    kept = F.rtrim(F.col("text"), F.lit(_SPACE))
    late = (~F.right(kept, F.lit(1)).isin(".", "!", "?")).cast("int")
    initial = F.coalesce(*[F.when(F.substring("role", 1, 1) == c, F.lit(k)) for k, c in enumerate(INITIALS)], F.lit(len(INITIALS)))
    rows = rows.withColumns({
        "code": F.when(kept == "", F.lit(0)).otherwise(1 + 2 * initial + late),
        "d1": F.xxhash64("conv_id", "role", "text"), "d2": F.xxhash64(F.lit(7), "text", "role", "conv_id"),
    })
    order = ["conv_id", F.asc_nulls_first("turn"), F.substring("role", 1, 16), F.substring("text", 1, 64), "d1", "d2"]
    # the row number keeps equal rows apart, so that any number of them is split
    dealt = rows.withColumn("row", F.monotonically_increasing_id()).repartitionByRange(*order, "row").sortWithinPartitions(*order).drop("row")
    schema = _fields(rows.schema["conv_id"].dataType, "part long", "seq long", "code binary", "turn array<long>", "role array<string>", "text array<string>", "d1 array<long>", "d2 array<long>")
    return stored(small_batches(dealt).mapInArrow(_packing(most_rows, most_bytes), schema), "conversations")


def _repeated(packed: DataFrame) -> DataFrame:
    """(part, seq, late): the places in each block of rows whose role and text came earlier in the conversation."""
    rows = packed.select("part", "seq", F.posexplode(F.arrays_zip("d1", "d2")).alias("at", "d")).select("d.d1", "d.d2", F.struct("part", "seq", "at").alias("place"))
    first = rows.groupBy("d1", "d2").agg(F.min("place").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    later = rows.join(first, ["d1", "d2"]).filter("place > first").select("place.*")
    return later.groupBy("part", "seq").agg(F.collect_list("at").alias("late"))  # no more than a block's rows


def _must_go(code: bytes, late: list[int] | None) -> bytes:
    if not late:
        return code
    out = bytearray(code)
    for i in late:
        out[i] = 0
    return bytes(out)


def _numbers(table: Table) -> tuple[list[float], list[int]]:
    return [c for row in table[0] for c in row], [r for row in table[1] for r in row]


def _of_numbers(costs: list[float], order: list[int]) -> Table:
    return tuple(tuple(costs[4 * s : 4 * s + 4]) for s in range(4)), tuple(tuple(order[4 * s : 4 * s + 4]) for s in range(4))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns))


def _batched(rows: Iterator[tuple], schema: pa.Schema, n: int = 1000) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    for r in rows:
        held.append(r)
        if len(held) == n:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held), schema)], schema=schema)


def _arrow(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _over(df: DataFrame, schema: T.StructType, run: Callable[[Iterator[tuple]], Iterator[tuple]]) -> DataFrame:
    """df's rows, as Python tuples in their order, through run."""
    shape = _arrow(schema)
    return df.mapInArrow(lambda batches: _batched(run(_rows(batches)), shape), schema)


def _groups(rows: Iterator[tuple], width: int) -> Iterator[list[tuple]]:
    """Neighbouring rows that agree in their first `width` values."""
    held: list[tuple] = []
    for r in rows:
        if held and held[-1][:width] != r[:width]:
            yield held
            held = []
        held.append(r)
    if held:
        yield held


def _up(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Nodes (conv_id, node, part, seq, costs, order) of one parent each to their parent."""
    for group in _groups(rows, 2):
        yield *group[0][:2], 0, *_numbers(joined(_of_numbers(r[4], r[5]) for r in group))


def _down(rows: Iterator[tuple]) -> Iterator[tuple]:
    """States at the ends of each node: rows are those of _up() with (start, end, last) of their parent (nulls: it has none, and is a whole conversation)."""
    for group in _groups(rows, 2):
        start, end, last = group[0][6:9]
        target = CLOSING if start is None else _unit(end)
        states = node_states([_of_numbers(r[4], r[5]) for r in group], start or NOTHING, target)
        for k, (r, s) in enumerate(zip(group, states)):
            yield r[0], r[2], r[3], (start or NOTHING) if k == 0 else states[k - 1], s, k == len(group) - 1 and last in (None, True)


def states(packed: DataFrame) -> DataFrame:
    """(conv_id, part, seq, start, end, last, late) of each of blocks(): the states at its ends, whether it is its conversation's last, and its repeated rows."""
    conv = packed.schema["conv_id"].dataType
    codes = packed.select("conv_id", "part", "seq", "code").join(_repeated(packed), ["part", "seq"], "left").select("conv_id", "part", "seq", "code", "late")
    node = _fields(conv, "part long", "seq long", "late array<int>", "costs array<double>", "order array<int>")

    def tables(rows: Iterator[tuple]) -> Iterator[tuple]:
        whole = lru_cache(1 << 12)(stretch)
        for c, part, seq, code, late in rows:
            yield c, part, seq, late, *_numbers(whole(_must_go(code, late)))

    leaves = stored(_over(codes, node, tables), "blocks")
    parts = (leaves.agg(F.max("part")).first()[0] or 0) + 1
    levels, shared = [leaves.select("conv_id", "part", "seq", "costs", "order")], ["conv_id", "node"]
    up = _fields(conv, "node long", "seq long", "costs array<double>", "order array<int>")
    by_node = lambda df: df.repartition(*shared).sortWithinPartitions(*shared, "part", "seq")
    under = lambda df: df.select("conv_id", F.floor(F.col("part") / FAN).alias("node"), "part", "seq", "costs", "order")
    while parts > FAN:
        levels.append(stored(_over(by_node(under(levels[-1])), up, _up).withColumnRenamed("node", "part"), "nodes"))
        parts = -(-parts // FAN)
    down = _fields(conv, "part long", "seq long", "start int", "end int", "last boolean")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("start", "int"), ("end", "int"), ("last", "boolean"))]
    found = None
    for level in reversed(levels):
        rows = under(level)
        if found is None:
            rows = rows.select("*", *none)
        else:
            of = found.select(F.col("conv_id").alias("of"), F.col("part").alias("above"), "start", "end", "last")
            rows = rows.join(of, F.col("conv_id").eqNullSafe(F.col("of")) & (F.col("node") == F.col("above"))).drop("of", "above")
        found = stored(_over(by_node(rows), down, _down), "states")
    return found.join(leaves.select("part", "seq", "late"), ["part", "seq"]).select("conv_id", "part", "seq", "start", "end", "last", "late")


def repaired(rows: DataFrame, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(conv_id, part, seq, at, turn, role, text, edit): the rows after repair, deleted ones too (edit D), and those put in (edit I, no turn).

    part, seq, at: their order within the conversation. Null roles and texts are one space; other columns are ignored; no rows: none.
    """
    packed = blocks(rows, most_rows, most_bytes)
    conv = packed.schema["conv_id"].dataType
    both = packed.select("conv_id", "part", "seq", "code", "turn", "role", "text").join(states(packed).drop("conv_id"), ["part", "seq"])
    schema = _fields(conv, "part long", "seq long", "at int", "turn long", "role string", "text string", "edit string")

    def run(rows: Iterator[tuple]) -> Iterator[tuple]:
        for conv_id, part, seq, code, turn, role, text, start, end, last, late in rows:
            out = []
            for (letters, before, new), t, r, x in zip(edits(_must_go(code, late), start, _unit(end)), turn, role, text):
                out += [(None, b, "", INSERT) for b in before] + [(t, new or r, x, letters[-1])]
            if last:
                out += [(None, b, "", INSERT) for b in closing(end)[1]]
            for at, r in enumerate(out):
                yield conv_id, part, seq, at, *r

    return _over(both.select("conv_id", "part", "seq", "code", "turn", "role", "text", "start", "end", "last", "late"), schema, run)


_LEGAL = {("s", "u"), ("u", "a"), ("a", "u")}


def _report(rows: Iterator[tuple]) -> Iterator[tuple]:
    """Rows of one conversation, one after the other: a mark without a place, then the state and the contents of each block."""
    for _, conv_rows in groupby(rows, key=lambda r: r[0]):
        low = high = last_turn = last_initial = end = None
        turns = blank = duplicate = truncated = illegal = cost = 0
        audit, digest, any_line = [], hashlib.sha256(), False
        state = None

        def put(role: str, text: str) -> None:
            nonlocal any_line
            digest.update((f"\n{role}:{text}" if any_line else f"{role}:{text}").encode())
            any_line = True

        for conv_id, part, seq, kind, start, stop, late, code, turn, role, text in conv_rows:
            if kind == 0:
                continue
            if kind == 1:
                state = (start, stop, late)
                continue
            start, end, late = state
            gone = _must_go(code, late)
            for t in turn:
                if t is not None and t != last_turn:
                    turns, low, high, last_turn = turns + 1, t if low is None else low, t, t
            for r in role:
                illegal += last_initial is not None and (last_initial, r[:1]) not in _LEGAL
                last_initial = r[:1]
            blank += code.count(0)
            duplicate += gone.count(0) - code.count(0)
            truncated += sum(1 for c in gone if c and (c - 1) % 2)
            for (letters, before, new), c, r, x in zip(edits(gone, start, _unit(end)), gone, role, text):
                audit.append(letters)
                cost += sum(COSTS[i] for i in letters) + TRUNCATED * (letters[-1] != DELETE and (c - 1) % 2)
                for b in before:
                    put(b, "")
                if letters[-1] != DELETE:
                    put(new or r, x)
        if end is not None:
            letters, roles = closing(end)
            audit.append(letters)
            cost += COSTS[INSERT] * len(letters)
            for b in roles:
                put(b, "")
        gaps = high - low + 1 - turns if turns else 0
        yield conv_id, gaps, blank, duplicate, truncated, illegal, cost, "".join(audit), digest.hexdigest()


def report(rows: DataFrame, every: DataFrame | None = None, most_rows: int = BLOCK_ROWS, most_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Faults and cheapest repair of each conversation of rows, and of each conv_id in `every` that has no rows.

    conv_id, gaps (turns missing between the least and the greatest), blank, duplicate, truncated (rows by their first fault), illegal (neighbours whose
    roles may not follow each other), cost (longs), audit (initials of the edits in order), repaired_sha256 (of the lines `role:text`).
    No rows: zeros, an empty audit, the digest of nothing. Null ids are one conversation; null roles and texts are one space; null turns come first
    and count in no gap; repeated rows are duplicates; other columns are ignored; empty tables give no rows.
    """
    packed = blocks(rows, most_rows, most_bytes)
    conv = packed.schema["conv_id"].dataType
    place = [F.col("conv_id"), F.col("part"), F.col("seq")]
    null = lambda c, t: F.lit(None).cast(t).alias(c)
    contents = packed.select(*place, F.lit(2).alias("kind"), null("start", "int"), null("end", "int"), null("late", "array<int>"), "code", "turn", "role", "text")
    lists = [null("code", "binary"), null("turn", "array<bigint>"), null("role", "array<string>"), null("text", "array<string>")]
    ends = states(packed).select(*place, F.lit(1).alias("kind"), "start", "end", "late", *lists)
    ids = (rows if every is None else every).select("conv_id").distinct()
    marks = ids.select("conv_id", F.lit(-1).cast("long").alias("part"), F.lit(0).cast("long").alias("seq"), F.lit(0).alias("kind"), null("start", "int"), null("end", "int"), null("late", "array<int>"), *lists)
    schema = _fields(conv, "gaps long", "blank long", "duplicate long", "truncated long", "illegal long", "cost long", "audit string", "repaired_sha256 string")
    together = contents.unionByName(ends).unionByName(marks).repartition("conv_id").sortWithinPartitions("conv_id", "part", "seq", "kind")
    return _over(small_batches(together), schema, _report)
