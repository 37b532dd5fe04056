"""Repair of the turn structure of conversations by a rank-compressed dynamic program.

Rows of a conversation, in the order of their turns, are kept, given another role, or deleted, and empty turns are
inserted, so that the roles follow ``(s?(ua)+)?`` at the least cost; of all cheapest ways the one whose edits, written as
K, R, D and I, come first in ASCII order. A layer of the program is one row. Its edits are macros, a run of inserts and
then the row's own edit, such as ``IIK``. No macro begins another, so edit strings compare as their lists of macros do,
and no layer needs the strings: the best string of each of the four states has a rank among them, and the next layer
compares (cost, rank of the parent, rank of the macro). A parent pointer of each state gives the edits back afterwards.

Costs and ranks also compose: a stretch of rows is a table of the best way from each state to each state, and tables of
neighbouring stretches merge like rows. So a conversation of any share of all rows is cut into blocks of bounded size;
tables are merged upwards in groups of ``1 << FAN``, and the states at their borders are handed down again.

Defined cases. Null roles and texts are one space. Rows of one turn are ordered by role, then text. A null turn comes
first, a null conversation id is a conversation. Repeated rows are rows each (and duplicates of the first). An empty table
has no conversations. Texts of any length pass in blocks of ``BYTES`` and whole rows. The digest of a conversation is of
one byte stream and so one task's, which reads it in pieces and keeps none. Other columns do not matter.
"""

from __future__ import annotations

from functools import lru_cache
from hashlib import sha256
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prismet.llm._stage import default_parts, map_arrow, stage
from prismet.session import ship

#: Rows and bytes of a block; a row of more bytes is a block of its own. Tables merged at once, as a power of two. Bytes
#: of a piece of a long conversation on its way to the digest.
ROWS, BYTES, FAN, PIECE = 4096, 1 << 20, 10, 1 << 16
_SHIFT = ROWS.bit_length()
_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"

START, SYSTEM, USER, ASSISTANT = range(4)
#: The state after an inserted or renamed turn, and that turn's role.
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_ROLE = {USER: "user", ASSISTANT: "assistant"}
_KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
CLEAN, TRUNCATED, GONE = range(3)
COST = {"K": 0, "R": 1, "D": 2, "I": 5, "truncated": 5}
#: Two inserts come back to the same state, so no cheapest way has a longer run.
MACROS = sorted("I" * k + edit for k in range(3) for edit in "KRD")
#: Inserts after the last row that make each state a good end, and their cost.
ENDS = {START: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}

Layer = tuple  # of (cost, rank) or None for each state


@lru_cache(None)
def moves(initial: str, fault: int) -> list[tuple[int, int, int, int]]:
    """(from state, to state, cost, macro) of a row with this initial of a role and this fault."""
    out = []
    for before in range(4):
        for code, macro in enumerate(MACROS):
            state, edit, runs = before, macro[-1], len(macro) - 1
            for _ in range(runs):
                state = _NEXT[state]
            cost = COST["I"] * runs + COST[edit]
            if edit != "D":
                if fault == GONE:
                    continue
                cost += COST["truncated"] * (fault == TRUNCATED)
                state = _KEPT.get((state, initial)) if edit == "K" else _NEXT[state]
            if state is not None:
                out.append((before, state, cost, code))
    return out


def _ranked(best: dict) -> dict:
    """state -> rank, by (rank of parent, rank of what was added)."""
    return {s: k for k, s in enumerate(sorted(best, key=lambda s: best[s][1:]))}


@lru_cache(1 << 16)
def step(layer: Layer, initial: str, fault: int) -> tuple[int, Layer, tuple]:
    """(cost common to all states, the next layer without it, (parent, macro) of each state).

    Costs of a layer differ by little, so few layers exist and most rows are one look-up.
    """
    best = {}
    for before, after, cost, code in moves(initial, fault):
        if layer[before] is not None:
            found = (layer[before][0] + cost, layer[before][1], code, before)
            if after not in best or found < best[after]:
                best[after] = found
    low, rank = min(b[0] for b in best.values()), _ranked(best)
    new = tuple((best[s][0] - low, rank[s]) if s in best else None for s in range(4))
    return low, new, tuple((best[s][3], best[s][2]) if s in best else None for s in range(4))


def entered(state: int) -> Layer:
    return tuple((0, 0) if s == state else None for s in range(4))


def forward(rows: list[tuple[str, int]], entry: int) -> tuple[int, Layer, list[tuple]]:
    """(common cost, last layer, parents of each row) of rows (initial, fault) from a state on."""
    total, layer, parents = 0, entered(entry), []
    for initial, fault in rows:
        low, layer, back = step(layer, initial, fault)
        total += low
        parents.append(back)
    return total, layer, parents


def backward(parents: list[tuple], state: int) -> list[str]:
    """The macros of each row on the best way to a state."""
    out = []
    for back in reversed(parents):
        state, code = back[state]
        out.append(MACROS[code])
    return out[::-1]


def table(rows: list[tuple[str, int]]) -> list[int]:
    """Cost and rank of the best way from each state to each state, -1 where there is none: 32 numbers."""
    out = []
    for entry in range(4):
        total, layer, _ = forward(rows, entry)
        for way in layer:
            out += [-1, -1] if way is None else [total + way[0], way[1]]
    return out


def merge(layer: Layer, ways: list[int]) -> tuple[Layer, list[int | None]]:
    """The layer behind a stretch with this table, and the parent of each state."""
    best = {}
    for before in range(4):
        if layer[before] is not None:
            for after in range(4):
                cost, rank = ways[8 * before + 2 * after : 8 * before + 2 * after + 2]
                if cost >= 0:
                    found = (layer[before][0] + cost, layer[before][1], rank, before)
                    if after not in best or found < best[after]:
                        best[after] = found
    rank = _ranked(best)
    return tuple((best[s][0], rank[s]) if s in best else None for s in range(4)), [best[s][3] if s in best else None for s in range(4)]


def best_end(layer: Layer) -> int:
    """The state in which the cheapest whole way leaves its last row."""
    return min((s for s in range(4) if layer[s] is not None), key=lambda s: (layer[s][0] + COST["I"] * ENDS[s], layer[s][1]))


def fault(text: Column) -> Column:
    """CLEAN, TRUNCATED or GONE (blank), by the last character that is no space."""
    last = F.right(F.rtrim(text, F.lit(_SPACE)), F.lit(1))
    return F.when(last == "", F.lit(GONE)).when(last.isin(".", "!", "?"), F.lit(CLEAN)).otherwise(F.lit(TRUNCATED))


def conversation(column: Column) -> Column:
    """A conversation's name, never null."""
    return F.coalesce(F.concat(F.lit(":"), column.cast("string")), F.lit("-"))


_CUT = "conv string, role string, text string, fault int, at long"


def _cut(most_rows: int, most_bytes: int):
    """Places in the order: partition, block and row of the block."""

    def run(batches):
        block, rows, size = TaskContext.get().partitionId() << 20, 0, 0
        for batch in batches:
            at = []
            for n in pc.add(pc.binary_length(batch.column("text")), pc.binary_length(batch.column("role"))).to_pylist():
                if rows and (rows == most_rows or size + n > most_bytes):
                    block, rows, size = block + 1, 0, 0
                at.append(block << _SHIFT | rows)
                rows, size = rows + 1, size + n
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("conv", "role", "text", "fault")], pa.array(at, pa.int64())], ["conv", "role", "text", "fault", "at"])

    return run


def in_blocks(rows: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str, most_rows: int, most_bytes: int) -> DataFrame:
    """conv, role, text, fault, at: all rows in order, written; ``at >> _SHIFT`` is the block."""
    space = F.lit(" ")
    text = F.coalesce(F.col(text_col).cast("string"), space)
    src = rows.select(conversation(F.col(id_col)).alias("conv"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col).cast("string"), space).alias("role"), text.alias("text"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("text")]
    ordered = src.repartitionByRange(default_parts(rows.sparkSession), *order).sortWithinPartitions(*order)
    return stage(map_arrow(ordered.select("conv", "role", "text", fault(F.col("text")).alias("fault")), _cut(most_rows, most_bytes), _CUT), "turns")


def _faults(rows: pa.Table, firsts: pa.Table) -> tuple[list, list, list, list]:
    """at, conv, initial, fault of a block's rows, in order; fault 3 stands for a duplicate."""
    at = rows.column("at").to_pylist()
    order = sorted(range(len(at)), key=at.__getitem__)
    seen = set(firsts.column("at").to_pylist())
    conv, role, kind = (rows.column(c).to_pylist() for c in ("conv", "role", "fault"))
    kinds = [3 if kind[k] != GONE and at[k] not in seen else kind[k] for k in order]
    return order, [conv[k] for k in order], [role[k][:1] for k in order], kinds


def _fragments(conv: list[str]) -> list[tuple[str, int, int]]:
    out, at = [], 0
    for c, own in groupby(conv):
        n = sum(1 for _ in own)
        out.append((c, at, at + n))
        at += n
    return out


def _edges(rows: pa.Table, firsts: pa.Table) -> pa.Table:
    """Tables of the first and the last conversation of a block: they may go on in another."""
    if not rows.num_rows:
        return pa.Table.from_pylist([], _TABLE)
    _, conv, initial, kinds = _faults(rows, firsts)
    found = _fragments(conv)
    block = rows.column("at")[0].as_py() >> _SHIFT
    out = [{"conv": c, "unit": block, "ways": table([(i, min(k, GONE)) for i, k in zip(initial[a:b], kinds[a:b], strict=True)])} for c, a, b in (found[:1] + found[1:][-1:])]
    return pa.Table.from_pylist(out, _TABLE)


_TABLE = pa.schema([("conv", pa.string()), ("unit", pa.int64()), ("ways", pa.list_(pa.int64()))])
_TABLE_DDL = "conv string, unit long, ways array<long>"
_STATES = pa.schema([("conv", pa.string()), ("unit", pa.int64()), ("entry", pa.int64()), ("exit", pa.int64()), ("ends", pa.bool_())])
_STATES_DDL = "conv string, unit long, entry long, exit long, ends boolean"


def _in_order(units: pa.Table) -> list[dict]:
    return sorted(units.to_pylist(), key=lambda r: r["unit"])


def _merged(fan: int):
    """The table of neighbouring stretches."""

    def run(units: pa.Table) -> pa.Table:
        rows, ways = _in_order(units), []
        for entry in range(4):
            layer = entered(entry)
            for r in rows:
                layer, _ = merge(layer, r["ways"])
            for way in layer:
                ways += [-1, -1] if way is None else list(way)
        return pa.Table.from_pylist([{"conv": rows[0]["conv"], "unit": rows[0]["unit"] >> fan, "ways": ways}], _TABLE)

    return run


def _whole(units: pa.Table) -> pa.Table:
    """The states around the one table of a conversation."""
    out = []
    for r in units.to_pylist():
        layer, _ = merge(entered(START), r["ways"])
        out.append({"conv": r["conv"], "unit": r["unit"], "entry": START, "exit": best_end(layer), "ends": True})
    return pa.Table.from_pylist(out, _STATES)


def _handed_down(units: pa.Table, states: pa.Table) -> pa.Table:
    """The states around each of the merged tables, from those around all of them."""
    outer, rows, backs = states.to_pylist()[0], _in_order(units), []
    layer = entered(outer["entry"])
    for r in rows:
        layer, back = merge(layer, r["ways"])
        backs.append(back)
    state, out = outer["exit"], []
    for k in range(len(rows) - 1, -1, -1):
        before = backs[k][state]
        out.append({"conv": outer["conv"], "unit": rows[k]["unit"], "entry": before, "exit": state, "ends": outer["ends"] and k == len(rows) - 1})
        state = before
    return pa.Table.from_pylist(out, _STATES)


def border_states(edges: DataFrame, fan: int = FAN) -> DataFrame:
    """conv, unit (block), entry, exit, ends: the states around each stretch, as the best way through its conversation has them."""
    levels = [edges]
    while not _single(levels[-1]):
        above = levels[-1].groupBy("conv", F.shiftright("unit", fan)).applyInArrow(_merged(fan), _TABLE_DDL)
        levels.append(stage(above, "merged"))
    states = map_arrow(levels[-1], lambda batches: (b for batch in batches for b in _whole(pa.Table.from_batches([batch])).to_batches()), _STATES_DDL)
    for below in reversed(levels[:-1]):
        left = below.groupBy("conv", F.shiftright("unit", fan).alias("above"))
        states = stage(left.cogroup(states.groupBy("conv", F.col("unit").alias("above"))).applyInArrow(_handed_down, _STATES_DDL), "states")
    return states


def _single(tables: DataFrame) -> bool:
    return not tables.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).where("n > 1").take(1)


_PARTS = pa.schema([("conv", pa.string()), ("unit", pa.int64()), ("piece", pa.int64()), ("whole", pa.bool_()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("audit", pa.string()), ("lines", pa.binary())])
_PARTS_DDL = "conv string, unit long, piece long, whole boolean, blank long, duplicate long, truncated long, illegal long, cost long, first string, last string, audit string, lines binary"
_LEGAL = {"su", "ua", "au"}


def _edited(macros: list[str], rows: list[tuple[str, str]], entry: int, ends: bool) -> tuple[str, list[str], int]:
    """The edits, the lines they leave, and the state they end in."""
    state, lines, audit = entry, [], macros
    if ends:
        last = entry
        for macro, (role, _) in zip(macros, rows, strict=True):
            for edit in macro:
                last = _moved(last, edit, role)
        audit = [*macros, "I" * ENDS[last]]
        rows = [*rows, ("", "")]
    for macro, (role, text) in zip(audit, rows, strict=True):
        for edit in macro:
            new = _moved(state, edit, role)
            if edit != "D":
                lines.append(f"{role if edit == 'K' else _ROLE[new]}:{'' if edit == 'I' else text}")
            state = new
    return "".join(audit), lines, state


def _moved(state: int, edit: str, role: str) -> int:
    return state if edit == "D" else _KEPT[state, role[:1]] if edit == "K" else _NEXT[state]


def _repaired(size: int):
    """Each conversation's part of a block; one that lies in it whole is done."""

    def run(rows: pa.Table, more: pa.Table) -> pa.Table:
        if not rows.num_rows:
            return pa.Table.from_pylist([], _PARTS)
        given = {r["conv"]: r for r in more.to_pylist() if r["conv"] is not None}
        order, conv, initial, kinds = _faults(rows, more.filter(pc.is_valid(more.column("at"))))
        role, text = rows.column("role").to_pylist(), rows.column("text").to_pylist()
        block, out = rows.column("at")[0].as_py() >> _SHIFT, []
        for c, a, b in _fragments(conv):
            own, state = [(i, min(k, GONE)) for i, k in zip(initial[a:b], kinds[a:b], strict=True)], given.get(c)
            entry = state["entry"] if state else START
            total, layer, parents = forward(own, entry)
            leaves, ends = (state["exit"], state["ends"]) if state else (best_end(layer), True)
            audit, lines, _ = _edited(backward(parents, leaves), [(role[k], text[k]) for k in order[a:b]], entry, ends)
            count = {k: sum(x == k for x in kinds[a:b]) for k in (GONE, 3, TRUNCATED)}
            part = {"conv": c, "unit": block, "piece": 0, "whole": state is None, "blank": count[GONE], "duplicate": count[3], "truncated": count[TRUNCATED], "first": initial[a], "last": initial[b - 1], "audit": audit}
            part["illegal"] = sum(x + y not in _LEGAL for x, y in zip(initial[a : b - 1], initial[a + 1 : b], strict=True))
            part["cost"] = total + layer[leaves][0] + COST["I"] * ENDS[leaves] * ends
            joined = "\n".join(lines).encode("utf-8", "surrogatepass")
            if state is None:
                out.append(part | {"lines": sha256(joined).hexdigest().encode()})
                continue
            # Lines of a part are set apart from those before it by the digest's task.
            for k in range(0, max(len(joined), 1), size):
                rest = {"piece": k // size, "lines": joined[k : k + size] if lines else None}
                out.append(part | rest if not k else {"conv": c, "unit": block, "whole": False} | rest)
        return pa.Table.from_pylist(out, _PARTS)

    return run


_DONE = ["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
_DONE_DDL = "conv string, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def _joined(batches):
    """The parts of each conversation, which come in order, put together."""
    now, sums, audit, digest, last, begun = None, None, None, None, None, False

    def done():
        return (now, *sums, "".join(audit), digest.hexdigest())

    for batch in batches:
        out = []
        for r in batch.to_pylist():
            if now is None or r["conv"] != now:
                if now is not None:
                    out.append(done())
                now, sums, audit, digest, last, begun = r["conv"], [0] * 5, [], sha256(), None, False
            if not r["piece"]:
                sums = [s + r[c] for s, c in zip(sums, _DONE[1:6], strict=True)]
                sums[3] += last is not None and last + r["first"] not in _LEGAL
                last = r["last"]
                audit.append(r["audit"])
            if r["lines"] is not None:
                if not r["piece"]:
                    digest.update(b"\n" if begun else b"")
                    begun = True
                digest.update(r["lines"])
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], _DONE)
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in done()], _DONE)


def repaired(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", most_rows: int = ROWS, most_bytes: int = BYTES, fan: int = FAN, piece: int = PIECE) -> DataFrame:
    """conv (``conversation(id)``), counts of faults, cost, audit and repaired_sha256 of each conversation that has rows."""
    ship(rows.sparkSession)
    turns = in_blocks(rows, id_col, turn_col, role_col, text_col, most_rows, most_bytes)
    block = F.shiftright("at", _SHIFT)
    # The first of equal rows, found by map-side minima; the others are duplicates.
    firsts = turns.where(F.col("fault") != GONE).groupBy("conv", "role", F.sha2("text", 256)).agg(F.min("at").alias("at")).select("at")
    firsts = stage(firsts, "firsts")
    narrow = turns.select("at", "conv", F.left("role", F.lit(1)).alias("role"), "fault").groupBy(block.alias("block"))
    edges = stage(narrow.cogroup(firsts.groupBy(block.alias("block"))).applyInArrow(_edges, _TABLE_DDL), "edges")
    more = firsts.select(block.alias("block"), "at").unionByName(border_states(edges, fan).withColumnRenamed("unit", "block"), allowMissingColumns=True)
    parts = stage(turns.groupBy(block.alias("block")).cogroup(more.groupBy("block")).applyInArrow(_repaired(piece), _PARTS_DDL), "parts")
    whole = parts.where("whole").select(*_DONE[:-1], F.col("lines").cast("string").alias("repaired_sha256"))
    cut = parts.where("NOT whole").repartition("conv").sortWithinPartitions("conv", "unit", "piece")
    return whole.unionByName(map_arrow(cut, _joined, _DONE_DDL))


def gaps(rows: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """conv, gaps: turn numbers missing between the least and the greatest of each conversation."""
    turns = rows.select(conversation(F.col(id_col)).alias("conv"), F.col(turn_col).cast("long").alias("turn")).distinct()
    return turns.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).alias("gaps"))


def damaged(rows: DataFrame) -> DataFrame:
    """Rows as a faulty export might leave them: dropped, emptied, stripped of full stops, repeated or renamed by a hash of their key."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    text, role = F.coalesce("text", space), F.coalesce("role", space)
    out = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key) % 20).alias("_kind")).where("_kind <> 0")
    text = F.when(F.col("_kind") == 1, F.lit("")).when(F.col("_kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, F.lit("user")).otherwise(F.col("role"))
    times = F.explode(F.sequence(F.lit(1), F.when(F.col("_kind") == 3, 2).otherwise(1)))
    return out.select("conv_id", "turn", role.alias("role"), text.alias("text"), times.alias("_time")).drop("_time")
