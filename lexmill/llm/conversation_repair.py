"""Conversation repair: the cheapest edits that give every conversation a regular order of roles.

A conversation is regular if its role initials read `(s?(ua)+)?`. A row may be kept (K, free), given the role that the
order asks for (R, 1) or deleted (D, 2; blank and duplicate rows must be), and a row of empty text may be inserted
anywhere (I, 5); a truncated row that stays costs 5 more. Of equally cheap edits the least string of initials wins.

Spark deals the rows by conversation and sorts them; a task streams over its sorted rows in batches of `BATCH_TURNS`.
In a batch a recursive DuckDB query advances one turn of all its conversations at a time and keeps, per conversation
and grammar state, the least cost and its edits. What a batch leaves open goes on in the next one: a walk starts from
every state that the conversation may be in, so its edits before the batch are added afterwards and not carried through
the recursion. A second stream over the same rows, sorted again in the same tasks with each conversation's edits ahead,
applies the edits. No task holds more than a batch of rows and one conversation's edits, a letter or two a turn; texts
are shuffled once. The digest of a repaired conversation is sequential, so one conversation is read by one task,
however long it is, at the speed of a hash.

Null roles and texts, and nulls in the names that damage is drawn by, are one space. A null conversation id is a
conversation of its own. Rows of one turn go by role, then text; null turns first. Repeated rows are rows, the later
ones duplicates. A conversation without rows has zeros, no edits and the digest of the empty string. Empty table: no
rows. Very long texts and conversations are read whole. Other columns may have any names and are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from lexmill.llm.common import map_batches

#: Rows that one recursive query walks over.
BATCH_TURNS = 4096
#: Grammar states: nothing yet, after the system's row, after the user's, after the assistant's.
START, SYSTEM, USER, ASSISTANT = range(4)
#: By state: the role that an inserted or changed row takes, and the state after it.
NEXT = {START: ("user", USER), SYSTEM: ("user", USER), USER: ("assistant", ASSISTANT), ASSISTANT: ("user", USER)}
FINAL = (START, ASSISTANT)
REROLE, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
FAULTS = ("blank", "duplicate", "truncated")
LEGAL = ("su", "ua", "au")


def _inserts(state: int) -> list[tuple[str, int, int]]:
    """What insertions alone may do: their letters, their cost, the state after them. More than two lead nowhere new."""
    out = [("", 0, state)]
    for _ in range(2):
        letters, cost, at = out[-1]
        out.append((f"{letters}I", cost + INSERT, NEXT[at][1]))
    return out


def _moves() -> list[tuple[int, str, str, int, int]]:
    """(state, initial that the row must have or '', letters, cost, next state) of one row's edit and the inserts after it."""
    edits = [(s, "", "D", DELETE, s) for s in range(4)] + [(s, "", "R", REROLE, NEXT[s][1]) for s in range(4)]
    edits += [(s, NEXT[s][0][0], "K", 0, NEXT[s][1]) for s in range(4)] + [(START, "s", "K", 0, SYSTEM)]
    return [(s, needs, f"{edit}{more}", cost + extra, after) for s, needs, edit, cost, mid in edits for more, extra, after in _inserts(mid)]


#: Each step joins the open walks with their next row and the moves that it allows, and keeps one walk per conversation,
#: origin and state; `USING KEY` replaces the walk of the turn before.
WALK = f"""
WITH RECURSIVE walk(conv, origin, state, step, best) USING KEY (conv, origin, state) AS (
  SELECT conv, origin, state, 0, {{'cost': cost, 'edits': edits}} FROM starts
  UNION
  SELECT conv, origin, after, step, min(best) FROM (
    SELECT w.conv, w.origin, m.after, t.step,
      {{'cost': w.best.cost + m.cost + CASE WHEN t.fault = 3 AND m.letters NOT LIKE 'D%' THEN {CUT_OFF} ELSE 0 END, 'edits': w.best.edits || m.letters}} AS best
    FROM walk w JOIN turns t ON t.conv = w.conv AND t.step = w.step + 1
    JOIN moves m ON m.state = w.state AND (m.needs = '' OR m.needs = t.initial) AND (t.fault NOT IN (1, 2) OR m.letters LIKE 'D%'))
  GROUP BY conv, origin, after, step)
SELECT w.conv, origin, state, best.cost AS cost, best.edits AS edits
FROM walk w JOIN (SELECT conv, max(step) AS last FROM turns GROUP BY conv) USING (conv) WHERE step = last"""


def _engine():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
    con.execute("CREATE TABLE moves(state INTEGER, needs VARCHAR, letters VARCHAR, cost BIGINT, after INTEGER)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", _moves())
    return con


Open = dict[int, tuple[int, str]]  # state: least cost and edits to get there


def fresh() -> Open:
    """Before any row: inserts alone."""
    return {state: (cost, letters) for letters, cost, state in _inserts(START)}


def walk_batch(con, turns: pa.Table, opened: dict[int, Open]) -> dict[int, Open]:
    """The open walks after a batch. turns: conv, step from 1, initial, fault; opened: those before it."""
    origins = [(c, s) for c, states in opened.items() for s in states]
    starts = pa.table({"conv": pa.array([c for c, _ in origins], pa.int64()), "origin": pa.array([s for _, s in origins], pa.int32())})
    con.register("turns", turns)
    con.register("origins", starts)
    found = con.execute(WALK.replace("FROM starts", "FROM (SELECT conv, origin, origin AS state, CAST(0 AS BIGINT) AS cost, '' AS edits FROM origins)")).fetchall()
    con.unregister("turns")
    con.unregister("origins")
    out: dict[int, Open] = {}
    for conv, origin, state, cost, edits in found:
        before = opened[conv][origin]
        reached = out.setdefault(conv, {})
        if state not in reached or (before[0] + cost, before[1] + edits) < reached[state]:
            reached[state] = before[0] + cost, before[1] + edits
    return out


def cheapest(states: Open) -> tuple[int, str]:
    return min(states[s] for s in FINAL if s in states)


def damage(rows: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The rows as seeded damage leaves them; a dropped row stays as a row marked gone, so that no conversation is lost."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat_ws(":", told(id_col), told(turn_col))) % 20
    text = F.when(draw == 1, F.lit("")).when(draw == 2, F.regexp_replace(told(text_col), "[.!?]", "")).otherwise(told(text_col))
    out = rows.select(
        F.col(id_col).alias("conv_id"), F.when(draw != 0, F.col(turn_col)).alias("turn"), F.when(draw == 4, F.lit("user")).when(draw != 0, told(role_col)).alias("role"),
        F.when(draw != 0, text).alias("text"), (draw == 0).alias("gone"), F.when(draw == 3, 2).otherwise(1).alias("times"),
    )
    return out.withColumn("nth", F.explode(F.array_repeat(F.lit(0), F.col("times")))).drop("nth", "times")


def _fault(again: Column) -> Column:
    """1, 2, 3 for the first of FAULTS that a row has, else 0."""
    last = F.right(F.rtrim("text", F.lit(" \t\n\x0b\x0c\r")), F.lit(1))
    return F.when(last == "", 1).when(again, 2).when(~last.isin(".", "!", "?"), 3).otherwise(0)


def flag(rows: DataFrame) -> DataFrame:
    """Damaged or raw rows with their place in the conversation and their first fault; gone rows come first."""
    order = [F.desc("gone"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("text")]
    placed = rows.withColumn("place", F.row_number().over(W.partitionBy("conv_id").orderBy(*order)))
    again = F.row_number().over(W.partitionBy("conv_id", "gone", "role", "text").orderBy("place")) > 1
    return placed.withColumn("again", again).withColumn("fault", F.when(F.col("gone"), 0).otherwise(_fault(F.col("again")))).drop("again")


_SCHEMA = "conv_id {0}, place long, edits string, cost long, turn {1}, role string, text string, gone boolean, fault int"


def find_edits(flagged: DataFrame) -> DataFrame:
    """The flagged rows again, with a row per conversation at place 0 that holds its cheapest edits and their cost."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _engine()
        key: object = None
        number = 0  # of the conversation that is open
        opened: dict[int, Open] = {}
        keys: dict[int, object] = {}
        columns: dict[str, list] = {"conv": [], "step": [], "initial": [], "fault": []}
        steps: dict[int, int] = {}

        def advance() -> None:
            if columns["conv"]:
                turns = pa.table([pa.array(v, t) for v, t in zip(columns.values(), (pa.int64(), pa.int64(), pa.string(), pa.int32()), strict=True)], names=list(columns))
                opened.update(walk_batch(con, turns, {c: opened[c] for c in steps}))
                steps.clear()
                for v in columns.values():
                    v.clear()

        def done(names: list[str], kinds: pa.Schema, last: int | None) -> Iterator[pa.RecordBatch]:
            """Edits of the conversations that have ended: all but `last`."""
            ended = sorted(c for c in opened if c != last)
            if ended:
                best = [cheapest(opened.pop(c)) for c in ended]
                n = len(ended)
                given = {"conv_id": [keys.pop(c) for c in ended], "place": [0] * n, "edits": [e for _, e in best], "cost": [c for c, _ in best], "gone": [False] * n, "fault": [0] * n}
                yield pa.RecordBatch.from_arrays([pa.array(given.get(x, [None] * n), kinds.field(x).type) for x in names], names=names)

        names: list[str] = []
        kinds = pa.schema([])
        for batch in batches:
            kinds = pa.schema([*[batch.schema.field(c) for c in ("conv_id", "turn")], ("place", pa.int64()), ("edits", pa.string()), ("cost", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("gone", pa.bool_()), ("fault", pa.int32())])
            names = ["conv_id", "place", "edits", "cost", "turn", "role", "text", "gone", "fault"]
            ids, roles, gone, faults = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "role", "gone", "fault"))
            for conv, role, dropped, fault in zip(ids, roles, gone, faults, strict=True):
                if not keys or conv != key:
                    number += 1
                    key, keys[number], opened[number] = conv, conv, fresh()
                if dropped:
                    continue
                steps[number] = steps.get(number, 0) + 1
                for name, x in zip(columns, (number, steps[number], role[:1], fault), strict=True):
                    columns[name].append(x)
                if len(columns["conv"]) >= BATCH_TURNS:
                    advance()
            nothing = pa.nulls(len(ids))
            held = {c: batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", "place", "turn", "role", "text", "gone", "fault")}
            yield pa.RecordBatch.from_arrays([held.get(c, nothing).cast(kinds.field(c).type) for c in names], names=names)
            if not columns["conv"] or len(opened) >= BATCH_TURNS:
                advance()
                yield from done(names, kinds, number)
        advance()
        yield from done(names, kinds, None)

    kinds = dict(flagged.dtypes)
    return map_batches(flagged.sortWithinPartitions(F.asc_nulls_first("conv_id"), "place"), run, _SCHEMA.format(kinds["conv_id"], kinds["turn"]))


_OUT = "conv_id {0}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class _Repaired:
    """One conversation while its rows pass: counts, and the digest of what its edits make of them."""

    def __init__(self, conv: object, cost: int, edits: str):
        self.conv, self.cost, self.edits = conv, cost, edits
        self.at, self.state, self.hash, self.before, self.first = 0, START, hashlib.sha256(), "", True
        self.faults, self.illegal = [0] * 4, 0
        self.low = self.high = self.turn = None
        self.turns = 0
        self.insert()

    def put(self, role: str, text: str) -> None:
        self.hash.update(f"{'' if self.first else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
        self.first = False

    def insert(self) -> None:
        while self.at < len(self.edits) and self.edits[self.at] == "I":
            role, self.state = NEXT[self.state]
            self.put(role, "")
            self.at += 1

    def take(self, turn: int | None, role: str, text: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.before is not None and sum(self.faults) > 1 and f"{self.before}{role[:1]}" not in LEGAL:
            self.illegal += 1
        self.before = role[:1]
        if turn is not None and turn != self.turn:
            self.turn, self.high, self.low, self.turns = turn, turn, turn if self.low is None else self.low, self.turns + 1
        edit = self.edits[self.at]
        self.at += 1
        if edit != "D":
            wanted, after = NEXT[self.state]
            if edit == "K" and role[:1] == "s":
                after = SYSTEM
            self.put(role if edit == "K" else wanted, text)
            self.state = after
        self.insert()

    def row(self) -> tuple:
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv, gaps, *self.faults[1:], self.illegal, self.cost, self.edits, self.hash.hexdigest()


def repair(rows: DataFrame, damaged: bool = False, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, faults, cost and edits of its cheapest repair, digest of the repaired rows.

    With `damaged`, rows are damaged by their seeds first.
    """
    if damaged:
        rows = damage(rows, id_col, turn_col, role_col, text_col)
    else:
        told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        rows = rows.select(F.col(id_col).alias("conv_id"), F.col(turn_col).alias("turn"), told(role_col).alias("role"), told(text_col).alias("text"), F.lit(False).alias("gone"))
    found = find_edits(flag(rows)).sortWithinPartitions(F.asc_nulls_first("conv_id"), "place")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one: _Repaired | None = None
        for batch in batches:
            out = []
            for conv, place, edits, cost, turn, role, text, gone, fault in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if place == 0:
                    if one is not None:
                        out.append(one.row())
                    one = _Repaired(conv, cost, edits)
                elif not gone:
                    one.take(turn, role, text, fault)
            yield table_of(out, batch.schema.field("conv_id").type)
        if one is not None:
            yield table_of([one.row()], kind)

    def table_of(out: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) if out else [()] * 9
        kinds = [kind, *[pa.int64()] * 6, pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["conv_id", "gaps", *FAULTS, "illegal", "cost", "audit", "repaired_sha256"])

    id_kind = dict(found.dtypes)["conv_id"]
    kind = _arrow_kind(found)
    return map_batches(found, run, _OUT.format(id_kind))


def _arrow_kind(df: DataFrame) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(df.schema["conv_id"].dataType)
