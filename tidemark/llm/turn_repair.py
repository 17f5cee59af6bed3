"""Repair of conversation structure by a run-length dynamic programme over min-plus transitions."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import crc32_sql, query, saved, table
from tidemark.operators.ordering import BUCKET, bucketed

# The costs of edits, the modulus of damage, what ends a sentence, what is space.
DELETE, REROLE, INSERT, UNFINISHED = 2, 1, 5, 5
DAMAGE = 20
SPACES = " \t\n\x0b\x0c\r"

# States: nothing yet, after a system turn, after a user's, after an assistant's. A conversation may end in 0 and 3.
STATES = range(4)
TURN_OF = {2: "user", 3: "assistant"}
# Where a turn by each initial may follow, and what a new or renamed turn has to be.
FOLLOWS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}, "": {}}
NEW = {0: 2, 1: 2, 2: 3, 3: 2}
ENDS = {0: 0, 1: 2, 2: 1, 3: 0}
LEGAL = {"su", "ua", "au"}
CLEAN, TRUNCATED, BLANK, DUPLICATE = range(4)
# A symbol is an initial with or without an unfinished text, or a turn that must go.
INITIALS = ["", "s", "u", "a"]
GONE = 2 * len(INITIALS)
FAR = 1 << 60

Vector = tuple[int, ...]
Matrix = tuple[Vector, ...]


def moves(symbol: int, state: int) -> list[tuple[int, str, int]]:
    """Cost, audit letters and next state of each way to deal with one turn; up to two new turns may come before it."""
    out = []
    for k in range(3):
        letters = "I" * k
        out.append((k * INSERT + DELETE, letters + "D", state))
        if symbol != GONE:
            fault = UNFINISHED * (symbol % 2)
            after = FOLLOWS[INITIALS[symbol // 2]].get(state)
            if after is not None:
                out.append((k * INSERT + fault, letters + "K", after))
            out.append((k * INSERT + REROLE + fault, letters + "R", NEW[state]))
        state = NEW[state]
    return out


def product(a: Matrix, b: Matrix) -> Matrix:
    return tuple(tuple(min(a[i][k] + b[k][j] for k in STATES) for j in STATES) for i in STATES)


@lru_cache(None)
def power(symbol: int, bit: int) -> Matrix:
    """The min-plus transition of 2^bit turns of one symbol."""
    if bit:
        return product(power(symbol, bit - 1), power(symbol, bit - 1))
    ways = [moves(symbol, i) for i in STATES]
    return tuple(tuple(min((c for c, _, to in ways[i] if to == j), default=FAR) for j in STATES) for i in STATES)


@lru_cache(1 << 16)
def advanced(symbol: int, count: int, after: Vector) -> Vector:
    """Costs from each state before a run, given the costs after it."""
    for bit in range(count.bit_length()):
        if count >> bit & 1:
            m = power(symbol, bit)
            after = tuple(min(m[i][j] + after[j] for j in STATES) for i in STATES)
    return after


@lru_cache(1 << 16)
def chosen(symbol: int, state: int, after: Vector) -> tuple[str, int]:
    """The letters of the cheapest way to deal with a turn, the least in ASCII among equals, and the next state."""
    _, letters, to = min((cost + after[to], letters, to) for cost, letters, to in moves(symbol, state))
    return letters, to


def level(v: Vector) -> Vector:
    """Costs above the least: choices depend on differences only, so few vectors are met and remembered."""
    low = min(v)
    return tuple(min(x - low, FAR) for x in v)


FINAL: Vector = tuple(INSERT * ENDS[s] for s in STATES)


def runs_of(symbols: list[tuple[int, int]]) -> list[list[int]]:
    """``[symbol, count]`` of runs; each entry is a turn's symbol and its number of equal copies, which must go."""
    runs: list[list[int]] = []
    for symbol, copies in symbols:
        for s, n in ((symbol, 1), (GONE, copies - 1)):
            if n and runs and runs[-1][0] == s:
                runs[-1][1] += n
            elif n:
                runs.append([s, n])
    return runs


def transition(runs: list[list[int]]) -> Matrix:
    """The min-plus transition of all runs together."""
    columns = []
    for to in STATES:
        v: Vector = tuple(0 if s == to else FAR for s in STATES)
        for symbol, count in reversed(runs):
            v = tuple(min(x, FAR) for x in advanced(symbol, count, v))
        columns.append(v)
    return tuple(tuple(columns[j][i] for j in STATES) for i in STATES)


def unrolled(symbols: list[tuple[int, int]], state: int, after: Vector) -> tuple[list[tuple[int, str]], int]:
    """For each turn the state before it and its letters (its copies go), and the state at the end."""
    runs = runs_of(symbols)
    later = [level(after)]
    for symbol, count in reversed(runs):
        later.append(level(advanced(symbol, count, later[-1])))
    later.reverse()
    out, r, left = [], 0, runs[0][1]
    for symbol, copies in symbols:
        if not left:
            r, left = r + 1, runs[r + 1][1]
        left -= 1
        start = state
        letters, state = chosen(symbol, state, level(advanced(symbol, left, later[r + 1])))
        out.append((start, letters))
        if copies > 1:
            if not left:
                r, left = r + 1, runs[r + 1][1]
            left -= copies - 1
    return out, state


def inserted(state: int, letters: str) -> str:
    """Initials of the turns that the letters add, from a state on."""
    names = ""
    for _ in range(letters.count("I")):
        state = NEW[state]
        names += TURN_OF[state][0]
    return names


def damaged(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of the rows that the fixed damage leaves; null roles and texts are one space.

    By crc32 of ``conv_id:turn`` modulo 20 a row is dropped, emptied, stripped of what ends sentences, doubled or made the user's.
    """
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    kind = F.pmod(F.crc32(named.cast("binary")), F.lit(DAMAGE))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).where("kind != 0")
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.when(F.col("kind") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, F.lit("")).when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).alias("copies"),
    )


def row_names() -> dict[str, Column]:
    """128 bits that tell different rows apart."""
    parts = [F.col("conv_id").isNull(), F.col("turn").isNull(), "conv_id", "turn", "role", "text"]
    return {"x": F.xxhash64(*parts), "y": F.xxhash64(F.lit("row"), *parts)}


def symbols_of(rows: DataFrame) -> DataFrame:
    """Different rows without their texts: ``conv_id, turn, role, m, x, y, initial, fault, n``.

    ``n`` counts equal rows, which stand side by side; ``m`` is the MD5 of the
    text and orders the rows of one turn, after role. A fault is that of the first of them.
    """
    end = F.rtrim("text", F.lit(SPACES))
    fault = F.when(end == "", BLANK).when(~F.substring(end, -1, 1).isin(*".!?"), TRUNCATED).otherwise(CLEAN)
    initial = F.substring("role", 1, 1)
    keys = ["conv_id", "turn", "role", "m", "x", "y", "initial", "fault"]
    narrow = rows.select(
        "conv_id",
        "turn",
        "role",
        F.unhex(F.md5("text")).alias("m"),
        *[c.alias(n) for n, c in row_names().items()],
        F.when(initial.isin("s", "u", "a"), initial).otherwise("").alias("initial"),
        fault.alias("fault"),
        "copies",
    )
    one = saved(narrow.groupBy(*keys).agg(F.sum("copies").alias("n")), "repair-rows")
    # a text that a role says in several turns; null turns come first, and so does the least of the struct
    place = F.struct(F.col("turn").isNotNull().alias("later"), "turn")
    texts = one.groupBy("conv_id", "role", "m").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("k")).where("k > 1")
    again = texts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("m").alias("t"), "first")
    same = one["conv_id"].eqNullSafe(again["c"]) & (one["role"] == again["r"]) & (one["m"] == again["t"])
    repeat = F.col("first").isNotNull() & (place > F.col("first")) & (F.col("fault") != BLANK)
    return one.join(again, same, "left").select(
        *[c for c in one.columns if c != "fault"], F.when(repeat, DUPLICATE).otherwise(F.col("fault")).alias("fault")
    )


def in_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows of equal leading columns."""
    rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns], strict=True))
    for key, own in groupby(rows, key=lambda r: r[:keys]):
        yield key, list(own)


def in_batches(rows: Iterator[tuple], schema: pa.Schema, size: int = 4096) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), schema.types, strict=True)], schema=schema)


def _symbol(initial: str, fault: int) -> int:
    return GONE if fault >= BLANK else 2 * INITIALS.index(initial) + (fault == TRUNCATED)


PART = pa.schema([("b", pa.int32()), ("c", pa.int64()), ("matrix", pa.list_(pa.list_(pa.int64())))])
AFTER = pa.schema([("b", pa.int32()), ("c", pa.int64()), ("after", pa.list_(pa.int64())), ("last", pa.bool_())])
EXITS = pa.schema([*AFTER, ("exits", pa.list_(pa.int32()))])
ENTRY = pa.schema([*AFTER, ("entry", pa.int32())])
PART_TYPE = "b int, c long, matrix array<array<long>>"
AFTER_TYPE = "b int, c long, after array<long>, last boolean"
EXITS_TYPE, ENTRY_TYPE = f"{AFTER_TYPE}, exits array<int>", f"{AFTER_TYPE}, entry int"
EDITS = pa.schema(
    [
        ("conv_id", pa.int64()),
        ("place", pa.int64()),
        ("turn", pa.int64()),
        ("x", pa.int64()),
        ("y", pa.int64()),
        ("initial", pa.string()),
        ("fault", pa.int32()),
        ("n", pa.int64()),
        ("inserted", pa.string()),
        ("edit", pa.string()),
        ("to_role", pa.string()),
    ]
)
EDITS_TYPE = (
    "conv_id long, place long, turn long, x long, y long, initial string, fault int, n long, inserted string, edit string, to_role string"
)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out = ((*key, transition(runs_of([(_symbol(i, f), n) for *_, i, f, n in own]))) for key, own in in_groups(batches, 2))
    return in_batches(out, PART)


def _afters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Backward over a conversation's parts: the costs that are left after each."""

    def rows() -> Iterator[tuple]:
        for _, own in in_groups(batches, 1):
            after: Vector = FINAL
            for k, (c, b, m) in enumerate(own):
                yield b, c, after, k == 0
                after = level(tuple(min(m[i][j] + after[j] for j in STATES) for i in STATES))

    return in_batches(rows(), AFTER)


def _exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The state at the end of a part for each state before it."""

    def rows() -> Iterator[tuple]:
        for key, own in in_groups(batches, 2):
            symbols = [(_symbol(i, f), n) for *_, i, f, n, _, _ in own]
            after, last = tuple(own[0][-2]), own[0][-1]
            yield *key, after, last, [unrolled(symbols, s, after)[1] for s in STATES]

    return in_batches(rows(), EXITS)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Forward over a conversation's parts: the state before each."""

    def rows() -> Iterator[tuple]:
        for _, own in in_groups(batches, 1):
            state = 0
            for c, b, after, last, exits in own:
                yield b, c, after, last, state
                state = exits[state]

    return in_batches(rows(), ENTRY)


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        for (bucket, conv), own in in_groups(batches, 2):
            after, last, entry = own[0][-3:]
            symbols = [(_symbol(i, f), n) for *_, i, f, n, _, _, _ in own]
            done, state = unrolled(symbols, entry or 0, FINAL if after is None else tuple(after))
            at = bucket << 40
            for (_, _, turn, x, y, initial, fault, n, *_), (start, letters) in zip(own, done, strict=True):
                at += 1
                new = inserted(start, letters)
                role = TURN_OF[NEW[{"u": 2, "a": 3}[new[-1]] if new else start]] if letters[-1] == "R" else None
                yield conv, at, turn, x, y, initial, fault, n, new, letters[-1], role
            if last is not False and ENDS[state]:
                yield conv, at + 1, None, None, None, None, None, 0, inserted(state, "I" * ENDS[state]), "", None

    return in_batches(rows(), EDITS)


def repairs(rows: DataFrame, buckets: int | None = None) -> DataFrame:
    """The cheapest edits that give each conversation the form ``(s?(ua)+)?``, without texts.

    One row for each different row of ``conv_id, turn, role, text, copies``, in the
    order of ``place`` within a conversation: its ``fault``, the initials of turns
    ``inserted`` before it, its ``edit`` (K, R, D; the other ``n - 1`` copies are
    deleted) and ``to_role`` of a new role; ``x, y`` name the row. A last row of a
    conversation without ``edit`` adds turns at its end.

    Conversations are read in buckets along their turns. One that reaches over
    several is first folded to a min-plus transition a bucket, and the few
    transitions are then passed backward and forward, so no task reads a
    conversation whole. There are fewer such rows than twice the buckets.
    """
    cut = saved(bucketed(symbols_of(rows), ["conv_id"], ["turn", "role", "m"], buckets), "repair-symbols")
    order = [BUCKET, "conv_id", "turn", "role", "m"]
    cells = cut.groupBy("conv_id", BUCKET).agg(F.lit(1).alias("one"))
    wide = cells.groupBy("conv_id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("conv_id").alias("c"))
    long = cut.join(F.broadcast(wide), cut["conv_id"].eqNullSafe(wide["c"])).drop("c")
    dealt = long.repartition(BUCKET, "conv_id").sortWithinPartitions(*order)
    parts = dealt.select(BUCKET, "conv_id", "initial", "fault", "n").mapInArrow(_parts, PART_TYPE)
    back = parts.select("c", "b", "matrix").repartition("c").sortWithinPartitions("c", F.desc("b"))
    after = saved(back.mapInArrow(_afters, AFTER_TYPE), "repair-after")
    same = (cut[BUCKET] == after["b"]) & cut["conv_id"].eqNullSafe(after["c"])
    walked = cut.join(F.broadcast(after), same).repartition(BUCKET, "conv_id").sortWithinPartitions(*order)
    exits = walked.select(BUCKET, "conv_id", "initial", "fault", "n", "after", "last").mapInArrow(_exits, EXITS_TYPE)
    ahead = exits.select("c", "b", "after", "last", "exits").repartition("c").sortWithinPartitions("c", "b")
    entry = saved(ahead.mapInArrow(_entries, ENTRY_TYPE), "repair-entries")
    same = (cut[BUCKET] == entry["b"]) & cut["conv_id"].eqNullSafe(entry["c"])
    every = cut.join(F.broadcast(entry), same, "left").repartition(BUCKET, "conv_id").sortWithinPartitions(*order)
    return every.select(
        BUCKET, "conv_id", "turn", "x", "y", "initial", "fault", "n", "after", "last", "entry"
    ).mapInArrow(_edits, EDITS_TYPE)


def repaired(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """The edits with ``role`` and ``text`` of their rows; null for turns added at the end."""
    names = row_names()
    texts = rows.select("role", "text", *[c.alias(n) for n, c in names.items()])
    one = texts.groupBy("x", "y").agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return edits.join(one, ["x", "y"], "left")


DIGEST = pa.schema(
    [
        ("conv_id", pa.int64()),
        *[(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")],
        ("audit", pa.string()),
        ("repaired_sha256", pa.string()),
    ]
)
DIGEST_TYPE = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)


class Report:
    """What is told of one conversation, row by row in order; texts are hashed as they pass."""

    def __init__(self) -> None:
        self.faults, self.illegal, self.cost, self.audit = [0, 0, 0, 0], 0, 0, []
        self.low = self.high = self.before = None
        self.turns, self.lines, self.digest = 0, 0, hashlib.sha256()

    def line(self, role: str, text: str) -> None:
        self.digest.update((("\n" if self.lines else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.lines += 1

    def add(self, turn, initial, fault, n, new, edit, to_role, role, text) -> None:
        for name in new:
            self.line({"u": "user", "a": "assistant"}[name], "")
        self.audit.append("I" * len(new) + edit)
        self.cost += INSERT * len(new)
        if not edit:
            return
        if turn is not None and turn != self.high:
            self.low = turn if self.low is None else self.low
            self.high = turn
            self.turns += 1
        self.faults[fault] += 1
        self.faults[BLANK if fault == BLANK else DUPLICATE] += n - 1
        self.illegal += n - 1 + (self.before is not None and self.before + initial not in LEGAL)
        self.before = initial
        self.audit.append("D" * (n - 1))
        self.cost += DELETE * (n - 1) + {"K": 0, "R": REROLE, "D": DELETE}[edit]
        if edit != "D":
            self.cost += UNFINISHED * (fault == TRUNCATED)
            self.line(to_role or role, text)

    def row(self, conv: int | None) -> tuple:
        gaps = self.high - self.low + 1 - self.turns if self.turns else 0
        told = self.faults[BLANK], self.faults[DUPLICATE], self.faults[TRUNCATED], self.illegal, self.cost
        return conv, gaps, *told, "".join(self.audit), self.digest.hexdigest()


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[tuple]:
        report = conv = None
        for batch in batches:
            for c, place, *rest in zip(*[x.to_pylist() for x in batch.columns], strict=True):
                if place is None:
                    if report:
                        yield report.row(conv)
                    report, conv = Report(), c
                else:
                    report.add(*rest)
        if report:
            yield report.row(conv)

    return in_batches(rows(), DIGEST)


def reports(turns: DataFrame, edits: DataFrame) -> DataFrame:
    """One row per conversation of ``turns``: faults, cost, audit and the SHA-256 of the repaired turns.

    A digest is sequential by nature: a task streams a conversation's rows in
    order and holds one at a time, besides the audit.
    """
    every = turns.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    told = edits.select("conv_id", "place", "turn", "initial", "fault", "n", "inserted", "edit", "to_role", "role", "text")
    both = told.unionByName(every, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions("conv_id", "place").mapInArrow(_reports, DIGEST_TYPE)


def _sql() -> str:
    """The same by a walk backward over single turns, with audit and text carried along."""
    add = lambda c, a, r, g: f"{{'c': {c} + {g}.c, 's': '{a}' || {g}.s, 'r': {r} || {g}.r}}"
    nothing = "{'c': 1000000000, 's': '', 'r': ''}"
    names = {s: f"chr(10) || '{r}:'" for s, r in TURN_OF.items()}
    steps, opened = [], []
    for q in STATES:
        ways = [add(DELETE, "D", "''", f"g{q}")]
        for i, to in ((i, FOLLOWS[i][q]) for i in "sua" if q in FOLLOWS[i]):
            kept = add("fault", "K", "chr(10) || role || ':' || text", f"g{to}")
            ways.append(f"CASE WHEN gone OR initial <> '{i}' THEN {nothing} ELSE {kept} END")
        ways.append(f"CASE WHEN gone THEN {nothing} ELSE {add('1 + fault', 'R', names[NEW[q]] + ' || text', f'g{NEW[q]}')} END")
        steps.append(f"least({', '.join(ways)}) AS e{q}")
        once, twice = NEW[q], NEW[NEW[q]]
        two = add(2 * INSERT, "II", f"{names[once]} || {names[twice]}", f"e{twice}")
        opened.append(f"least(e{q}, {add(INSERT, 'I', names[once], f'e{once}')}, {two}) AS g{q}")
    ends = {0: ("0", "", "''"), 1: ("10", "II", f"{names[2]} || {names[3]}"), 2: ("5", "I", names[3]), 3: ("0", "", "''")}
    final = ", ".join(f"{{'c': {c}, 's': '{a}', 'r': {r}}} AS g{q}" for q, (c, a, r) in ends.items())
    crc = crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")
    return rf"""
WITH RECURSIVE k AS (
    SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {crc} % 20 AS kind FROM conversations
), d AS (
    SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role,
        CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
    FROM k JOIN range(2) c(copy) ON kind <> 0 AND (copy = 0 OR kind = 3)
), o AS (
    SELECT *, row_number() OVER w AS i,
        regexp_extract(text, '([^ 	-
])[ 	-
]*$', 1) AS ending, left(role, 1) AS initial
    FROM d WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text))
), p AS (
    SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again FROM o
), f AS (
    SELECT *, CASE WHEN ending = '' THEN 'blank' WHEN again THEN 'duplicate' WHEN ending NOT IN ('.', '!', '?') THEN 'truncated' ELSE '' END AS kind,
        lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
    FROM p
), r AS (
    SELECT *, kind IN ('blank', 'duplicate') AS gone, CASE kind WHEN 'truncated' THEN 5 ELSE 0 END AS fault FROM f
), best AS (
    SELECT conv_id, max(i) AS i, {final} FROM r GROUP BY conv_id
    UNION ALL
    SELECT conv_id, i - 1, {", ".join(opened)} FROM (
        SELECT best.conv_id, best.i, {", ".join(steps)} FROM best JOIN r ON r.conv_id IS NOT DISTINCT FROM best.conv_id AND r.i = best.i
    )
), told AS (
    SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (kind = 'blank') AS blank,
        count(*) FILTER (kind = 'duplicate') AS duplicate, count(*) FILTER (kind = 'truncated') AS truncated,
        count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
    FROM r GROUP BY conv_id
)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
    coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(g0.c, 0)::BIGINT AS cost, coalesce(g0.s, '') AS audit,
    sha256(coalesce(g0.r[2:], '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN told ON told.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id AND best.i = 0
"""


@query("op11_turn_repair", _sql())
def op11_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation after damage, repaired at the least cost."""
    turns = table(spark, sf_dir, "conversations")
    rows = damaged(turns)
    edits = saved(repairs(rows), "repair-edits")
    return reports(turns, repaired(rows, edits))
