"""Repair of conversation structure as a cheapest path, found by the auction algorithm.

A conversation is a lattice: its nodes are (row, state), where the state says which roles may come
next, and its arcs are the edits with their whole costs. The auction algorithm keeps a path from the
start and a price per node that never exceeds the cost of an arc plus the price behind it: it extends
the path over an arc that meets the price, or raises the price of the path's end and contracts. When
the path reaches the goal, arcs that meet their price (tight ones) are exactly those of cheapest
paths; the audit is the first of them in ASCII order.

Rows are dealt by ranges of (conversation, turn), so one conversation may lie in many tasks. One that
lies in a single block of `BLOCK` rows is decided there. Longer ones go through their blocks: costs
from every entry state to every exit state, prices of the block borders from the last block to the
first, edits of every block for every entry state, and the states really entered, from the first
block to the last. Only the digest and the audit of a conversation, which are sequential, pass a
single task, block by block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from vulnspark.llm.common import Memo, Store, rows

BLOCK = 64
USER, ASSISTANT = "user", "assistant"
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
LEFT_TRUNCATED = 5
#: Faults of a row.
BLANK, DUPLICATE, TRUNCATED, SOUND = "b", "d", "t", "-"
#: States: nothing yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, ASKED, ANSWERED = STATES = range(4)
#: The one role of u and a that each state allows next.
NEXT = {START: ("u", ASKED), SYSTEM: ("u", ASKED), ASKED: ("a", ANSWERED), ANSWERED: ("u", ASKED)}
ROLES = {"u": USER, "a": ASSISTANT}
#: Behind the last row only these states may stand.
FINAL = {START: 0, ANSWERED: 0}
LEGAL_PAIRS = {"su", "ua", "au"}
UNREACHABLE = 1 << 40
Arcs = list[list[tuple[str, int, int]]]


# --- the lattice and the auction ---


def leading(arcs: Arcs) -> Arcs:
    """The arcs from whose far end the last node can be reached."""
    behind: list[list[int]] = [[] for _ in arcs]
    for i, here in enumerate(arcs):
        for _, _, to in here:
            behind[to].append(i)
    leads, open_ = {len(arcs) - 1}, [len(arcs) - 1]
    while open_:
        for i in behind[open_.pop()]:
            if i not in leads:
                leads.add(i)
                open_.append(i)
    return [[a for a in here if a[2] in leads] for here in arcs]


def arcs_of(initials: str, faults: str, ends: dict[int, int], last: bool) -> Arcs:
    """Arcs (edit, cost, node behind it) of every node.

    Node 4 * i + state lies before row i; the goal is the last node. `ends` has the cost from each
    state behind the rows to the end of the conversation. Insertions before a row belong to it,
    those behind the rows only exist where `last`. Arcs that lead nowhere are left out.
    """
    goal, arcs = 4 * len(faults) + 4, []
    for i, (initial, fault) in enumerate(zip(initials, faults, strict=True)):
        extra = LEFT_TRUNCATED if fault == TRUNCATED else 0
        for state in STATES:
            role, then = NEXT[state]
            here = [(DELETE, COSTS[DELETE], 4 * (i + 1) + state), (INSERT, COSTS[INSERT], 4 * i + then)]
            if fault not in (BLANK, DUPLICATE):
                if initial == role:
                    here.append((KEEP, COSTS[KEEP] + extra, 4 * (i + 1) + then))
                elif initial == "s" and state == START:
                    here.append((KEEP, COSTS[KEEP] + extra, 4 * (i + 1) + SYSTEM))
                here.append((REROLE, COSTS[REROLE] + extra, 4 * (i + 1) + then))
            arcs.append(here)
    for state in STATES:
        here = [("", ends[state], goal)] if state in ends else []
        if last:
            here.append((INSERT, COSTS[INSERT], 4 * len(faults) + NEXT[state][1]))
        arcs.append(here)
    return leading([*arcs, []])


def first_prices(arcs: Arcs) -> list[int]:
    """Prices no arc exceeds: the least cost of each later row, whatever the states."""
    prices = [0] * len(arcs)
    floor = min((cost for here in arcs[-5:-1] for edit, cost, _ in here if not edit), default=0)
    prices[-5:-1] = [floor] * 4
    for node in range(len(arcs) - 9, -1, -4):
        floor += min((cost for here in arcs[node : node + 4] for edit, cost, _ in here if edit != INSERT), default=0)
        prices[node : node + 4] = [floor] * 4
    return prices


def auction(arcs: Arcs, origin: int, prices: list[int]) -> int:
    """Cost of the cheapest path from `origin` to the last node; raises `prices` in place.

    Prices stay valid for another origin of the same lattice. Every arc leads to the goal and every
    cycle costs something, so the path gets there."""
    goal, path = len(arcs) - 1, [origin]
    if not arcs[origin]:
        return UNREACHABLE
    while (node := path[-1]) != goal:
        best, to = min((cost + prices[behind], behind) for _, cost, behind in arcs[node])
        if prices[node] == best:
            path.append(to)
            continue
        prices[node] = best
        if len(path) > 1:
            path.pop()
    return prices[origin]


def trace(arcs: Arcs, origin: int, prices: list[int]) -> tuple[str, int]:
    """Edits of the first path of tight arcs in ASCII order, and the state behind the rows.

    Arcs to a node whose price is still too low can be tight as well; no tight path leads from
    there to the goal, so they are left out first."""
    tight = leading([[a for a in here if prices[i] == a[1] + prices[a[2]]] for i, here in enumerate(arcs)])
    edits, node = [], origin
    while True:
        edit, _, to = min(tight[node])
        if to == len(arcs) - 1:
            return "".join(edits), node % 4
        edits.append(edit)
        node = to


def through(initials: str, faults: str) -> list[int]:
    """Cost from every entry state to every exit state of a block, entry by entry."""
    costs = {}
    for state in STATES:
        arcs = arcs_of(initials, faults, {state: 0}, False)
        prices = first_prices(arcs)
        for entry in STATES:
            costs[entry, state] = auction(arcs, entry, prices)
    return [costs[entry, state] for entry in STATES for state in STATES]


def edits_of(initials: str, faults: str, ends: dict[int, int], last: bool, entries=STATES):
    """(cost, edits, exit state) for each entry state; without a path there are no edits."""
    arcs = arcs_of(initials, faults, ends, last)
    prices, found = first_prices(arcs), []
    for entry in entries:
        cost = auction(arcs, entry, prices)
        found.append((cost, *trace(arcs, entry, prices)) if cost < UNREACHABLE else (cost, "", entry))
    return found


def repaired(rows: list[tuple[str, str]], edits: str, state: int) -> list[str]:
    """role:text of the rows (role, text) after the edits, entered in `state`."""
    out, i = [], 0
    for edit in edits:
        if edit != DELETE:
            role, then = NEXT[state]
            if edit == KEEP and rows[i][0][:1] == "s":
                then = SYSTEM
            text = "" if edit == INSERT else rows[i][1]
            out.append(f"{rows[i][0] if edit == KEEP else ROLES[role]}:{text}")
            state = then
        i += edit != INSERT
    return out


# --- damage and blocks ---


def damaged(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """(conv, turn, role, text, gone, copy, by_role, by_text): the rows after damage.

    A dropped row stays with `gone`, so that its conversation is known. Rows of one turn are in
    order of the role and text they had."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col))) % 20
    copies = F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    text = F.when(kind == 1, "").when(kind == 2, F.translate(spaced(text_col), ".!?", "")).otherwise(spaced(text_col))
    return turns.select(
        F.col(conv_col).alias("conv"),
        F.col(turn_col).alias("turn"),
        F.when(kind == 4, USER).otherwise(spaced(role_col)).alias("role"),
        text.alias("text"),
        (kind == 0).alias("gone"),
        spaced(role_col).alias("by_role"),
        spaced(text_col).alias("by_text"),
        F.explode(copies).alias("copy"),
    )


def _dealt(rows: DataFrame) -> DataFrame:
    """Rows in ranges of their order; long texts stay out of the sample of range borders."""
    order = ["conv", "turn", "by_role", F.substring("by_text", 1, 24)]
    within = ["conv", "turn", "by_role", "by_text", "copy"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*within).select("conv", "turn", "role", "text", "gone")


def _fault(text: str) -> str:
    said = text.rstrip(" \t\n\v\f\r")
    if not said:
        return BLANK
    return SOUND if said[-1] in ".!?" else TRUNCATED


def _initials(roles: list[str]) -> str:
    """One character per role; an empty role has one that stands for no role."""
    return "".join(r[:1] or "?" for r in roles)


class Report:
    """Counts, audit and digest of a conversation, from its blocks in order."""

    def __init__(self):
        self.counts = dict.fromkeys((BLANK, DUPLICATE, TRUNCATED), 0)
        self.illegal = self.distinct = 0
        self.low = self.high = self.role = None
        self.audit, self.sha, self.state = [], hashlib.sha256(), START
        self.begun = False

    def add(self, turns: list, roles: list[str], texts: list[str], faults: str, edits: str, then: int) -> None:
        for kind in self.counts:
            self.counts[kind] += faults.count(kind)
        for role in roles:
            self.illegal += self.role is not None and self.role[:1] + role[:1] not in LEGAL_PAIRS
            self.role = role
        for turn in turns:
            if turn is not None:
                self.low = turn if self.low is None else self.low
                self.distinct += turn != self.high
                self.high = turn
        self.audit.append(edits)
        for line in repaired(list(zip(roles, texts, strict=True)), edits, self.state):
            self.sha.update((f"\n{line}" if self.begun else line).encode())
            self.begun = True
        self.state = then

    def result(self, cost: int) -> dict:
        return {
            "gaps": self.high - self.low + 1 - self.distinct if self.distinct else 0,
            "blank": self.counts[BLANK],
            "duplicate": self.counts[DUPLICATE],
            "truncated": self.counts[TRUNCATED],
            "illegal": self.illegal,
            "cost": cost,
            "audit": "".join(self.audit),
            "repaired_sha256": self.sha.hexdigest(),
        }


RESULT = T.StructType(
    [
        *(T.StructField(c, T.LongType()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")),
        T.StructField("audit", T.StringType()),
        T.StructField("repaired_sha256", T.StringType()),
    ]
)
LONGS, STRINGS = T.ArrayType(T.LongType()), T.ArrayType(T.StringType())
KEY = [T.StructField("key", T.StringType()), T.StructField("part", T.IntegerType()), T.StructField("block", T.IntegerType())]


def _sent(found: Iterator[tuple], schema: T.StructType, text: int | None = None) -> Iterator[pa.RecordBatch]:
    """Rows as batches of at most 1000 rows and about 4 MB of the texts in column `text`."""
    arrow, held, size = to_arrow_schema(schema), [], 0

    def batch() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), arrow, strict=True)]
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    for row in found:
        held.append(row)
        size += sum(map(len, row[text] or ())) if text is not None else 0
        if len(held) == 1000 or size > 4 << 20:
            yield batch()
            held, size = [], 0
    if held:
        yield batch()


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from rows(batch)


def _in_order(blocks: DataFrame, back: bool = False) -> DataFrame:
    """All blocks of a conversation in one task, which takes them one by one."""
    part, block = F.col("part"), F.col("block")
    return blocks.repartition("key").sortWithinPartitions("key", *((part.desc(), block.desc()) if back else (part, block)))


def _blocks(schema: T.StructType, most: int):
    """Per range of rows: results of conversations that are one block and lie inside, blocks of the rest."""

    def solve(pattern: tuple[str, str]):
        return edits_of(*pattern, FINAL, True, (START,))[0]

    def whole(turns, roles, texts, faults, known: Memo) -> dict:
        seen, marked = set(), []
        for said, fault in zip(zip(roles, texts, strict=True), faults, strict=True):
            marked.append(DUPLICATE if fault != BLANK and said in seen else fault)
            seen.add(said)
        cost, edits, then = known[_initials(roles), "".join(marked)]
        report = Report()
        report.add(turns, roles, texts, "".join(marked), edits, then)
        return report.result(cost)

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        part, known = TaskContext.get().partitionId(), Memo(solve)
        first, held = True, None
        for conv, group in groupby(_streamed(batches), key=lambda r: r[0]):
            if held:
                # Not the last conversation of the range, and not the first one either.
                yield (*held[:3], whole(*held[4:], known), *[None] * 4) if held[3] else (*held[:3], None, *held[4:])
            number, block = 0, ([], [], [], [])
            for _, turn, role, text, gone in group:
                if gone:
                    continue
                if len(block[0]) == most:
                    yield (conv, part, number, None, *block[:3], "".join(block[3]))
                    number, block = number + 1, ([], [], [], [])
                for column, value in zip(block, (turn, role, text, _fault(text)), strict=True):
                    column.append(value)
            held = (conv, part, number, not first and not number, *block[:3], "".join(block[3]))
            first = False
        if held:
            yield (*held[:3], None, *held[4:])

    return lambda batches: _sent(found(batches), schema, 6)


def _crossings(schema: T.StructType):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        known = Memo(lambda pattern: through(*pattern))
        for key, part, block, initials, faults in _streamed(batches):
            yield key, part, block, known[initials, faults]

    return lambda batches: _sent(found(batches), schema)


def _border_prices(schema: T.StructType):
    """Cost from every state behind a block to the end, from the last block to the first."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        closing = [cost for cost, _, _ in edits_of("", "", FINAL, True)]
        for key, group in groupby(_streamed(batches), key=lambda r: r[0]):
            behind, last = closing, True
            for _, part, block, costs in group:
                yield key, part, block, behind, last
                behind = [min(costs[4 * s + t] + behind[t] for t in STATES) for s in STATES]
                last = False

    return lambda batches: _sent(found(batches), schema)


def _edits(schema: T.StructType):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, part, block, initials, faults, behind, last in _streamed(batches):
            ends = FINAL if last else {s: c for s, c in enumerate(behind) if c < UNREACHABLE}
            yield key, part, block, *map(list, zip(*edits_of(initials, faults, ends, last), strict=True))

    return lambda batches: _sent(found(batches), schema)


def _entered(schema: T.StructType):
    """The edits of the state that each block is entered in, from the first block to the last."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for key, group in groupby(_streamed(batches), key=lambda r: r[0]):
            state = START
            for _, part, block, costs, edits, exits in group:
                yield key, part, block, costs[state], edits[state], exits[state]
                state = exits[state]

    return lambda batches: _sent(found(batches), schema)


def _assembled(schema: T.StructType):
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, group in groupby(_streamed(batches), key=lambda r: r[0]):
            report, total = Report(), None
            for _, _, _, conv, turns, roles, texts, faults, cost, edits, then in group:
                total = cost if total is None else total
                report.add(turns, roles, texts, faults, edits, then)
            yield conv, report.result(total)

    return lambda batches: _sent(found(batches), schema)


def _long_conversations(store: Store, pieces: DataFrame, conv: T.StructField) -> DataFrame:
    """Results (conv, result) of conversations that lie in several blocks or on the edge of a range."""
    place = F.struct("part", "block", "at")
    said = F.posexplode(F.arrays_zip("roles", "texts")).alias("at", "row")
    told = pieces.select("key", "part", "block", "faults", said).filter(F.substring(F.col("faults"), F.col("at") + 1, F.lit(1)) != BLANK)
    name = F.sha2(F.concat(F.length("row.roles").cast("string"), F.lit(":"), "row.roles", "row.texts"), 256)
    told = told.select("key", "part", "block", "at", name.alias("name"))
    again = told.groupBy("key", "name").agg(F.min(place).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = store.save(again.drop("n"), "repeats")
    repeats = told.join(again, ["key", "name"]).filter(place > F.col("first"))
    repeats = repeats.groupBy("key", "part", "block").agg(F.collect_list("at").alias("repeats"))
    letters = F.filter(F.split("faults", ""), lambda c: c != "")
    marked = F.array_join(
        F.transform(letters, lambda c, i: F.when(F.array_contains("repeats", i), DUPLICATE).otherwise(c)), ""
    )
    initials = F.array_join(
        F.transform("roles", lambda r: F.when(r == "", "?").otherwise(F.substring(r, 1, 1))), ""
    )
    at = ["key", "part", "block"]
    none = F.array().cast("array<int>")
    faults = pieces.join(repeats, at, "left").withColumn("repeats", F.coalesce("repeats", none))
    patterns = store.save(faults.select(*at, initials.alias("initials"), marked.alias("faults")), "patterns")

    crossed = T.StructType([*KEY, T.StructField("costs", LONGS)])
    priced = T.StructType([*KEY, T.StructField("behind", LONGS), T.StructField("last", T.BooleanType())])
    told_edits = T.StructType(
        [*KEY, T.StructField("costs", LONGS), T.StructField("edits", STRINGS), T.StructField("exits", LONGS)]
    )
    chosen = T.StructType(
        [*KEY, T.StructField("cost", T.LongType()), T.StructField("edits", T.StringType()), T.StructField("then", T.LongType())]
    )
    costs = patterns.mapInArrow(_crossings(crossed), crossed)
    prices = _in_order(costs, back=True).mapInArrow(_border_prices(priced), priced)
    every = patterns.join(prices, at).mapInArrow(_edits(told_edits), told_edits)
    taken = store.save(_in_order(every).mapInArrow(_entered(chosen), chosen), "edits")
    whole = pieces.drop("faults").join(patterns.select(*at, "faults"), at).join(taken, at)
    columns = [*at, "conv", "turns", "roles", "texts", "faults", "cost", "edits", "then"]
    done = T.StructType([conv, T.StructField("result", RESULT)])
    return _in_order(whole.select(*columns)).mapInArrow(_assembled(done), done)


def repair(
    turns: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    block: int = BLOCK,
) -> DataFrame:
    """One row per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit and
    repaired_sha256, of the rows after damage.

    Null roles and texts are one space, as are nulls in the damage's key; null turns come first and
    do not count in gaps; null ids are one conversation. Rows of one turn are in order of the role
    and text they had before the damage, so the result does not depend on the order of the input;
    rows alike in all that are repeats of each other. A conversation that loses all rows has zeros,
    an empty audit and the digest of the empty text. Texts of any length are read whole. Other
    columns are not read; an empty table gives an empty result.
    """
    store = Store(turns.sparkSession)
    conv = T.StructField("conv", turns.schema[conv_col].dataType)
    turn_type = turns.schema[turn_col].dataType
    schema = T.StructType(
        [
            conv,
            *KEY[1:],
            T.StructField("result", RESULT),
            T.StructField("turns", T.ArrayType(turn_type)),
            T.StructField("roles", STRINGS),
            T.StructField("texts", STRINGS),
            T.StructField("faults", T.StringType()),
        ]
    )
    dealt = _dealt(damaged(turns, conv_col, turn_col, role_col, text_col))
    made = store.save(dealt.mapInArrow(_blocks(schema, block), schema), "conversations")
    key = F.to_json(F.struct("conv")).alias("key")
    long = _long_conversations(store, made.filter("result IS NULL").select(key, *made.drop("result").columns), conv)
    both = made.filter("result IS NOT NULL").select("conv", "result").unionByName(long)
    return both.select(F.col("conv").alias(conv_col), "result.*")
