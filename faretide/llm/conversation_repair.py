"""Cheapest repair of conversations: which turns to keep, re-role, delete or insert.

A repaired conversation is empty, or an optional system turn followed by one or more pairs of user and
assistant. Turns are reduced to signs: the initial of the role (s, u, a, or ``-`` for any other), as a capital
(``_`` for the others) if the text is cut off (truncated), or ``b`` and ``d`` for blank and duplicate turns, which must go. A conversation's
signature is the string of its signs.

Signatures are read from the end into a suffix-shared automaton (a DAWG): a node stands for one signature suffix,
whichever conversations end with it, and has one edge per sign that stands before it. Cost-to-go and best
edit suffix are worked out once per node and grammar state. Edits at a node begin with different letters, and where an
edit leads is fixed by the grammar, so of equally cheap edits the least letter gives the ASCII-least audit.
Signatures are dealt to tasks by range of their reversed text, so those that share a suffix stand side by side:
a task holds the path of one signature only, and a suffix is worked out again only where a task begins.

Conversations are cut into parts of ``PART_TURNS`` turns, so one with a third of all turns spreads over many tasks.
What lies behind a part matters through the cost-to-go of the four states alone. For parts of long conversations
these costs are found by products of 4 x 4 matrices (least sums) in blocks of ``FAN`` parts, block by block upwards
and back down, and the states in which parts are entered likewise by composing the parts' state maps.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faretide.llm.frames import keep, rank_in_order

PART_TURNS = 64
# Parts whose matrices or maps are combined at once.
FAN = 32
# Repaired turns go out in batches of about this many characters.
OUT_CHARS = 1 << 21

# Grammar states: nothing yet, after the system turn, after a user turn, after an assistant turn.
_WANTED = ("u", "u", "a", "u")
_NEXT = (2, 2, 3, 2)
STATES = 4
FAR = 1 << 40
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NAMES = {"u": "user", "a": "assistant"}
# Signs of truncated turns.
CUT = "SUA_"
# Cost-to-go at the end: only an empty conversation or one after an assistant turn is complete.
END = [0, FAR, FAR, 0]

_SIGN = r"[^\x20\x09-\x0D]"
_LAST = rf"({_SIGN})[\x20\x09-\x0D]*\z"


def _relax(costs: list[int], edits: list | None = None) -> list:
    """Allow inserts at one place; ``edits`` are (audit, end state) per state and change along."""
    # An insert leads to state 2 or 3, and these two cannot both gain by each other: one round is enough.
    for state in (2, 3, 1, 0):
        after = _NEXT[state]
        cost = costs[after] + INSERT
        if cost < costs[state] or (edits and cost == costs[state] < FAR and "I" < edits[state][0][:1]):
            costs[state] = cost
            if edits:
                edits[state] = ("I" + edits[after][0], edits[after][1])
    return [costs, edits]


def _step(sign: str, after: list[int], edits: list | None = None) -> list:
    """Costs (and edits) of the four states before a turn, from those behind it."""
    costs, made = [], []
    cut = TRUNCATED if sign in CUT else 0
    role = sign.lower()
    for state in range(STATES):
        options = [(after[state] + DELETE, "D", state)]
        if role not in "bd":
            if state == 0 and role == "s":
                options.append((after[1] + cut, "K", 1))
            onward = _NEXT[state]
            if role == _WANTED[state]:
                options.append((after[onward] + cut, "K", onward))
            options.append((after[onward] + REROLE + cut, "R", onward))
        cost, letter, onward = min(options)
        costs.append(cost)
        if edits:
            made.append((letter + edits[onward][0], edits[onward][1]))
    return _relax(costs, made if edits else None)


def walk(signatures: Iterator[tuple[str, tuple[int, ...]]]) -> Iterator[list]:
    """[costs, edits] of the node of each (signature, costs behind it).

    A node is reached from the node of the signature without its first sign. The path of the last signature is
    kept, and the next one goes on from the longest suffix both have.
    """
    path: list[list] = []
    last: tuple[str, tuple[int, ...] | None] = ("", None)
    for signature, behind in signatures:
        if behind != last[1]:
            path = [_relax(list(behind), [("", s) for s in range(STATES)])]
            shared = 0
        else:
            shared = 0
            for a, b in zip(reversed(signature), reversed(last[0])):
                if a != b:
                    break
                shared += 1
        del path[shared + 1 :]
        for sign in signature[len(signature) - shared - 1 :: -1] if shared < len(signature) else "":
            path.append(_step(sign, *path[-1]))
        last = (signature, behind)
        yield path[-1]


def matrix(signature: str) -> list[int]:
    """Least cost from each state before a part (rows) to each state behind it (columns)."""
    columns = []
    for goal in range(STATES):
        costs = _relax([0 if s == goal else FAR for s in range(STATES)])[0]
        for sign in reversed(signature):
            costs = _step(sign, costs)[0]
        columns.append(costs)
    return [min(columns[goal][s], FAR) for s in range(STATES) for goal in range(STATES)]


def damaged(rows: DataFrame) -> DataFrame:
    """Conversations with planted faults, chosen by checksum of ``conv_id:turn`` (null: one space) modulo 20.

    0 drops the turn, 1 empties its text, 2 takes ``[.!?]`` out of it, 3 repeats it at once, 4 makes it a user's.
    Null roles and texts become one space. Column ``lost`` marks dropped turns; null ids and turns stay null.
    """
    rows = _typed(rows)
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    fault = F.crc32(name) % 20
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    return rows.select(
        "conv_id",
        "turn",
        F.when(fault == 4, "user").otherwise(role).alias("role"),
        F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"),
        (fault == 0).alias("lost"),
        F.explode(F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_copy"),
    ).drop("_copy")


def _typed(rows: DataFrame) -> DataFrame:
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.col("role").cast("string").alias("role"),
        F.col("text").cast("string").alias("text"),
        *([F.col("lost").cast("boolean").alias("lost")] if "lost" in rows.columns else [F.lit(False).alias("lost")]),
    )


def _signed(rows: DataFrame) -> DataFrame:
    """``rows`` with their place in the conversation and their sign."""
    present = rows.filter(~F.coalesce("lost", F.lit(False))).select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit(" ")).alias("role"),
        F.coalesce("text", F.lit(" ")).alias("text"),
    )
    tied = present.withColumn("_tie", F.xxhash64("text"))
    placed = keep(rank_in_order(tied, ["conv_id"], ["turn", "role", "_tie"], "place"), "turns")
    same = ["conv_id", "role", "k1", "k2"]
    keyed = placed.withColumn("k1", F.xxhash64("text")).withColumn("k2", F.xxhash64("text", F.lit(1)))
    # Only texts that a conversation repeats are joined back, at their later places, spread by place.
    twice = keyed.groupBy(*same).agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    spread = F.lit(16)
    twice = twice.withColumn("_salt", F.explode(F.sequence(F.lit(0), spread - 1))).drop("n")
    keyed = keyed.withColumn("_salt", F.pmod(F.col("place"), spread).cast("int")).alias("r")
    on = F.col("r._salt") == F.col("t._salt")
    for c in same:
        on = on & F.col(f"r.{c}").eqNullSafe(F.col(f"t.{c}"))
    joined = keyed.join(twice.alias("t"), on, "left")
    initial = F.substring("r.role", 1, 1)
    initial = F.when(initial.isin("s", "u", "a"), initial).otherwise("-")
    ending = F.regexp_extract("r.text", _LAST, 1)
    sign = (
        F.when(ending == "", "b")
        .when(F.col("r.place") > F.col("t.first"), "d")
        .when(~ending.isin(".", "!", "?"), F.when(initial == "-", "_").otherwise(F.upper(initial)))
        .otherwise(initial)
    )
    return joined.select(
        F.col("r.conv_id").alias("conv_id"), "turn", "r.role", "text", "place", initial.alias("initial"), sign.alias("sign")
    )


def _parts(rows: DataFrame) -> DataFrame:
    """One row per part of a conversation: its turns, signature, initials (with the last one before it), and turn numbers."""
    # The last turn of a part is sent to the next part too, for its initial alone.
    part = F.floor(F.col("place") / PART_TURNS)
    to = F.when((F.col("place") + 1) % PART_TURNS == 0, F.array(part, part + 1)).otherwise(F.array(part))
    sent = rows.withColumn("part", F.explode(to)).withColumn("own", part == F.col("part"))
    item = F.struct(
        "place", "sign", "initial", "turn", "own", F.when(F.col("own"), F.struct("role", "text")).alias("said")
    )
    grouped = sent.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(item)).alias("items"))
    own = F.filter("items", lambda i: i["own"])
    return grouped.filter(F.exists("items", lambda i: i["own"])).select(
        "conv_id",
        "part",
        F.array_join(F.transform(own, lambda i: i["sign"]), "").alias("signature"),
        F.array_join(F.transform("items", lambda i: i["initial"]), "").alias("initials"),
        F.array_compact(F.transform(own, lambda i: i["turn"])).alias("turns"),
        F.transform(own, lambda i: i["said"]).alias("said"),
    )


def _matrices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        known: dict[str, list[int]] = {}
        for s in batch.column("signature").to_pylist():
            if s not in known:
                known[s] = matrix(s)
        values = pa.array([known[s] for s in batch.column("signature").to_pylist()], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), values], ["conv_id", "place", "value"])


def _least_sums(a: Column, b: Column) -> Column:
    """Product of two matrices: least cost over the state between."""

    def cell(x: Column) -> Column:
        row, column = F.floor(x / STATES).cast("int"), x % STATES
        return F.array_min(F.array(*[F.get(a, row * STATES + k) + F.get(b, column + k * STATES) for k in range(STATES)]))

    return F.transform(F.sequence(F.lit(0), F.lit(STATES * STATES - 1)), lambda x: F.least(cell(x), F.lit(FAR)))


def _passed(m: Column, behind: Column) -> Column:
    """Costs before a part from those behind it, less their least."""
    costs = F.transform(
        F.sequence(F.lit(0), F.lit(STATES - 1)),
        lambda s: F.array_min(F.array(*[F.get(m, s * STATES + k) + F.get(behind, F.lit(k)) for k in range(STATES)])),
    )
    return F.transform(costs, lambda c: F.least(c - F.array_min(costs), F.lit(FAR)))


def _follow(first: Column, then: Column) -> Column:
    """The state map ``then`` after ``first``."""
    return F.transform(first, lambda s: F.get(then, s.cast("int")))


def _scan(
    level: DataFrame,
    combine: Callable[[Column, Column], Column],
    move: Callable[[Column, Column], Column],
    start: Column,
    backwards: bool,
) -> DataFrame:
    """``conv_id, place, state``: what reaches each place from ``start`` through all places before it (or behind it).

    ``level(conv_id, place, value)`` holds values that ``combine`` joins in order and ``move`` applies to a state. Each round
    reduces ``FAN`` neighbours to one, until conversations have one value each; then states go down the same blocks.
    """
    blocks = []
    while True:
        items = F.sort_array(F.collect_list(F.struct("place", "value")))
        up = keep(
            level.groupBy("conv_id", F.floor(F.col("place") / FAN).alias("block")).agg(items.alias("items")), "blocks"
        )
        blocks.append(up)
        if up.filter("block > 0").limit(1).count() == 0:
            break
        rest = F.slice("items", 2, F.greatest(F.size("items") - 1, F.lit(0)))
        level = up.select(
            "conv_id",
            F.col("block").alias("place"),
            F.aggregate(rest, F.col("items")[0]["value"], lambda acc, x: combine(acc, x["value"])).alias("value"),
        )
    state = None
    for up in reversed(blocks):
        if state is None:
            known = up.withColumn("state", start)
        else:
            same = F.col("u.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("u.block") == F.col("s.place"))
            known = up.alias("u").join(state.alias("s"), same).select("u.*", "s.state")
        order = F.reverse("items") if backwards else F.col("items")
        empty = F.array().cast("array<struct<place:long,state:" + dict(known.dtypes)["state"] + ">>")
        walked = F.aggregate(
            order,
            F.struct(F.col("state").alias("now"), empty.alias("seen")),
            lambda acc, x: F.struct(
                move(x["value"], acc["now"]).alias("now"),
                F.concat(acc["seen"], F.array(F.struct(x["place"].alias("place"), acc["now"].alias("state")))).alias("seen"),
            ),
        )
        state = known.select("conv_id", F.explode(walked["seen"]).alias("one")).select("conv_id", "one.place", "one.state")
    return state


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Costs, audits and end states of parts sorted by (costs behind, reversed signature)."""
    rows = iter(())

    def pairs():
        for batch in batches:
            held.append(batch)
            yield from zip(batch.column("signature").to_pylist(), map(tuple, batch.column("behind").to_pylist()))

    held: list[pa.RecordBatch] = []
    rows = walk(pairs())
    for costs, edits in rows:
        batch = held[-1]
        found = [(costs, edits)]
        found += [tuple(next(rows)) for _ in range(batch.num_rows - 1)]
        behind = batch.column("behind").to_pylist()
        own = [[c - b[e[1]] for c, e in zip(cs, es)] for (cs, es), b in zip(found, behind)]
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("conv_id"),
                batch.column("part"),
                pa.array(own, pa.list_(pa.int64())),
                pa.array([[e[0] for e in es] for _, es in found], pa.list_(pa.string())),
                pa.array([[e[1] for e in es] for _, es in found], pa.list_(pa.int64())),
                pa.array([len(s) for s in batch.column("signature").to_pylist()], pa.int64()),
            ],
            ["conv_id", "part", "costs", "audits", "ends", "size"],
        )
        held.clear()


def _render(said: list[dict], audit: str, state: int) -> list[tuple[str, str, str]]:
    """(edit, role, text) of every edit; deleted turns as they were."""
    out, turns = [], iter(said)
    for letter in audit:
        turn = next(turns) if letter != "I" else {"role": None, "text": ""}
        role = turn["role"]
        if letter == "K":
            state = 1 if role[:1] == "s" else _NEXT[state]
        elif letter != "D":
            role, state = NAMES[_WANTED[state]], _NEXT[state]
        out.append((letter, role, turn["text"]))
    return out


EDITS = "array<struct<edit:string,role:string,text:string>>"


def _rendered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]))
    names = ["conv_id", "part", "signature", "initials", "turns", "cost", "audit"]

    def packed(batch: pa.RecordBatch, a: int, made: list) -> pa.RecordBatch:
        rows = batch.slice(a, len(made))
        return pa.RecordBatch.from_arrays(
            [rows.column(n) for n in names] + [pa.array(made, kind)], [*names, "edits"]
        )

    for batch in batches:
        a, made, size = 0, [], 0
        for k in range(batch.num_rows):
            (one,) = batch.slice(k, 1).to_pylist()
            edits = _render(one["said"], one["audit"], one["entry"])
            made.append([{"edit": e, "role": r, "text": t} for e, r, t in edits])
            size += sum(len(t) for _, _, t in edits)
            if size >= OUT_CHARS:
                yield packed(batch, a, made)
                a, made, size = k + 1, [], 0
        if made:
            yield packed(batch, a, made)


def repaired_parts(rows: DataFrame) -> DataFrame:
    """The cheapest repair of every conversation of ``rows(conv_id, turn, role, text)``, in parts of ``PART_TURNS`` turns.

    Columns: ``conv_id, part``, the turns' ``signature`` and ``initials`` (from part 1 on with the last initial before), their ``turns``
    numbers, and the repair's ``cost``, ``audit`` and ``edits(edit, role, text)``; edits D are turns that go.

    Turns stand in the order of ``turn`` (nulls first), then role and a hash of the text. Rows with a true ``lost`` (an optional
    column) are left out. Null roles and texts count as one space, so such turns are blank or of another
    role; rows without conversation id form one conversation. Other columns are not read. Repeated turns
    are duplicates. Conversations without rows have no parts.
    """
    parts = keep(_parts(_signed(_typed(rows))), "parts")
    slim = parts.select("conv_id", "part", "signature")
    end = F.array(*[F.lit(c) for c in END]).cast("array<long>")
    # A part that is not full is the last of its conversation.
    long = (F.col("part") > 0) | (F.length("signature") == PART_TURNS)
    values = slim.filter(long).mapInArrow(_matrices, "conv_id long, place long, value array<long>")
    behind = keep(_scan(values, _least_sums, _passed, end, True), "behind")
    same = F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.part") == F.col("b.place"))
    posed = slim.filter(~long).withColumn("behind", end).unionByName(
        slim.filter(long).alias("p").join(behind.alias("b"), same).select("p.*", F.col("b.state").alias("behind"))
    )
    backwards = posed.withColumn("_back", F.reverse("signature")).withColumn("_deal", F.xxhash64("conv_id", "part"))
    dealt = backwards.repartitionByRange("behind", "_back", "_deal").sortWithinPartitions("behind", "_back")
    solved = keep(
        dealt.select("conv_id", "part", "signature", "behind").mapInArrow(
            _solve, "conv_id long, part long, costs array<long>, audits array<string>, ends array<long>, size long"
        ),
        "solved",
    )
    together = parts.alias("p").join(
        solved.alias("v"), F.col("p.conv_id").eqNullSafe(F.col("v.conv_id")) & (F.col("p.part") == F.col("v.part"))
    ).select("p.*", "costs", "audits", "ends")
    full = solved.filter((F.col("part") > 0) | (F.col("size") == PART_TURNS))
    maps = full.select("conv_id", F.col("part").alias("place"), F.col("ends").alias("value"))
    entries = keep(_scan(maps, _follow, lambda m, s: F.get(m, s.cast("int")), F.lit(0).cast("long"), False), "entries")
    entered = together.filter(long).alias("p").join(
        entries.alias("b"), F.col("p.conv_id").eqNullSafe(F.col("b.conv_id")) & (F.col("p.part") == F.col("b.place"))
    ).select("p.*", F.col("b.state").alias("entry"))
    ready = together.filter(~long).withColumn("entry", F.lit(0).cast("long")).unionByName(entered).select(
        "conv_id",
        "part",
        "signature",
        "initials",
        "turns",
        "said",
        "entry",
        F.get("costs", F.col("entry").cast("int")).alias("cost"),
        F.get("audits", F.col("entry").cast("int")).alias("audit"),
    )
    return ready.mapInArrow(
        _rendered,
        "conv_id long, part long, signature string, initials string, turns array<long>, cost long, audit string, "
        f"edits {EDITS}",
    )


def repaired_turns(rows: DataFrame) -> DataFrame:
    """``conv_id, part, at, edit, role, text``: the turns of the repaired conversations, in order of part and ``at``."""
    parts = repaired_parts(rows).select("conv_id", "part", F.posexplode("edits").alias("at", "one"))
    return parts.filter("one.edit <> 'D'").select("conv_id", "part", "at", "one.*")


_LEGAL = {"su", "ua", "au"}
REPORT = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
    "repaired_sha256 string"
)


class _Report:
    """Running totals of one conversation, part after part."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.first, self.last, self.distinct = conv_id, None, None, 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.cost = 0
        self.audit: list[str] = []
        self.sha, self.begun = hashlib.sha256(), False

    def add(self, row: dict) -> None:
        for t in row["turns"]:
            if self.first is None:
                self.first = t
            self.distinct += t != self.last
            self.last = t
        signature, initials = row["signature"], row["initials"]
        self.blank += signature.count("b")
        self.duplicate += signature.count("d")
        self.truncated += sum(s in CUT for s in signature)
        self.illegal += sum(x + y not in _LEGAL for x, y in zip(initials, initials[1:]))
        self.cost += row["cost"]
        self.audit.append(row["audit"])
        for line in row["lines"]:
            if self.begun:
                self.sha.update(b"\n")
            self.begun = True
            self.sha.update(line.encode())

    def row(self) -> tuple:
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.distinct
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost,
                "".join(self.audit), self.sha.hexdigest())


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in REPORT.split(", ")]
    kinds = [pa.string() if c.endswith("string") else pa.int64() for c in REPORT.split(", ")]
    now: _Report | None = None

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    for batch in batches:
        done = []
        for k in range(batch.num_rows):
            (row,) = batch.slice(k, 1).to_pylist()
            if now is None or row["conv_id"] != now.conv_id:
                if now is not None:
                    done.append(now.row())
                now = _Report(row["conv_id"])
            if row["part"] >= 0:
                now.add(row)
        if done:
            yield packed(done)
    if now is not None:
        yield packed([now.row()])


def repair_reports(rows: DataFrame) -> DataFrame:
    """One row per conversation of ``rows``, dropped turns included: faults, cost, audit and digest of the repaired text.

    The parts of a conversation pass through one task in order, a row at a time, as a digest needs them; only the
    audit is held whole.
    """
    rows = _typed(rows)
    kept = F.filter("edits", lambda e: e["edit"] != "D")
    lines = F.transform(kept, lambda e: F.concat(e["role"], F.lit(":"), e["text"]))
    parts = repaired_parts(rows).select(
        "conv_id", "part", "signature", "initials", "turns", "cost", "audit", lines.alias("lines")
    )
    none = {"signature": "string", "initials": "string", "turns": "array<long>", "cost": "long", "audit": "string",
            "lines": "array<string>"}
    every = rows.select("conv_id").distinct().select(
        "conv_id", F.lit(-1).cast("long").alias("part"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]
    )
    dealt = parts.unionByName(every).repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(_reports, REPORT)
