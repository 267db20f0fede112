"""Conversation repair against brute force: every edit sequence, long conversations, awkward rows."""

import functools
import hashlib
import random
import re
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from faretide.llm import conversation_repair as repair

sys.setrecursionlimit(20_000)
SCHEMA = "conv_id long, turn long, role string, text string"


def damage(rows: list[tuple]) -> list[tuple]:
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if fault == 0:
            continue
        text = {1: "", 2: re.sub("[.!?]", "", text)}.get(fault, text)
        out += [(conv, turn, "user" if fault == 4 else role, text)] * (2 if fault == 3 else 1)
    return out


def faults(rows: list[tuple]) -> list[str]:
    seen, found = set(), []
    for _, _, role, text in rows:
        last = re.findall(r"[^\x20\x09-\x0D]", text)[-1:]
        found.append("blank" if not last else "duplicate" if (role, text) in seen else
                     "truncated" if last[0] not in ".!?" else "")
        seen.add((role, text))
    return found


def cheapest(initials: str, marks: list[str]) -> tuple[int, str]:
    """Least cost and least audit over all edit sequences with at most three inserts at a place."""

    @functools.cache
    def best(k: int, done: str, inserts: int) -> tuple[int, str] | None:
        # ``done`` is what matters of the initials so far: empty, "s", or the last of a run of turns.
        options = []
        if k == len(initials) and done in ("", "a"):
            options.append((0, ""))
        grow = [("u", "u")] if done in ("", "s", "a") else [("a", "a")]
        moves = []
        if inserts < 3:
            moves += [("I", 3, k, n, inserts + 1) for _, n in grow]
        if k < len(initials):
            moves.append(("D", 4, k + 1, done, 0))
            if marks[k] not in ("blank", "duplicate"):
                cut = 3 * (marks[k] == "truncated")
                moves += [("R", 3 + cut, k + 1, n, 0) for _, n in grow]
                if initials[k] == "s" and done == "":
                    moves.append(("K", cut, k + 1, "s", 0))
                if initials[k] == grow[0][0]:
                    moves.append(("K", cut, k + 1, grow[0][1], 0))
        for letter, cost, at, state, count in moves:
            rest = best(at, state, count)
            if rest:
                options.append((cost + rest[0], letter + rest[1]))
        return min(options) if options else None

    return best(0, "", 0)


def reports(rows: list[tuple]) -> list[tuple]:
    out = []
    left = damage(rows)
    for conv in {r[0] for r in rows}:
        mine = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        marks = faults(mine)
        initials = "".join(r[2][0] if r[2][:1] in ("s", "u", "a") else "-" for r in mine)
        cost, audit = cheapest(initials, marks)
        lines, state, at = [], "", 0
        for letter in audit:
            role, text = (mine[at][2], mine[at][3]) if letter != "I" else ("", "")
            at += letter != "I"
            if letter == "D":
                continue
            if letter in "RI":
                role = "assistant" if state == "u" else "user"
            state = role[0]
            lines.append(f"{role}:{text}")
        turns = [r[1] for r in mine if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        out.append((conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"), illegal, cost,
                    audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations() -> list[tuple]:
    rng = random.Random(2)
    rows = []
    for conv in range(120):
        for turn in range(rng.choice([1, 2, 5, 9, 14])):
            role = rng.choice(["user", "assistant"] * 4 + ["system", "tool", "sage", "", None])
            text = rng.choice(["Yes.", "no", "Why?", f"Word {turn}!", " \n", None, "", "ok .\t", "漢字。"])
            if rng.random() < 0.9:
                rows.append((conv, turn + conv, role, text))
    # One conversation with far more turns than a part, one that fills parts exactly, and turns without number or id.
    for conv, n in ((1000, 700), (1001, 16), (1002, 8)):
        for turn in range(n):
            role = "system" if turn == 0 else rng.choice(["user", "assistant", "assistant", "tool"])
            rows.append((conv, turn, role, rng.choice(["a.", "b", f"{turn}?"])))
    rows += [(2000, None, "user", "x."), (2000, 3, "assistant", "y."), (None, 1, "user", "z."), (2001, None, None, None)]
    return rows


@pytest.mark.parametrize("part, fan", [(64, 32), (4, 2)])
def test_reports(spark, part, fan, monkeypatch):
    monkeypatch.setattr(repair, "PART_TURNS", part)
    monkeypatch.setattr(repair, "FAN", fan)
    rows = conversations()
    table = spark.createDataFrame(rows, SCHEMA).withColumn("lines", F.lit(1)).withColumn("sign", F.lit("x"))
    found = sorted(map(tuple, repair.repair_reports(repair.damaged(table.repartition(5))).collect()), key=repr)
    assert found == reports(rows)


@pytest.mark.parametrize("seed", range(30))
def test_automaton(seed):
    """Costs and audits of random signatures, whatever was walked before, and from part to part."""
    rng = random.Random(seed)
    made = ["".join(rng.choice("suaSUA-_bd") for _ in range(rng.randint(1, 9))) for _ in range(60)]
    end = tuple(repair.END)
    made.sort(key=lambda s: s[::-1])
    for signature, (costs, edits) in zip(made, repair.walk((s, end) for s in made)):
        marks = ["blank" if s in "bd" else "truncated" if s in repair.CUT else "" for s in signature]
        assert (costs[0], edits[0][0]) == cheapest(signature.lower(), marks)
        # The same from two parts: costs behind the first from the second's matrix.
        cut = rng.randint(0, len(signature))
        behind = [min(repair.matrix(signature[cut:])[4 * s + g] + end[g] for g in range(4)) for s in range(4)]
        ((first, made_first),) = repair.walk(iter([(signature[:cut], tuple(behind))]))
        ((_, made_then),) = repair.walk(iter([(signature[cut:], end)]))
        assert (first[0], made_first[0][0] + made_then[made_first[0][1]][0]) == (costs[0], edits[0][0])


def test_empty_and_general(spark):
    assert repair.repair_reports(spark.createDataFrame([], SCHEMA)).count() == 0
    assert repair.repaired_turns(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(1, 0, "assistant", "Hi."), (1, 1, "user", "Why?"), (1, 1, "user", "Why?"), (1, 2, "assistant", "So.")]
    turns = repair.repaired_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("part", "at").collect()
    assert [(r.edit, r.role, r.text) for r in turns] == [
        ("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "Why?"), ("K", "assistant", "So.")]
