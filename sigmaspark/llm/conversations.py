"""Repair of damaged conversations by a minimum over big integers.

A conversation's rows and the automaton of legal role orders make a DAG: nodes are (row,
state), edges are edits. The weight of a way through it is one integer. Its high digits are
the cost, its low digits are the letters of the edits, the first letter highest, each in a
fixed width, with zeros where a shorter way has ended. So the ordinary minimum of integers
is the cheapest way, and among those the one whose letters come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, portions, table

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
LETTERS = "DIKR"  # in ASCII order: digits 1 to 4
BITS = 3
BLANKS = " \t\n\v\f\r"
LEGAL = {"su", "ua", "au"}
#: Initial that a state waits for, and the state after it. A system row may only come first.
START, AFTER_SYSTEM, AFTER_PAIR, AFTER_USER = range(4)
TURNS = {START: ("u", AFTER_USER), AFTER_SYSTEM: ("u", AFTER_USER), AFTER_PAIR: ("u", AFTER_USER), AFTER_USER: ("a", AFTER_PAIR)}
NAMES = {"u": "user", "a": "assistant"}


def faults(rows: list[tuple[str, str]]) -> list[str | None]:
    """The first fault of each (role, text): blank, duplicate of an earlier row, truncated, or None."""
    seen: set[tuple[str, str]] = set()
    out: list[str | None] = []
    for row in rows:
        end = row[1].rstrip(BLANKS)[-1:]
        out.append("blank" if not end else "duplicate" if row in seen else None if end in ".!?" else "truncated")
        seen.add(row)
    return out


def cheapest_edits(initials: list[str], found: list[str | None]) -> tuple[int, str]:
    """Cost and letters of the cheapest edits; among equal costs the ASCII-least letters.

    A node's integer is the weight of its best completion, aligned to the left of the fixed
    width. A letter put in front moves the others down by one place, which keeps their order.
    At most two insertions fit between two rows: a third would close a circle of cost 6.
    """
    width = BITS * (3 * len(initials) + 3)
    top, low = width - BITS, (1 << width) - 1
    digit = {x: (k + 1) << top for k, x in enumerate(LETTERS)}

    def before(cost: int, letter: str, rest: int) -> int:
        return ((cost + (rest >> width)) << width) | digit[letter] | ((rest & low) >> BITS)

    def inserted(own: dict[int, int]) -> dict[int, int]:
        for _ in range(2):
            longer = {s: before(INSERT, "I", own[to]) for s, (_, to) in TURNS.items() if to in own}
            own = {s: min(x[s] for x in (own, longer) if s in x) for s in own.keys() | longer.keys()}
        return own

    best = inserted({START: 0, AFTER_PAIR: 0})
    for initial, fault in zip(reversed(initials), reversed(found), strict=True):
        here: dict[int, int] = {}
        more = TRUNCATED if fault == "truncated" else 0
        for s, (wanted, to) in TURNS.items():
            ways = [before(DELETE, "D", best[s])]
            if fault not in ("blank", "duplicate"):
                ways.append(before(REROLE + more, "R", best[to]))
                if initial == wanted:
                    ways.append(before(KEEP + more, "K", best[to]))
                if initial == "s" and s == START:
                    ways.append(before(KEEP + more, "K", best[AFTER_SYSTEM]))
            here[s] = min(ways)
        best = inserted(here)
    cost, digits, letters = best[START] >> width, best[START] & low, []
    while digits:
        letters.append(LETTERS[(digits >> top) - 1])
        digits = (digits << BITS) & low
    return cost, "".join(letters)


def repaired(rows: list[tuple[str, str]], letters: str) -> list[tuple[str, str]]:
    """The rows that the edits leave."""
    out, at, state = [], 0, START
    for letter in letters:
        role, text = rows[at] if letter != "I" else ("", "")
        at += letter != "I"
        if letter == "D":
            continue
        if letter == "K" and role[:1] == "s":
            state = AFTER_SYSTEM
        else:
            wanted, state = TURNS[state]
            role = role if letter == "K" else NAMES[wanted]
        out.append((role, text))
    return out


def _repair(turns: list[int | None], rows: list[tuple[str, str]]) -> dict:
    found = faults(rows)
    initials = [role[:1] for role, _ in rows]
    cost, audit = cheapest_edits(initials, found)
    known = {t for t in turns if t is not None}
    return {
        "gaps": max(known) - min(known) + 1 - len(known) if known else 0, **{f: found.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False)), "cost": cost, "audit": audit, "repaired": [{"role": r, "text": t} for r, t in repaired(rows, audit)],
    }


def repair_conversations(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """Per conversation: gaps, blank, duplicate, truncated, illegal, cost, audit and the repaired rows (role, text).

    Rows count by turn, then role and text where turns tie, nulls first; a null role or text
    is one space; rows of a null conversation are one conversation. ``present`` names a
    boolean column: where it is false, the row only names its conversation, which may so be
    empty (zeros, no letters, no rows). Other columns are ignored, whatever their names; an
    empty table gives none. Rows are exchanged once, by conversation, and read as a sorted
    stream: a task holds one conversation at a time, as the audit is one value.
    """
    kind = rows.schema[conv].dataType
    own = rows.select(F.col(conv).alias("conv"), F.col(turn).cast("long").alias("turn"), F.coalesce(role, F.lit(" ")).alias("role"), F.coalesce(text, F.lit(" ")).alias("text"), (F.coalesce(present, F.lit(False)) if present else F.lit(True)).alias("here"))
    dealt = own.repartition("conv").sortWithinPartitions("conv", "turn", "role", "text")

    def repair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[dict] = []
        size, last, turns, held = 0, None, [], []

        def flush(to: list[dict]) -> Iterator[pa.RecordBatch]:
            if to:
                columns = {c: [r[c] for r in to] for c in to[0]}
                yield pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in target], schema=target)

        began = False
        for whole in batches:
            target = _schema(whole.schema.field("conv").type)
            for batch in portions(whole):
                for c, t, r, x, here in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                    if began and c != last:
                        done.append({"conv": last} | _repair(turns, held))
                        size += sum(len(b) for _, b in held) + 200
                        turns, held = [], []
                        if size > 4_000_000:
                            yield from flush(done)
                            done, size = [], 0
                    began, last = True, c
                    if here:
                        turns.append(t)
                        held.append((r, x))
        if began:
            done.append({"conv": last} | _repair(turns, held))
            yield from flush(done)

    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired array<struct<role:string,text:string>>"
    return dealt.mapInArrow(repair, f"conv {kind.simpleString()}, {fields}").withColumnRenamed("conv", conv)


def _schema(kind: pa.DataType) -> pa.Schema:
    counts = [(c, pa.int64()) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return pa.schema([("conv", kind), *counts, ("audit", pa.string()), ("repaired", pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())])))])


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` as the contract damages them; ``present`` is false for dropped ones."""
    k, here = fresh(rows, "_k", "present")
    as_text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select("conv_id", "turn", *[F.coalesce(c, F.lit(" ")).alias(c) for c in ("role", "text")], (F.crc32(F.concat(as_text("conv_id"), F.lit(":"), as_text("turn"))) % 20).alias(k))
    text = F.when(F.col(k) == 1, "").when(F.col(k) == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col(k) == 3, 2).otherwise(1)))
    return own.select("conv_id", "turn", F.when(F.col(k) == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col(k) != 0).alias(here), copies.alias("copy")).drop("copy")


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = damaged(table(spark, sf_dir, "conversations"))
    out = repair_conversations(rows, present="present")
    lines = F.transform("repaired", lambda r: F.concat(r["role"], F.lit(":"), r["text"]))
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", F.sha2(F.array_join(lines, "\n"), 256).alias("repaired_sha256"))
