"""Conversation repair against all edits of small conversations."""

import hashlib
import itertools
import random
import re
import zlib

from sigmaspark.llm import conversations
from sigmaspark.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string, present int, conv string"


def all_edits(rows, most_inserts=4):
    """The cheapest (cost, letters, repaired rows), by trying every sequence of edits."""
    seen, faults = set(), []
    for row in rows:
        t = row[1].strip(" \t\n\v\f\r")
        faults.append("blank" if not t else "duplicate" if row in seen else "truncated" if t[-1] not in ".!?" else None)
        seen.add(row)
    best = None
    for letters in itertools.product("DKua", repeat=len(rows)):
        for spots in itertools.product(*[["", "u", "a", "ua", "au", "uaua"[:3]]] * (len(rows) + 1)):
            if sum(map(len, spots)) > most_inserts:
                continue
            cost, audit, out, ok = 0, "", [], True
            for k in range(len(rows) + 1):
                for x in spots[k]:
                    cost, audit = cost + 3, audit + "I"
                    out.append(("user" if x == "u" else "assistant", ""))
                if k == len(rows):
                    break
                x = letters[k]
                if x == "D":
                    cost, audit = cost + 4, audit + "D"
                    continue
                ok = ok and faults[k] not in ("blank", "duplicate")
                cost += 3 * (faults[k] == "truncated") + 3 * (x in "ua")
                audit += "K" if x == "K" else "R"
                out.append((rows[k][0] if x == "K" else "user" if x == "u" else "assistant", rows[k][1]))
            if ok and re.fullmatch("(s?(ua)+)?", "".join(r[:1] or "-" for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def test_against_all_edits():
    r = random.Random(3)
    for _ in range(60):
        rows = [(r.choice(["user", "assistant", "system", " ", "tool"]), r.choice(["Yes.", "No", " ", "", "Why?\n"])) for _ in range(r.randint(0, 3))]
        got = conversations._repair([1] * len(rows), rows)
        cost, audit, out = all_edits(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows
        assert [(x["role"], x["text"]) for x in got["repaired"]] == out, rows


def test_long_conversation():
    rows = [("user" if k % 3 else "assistant", f"turn {k}.") for k in range(900)]
    got = conversations._repair(list(range(900)), rows)
    assert len(got["audit"]) >= 900 and got["cost"] > 0
    assert re.fullmatch("(s?(ua)+)?", "".join(x["role"][:1] for x in got["repaired"]))


def test_repair_of_tables(spark):
    rows = [(1, 0, "user", "Hi."), (1, 2, "assistant", "Yes."), (1, 2, "assistant", "Yes."), (2, None, None, None), (2, 5, "user", "x" * 50_000), (None, 1, "system", "S."), (3, 1, "user", "gone")]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows], SCHEMA).selectExpr("conv_id", "turn", "role", "text", "conv_id <=> 3 as present", "conv")
    got = {r.conv_id: r for r in conversations.repair_conversations(df.selectExpr("*", "not present as here"), present="here").collect()}
    assert set(got) == {1, 2, 3, None}
    assert got[1].gaps == 1 and got[1].duplicate == 1 and got[1].audit == "KKD" and got[1].cost == 4
    assert got[2].blank == 1 and got[2].truncated == 1 and got[2].gaps == 0
    assert got[3].audit == "" and got[3].repaired == [] and got[3].cost == 0
    assert got[None].illegal == 0 and got[None].audit == "KII" or got[None].audit == "D"
    assert conversations.repair_conversations(df.limit(0)).count() == 0


def test_query_by_its_contract(spark):
    folder = "/root/testdata/sf0.001"
    source = spark.read.parquet(f"{folder}/conversations.parquet").collect()
    by = {}
    for r in source:
        by.setdefault(r.conv_id, [])
        k = zlib.crc32(f"{r.conv_id}:{r.turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", r.text) if k == 2 else r.text
        by[r.conv_id] += [(r.turn, "user" if k == 4 else r.role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    got = {r.conv_id: r for r in QUERIES["op12_conversations"](spark, folder).collect()}
    assert set(got) == set(by)
    for conv, rows in by.items():
        rows.sort()
        g = got[conv]
        want = conversations._repair([t for t, _, _ in rows], [(a, b) for _, a, b in rows])
        assert g.audit == want["audit"] and g.cost == want["cost"]
        assert g.repaired_sha256 == hashlib.sha256("\n".join(f"{x['role']}:{x['text']}" for x in want["repaired"]).encode()).hexdigest()
        if len(rows) <= 3:
            assert (g.cost, g.audit) == all_edits([(a, b) for _, a, b in rows])[:2]
