"""Conversation repair against a plain search over all states, row by row."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from gaugeframe.llm import conv_repair, queries

SCHEMA = "conv_id long, turn long, role string, text string"


def least_repair(rows):
    """(cost, audit, repaired rows) of the cheapest edits with the least audit: all labels, step by step."""
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    names = {"u": "user", "a": "assistant"}

    def inserted(labels):
        for _ in range(4):
            for place, (cost, audit, out) in list(labels.items()):
                for i, to in step[place].items():
                    if i in names:
                        new = (cost + 2, audit + "I", out + ((names[i], ""),))
                        labels[to] = min(labels.get(to, new), new)
        return labels

    labels = inserted({0: (0, "", ())})
    for role, text, fault in rows:
        new = {}
        for place, (cost, audit, out) in labels.items():
            moves = [(place, (cost + 3, audit + "D", out))]
            if fault not in ("blank", "duplicate"):
                late = int(fault == "truncated")
                for i, to in step[place].items():
                    if role[:1] == i:
                        moves.append((to, (cost + late, audit + "K", out + ((role, text),))))
                    if i in names:
                        moves.append((to, (cost + 2 + late, audit + "R", out + ((names[i], text),))))
            for to, label in moves:
                new[to] = min(new.get(to, label), label)
        labels = inserted(new)
    return min(labels[p] for p in (0, 3) if p in labels)


def plain_version(turns):
    """Rows of the query by conversation."""
    told = lambda v: " " if v is None else str(v)
    kept = {}
    for conv, turn, role, text in turns:
        rows = kept.setdefault(conv, [])
        kind = zlib.crc32(f"{told(conv)}:{told(turn)}".encode()) % 20
        role, text = told(role), told(text)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        rows += [(turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = {}
    for conv, rows in kept.items():
        tie = lambda r: hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).hexdigest()
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, tie(r)))
        seen, faults = set(), []
        for _, role, text in rows:
            last = re.findall(r"[^\x20\x09-\x0D]", text)
            faults.append("blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last[-1] not in ".!?" else "")
            seen.add((role, text))
        known = [t for t, _, _ in rows if t is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        initials = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials))
        cost, audit, made = least_repair([(r[1], r[2], f) for r, f in zip(rows, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest()
        out[conv] = (gaps, *(faults.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha)
    return out


def told(df):
    rows = [(r.conv_id, (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256)) for r in df.collect()]
    assert len(rows) == len(dict(rows))
    return dict(rows)


def some_turns(seed, n, most):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "admin"]
    texts = ["Fine.", "So!", "What?", "cut off", " \t\n", "", None, "long " * 50 + "end.", "é。", "ends. \n"]
    out = []
    for conv in range(n):
        for k in range(rng.randrange(1, most)):
            out.append((conv if conv else None, rng.choice([k, k, k, k + 1, None]), roles[k % 2] if rng.random() < 0.7 else rng.choice(roles), f"{rng.choice(texts)}" if rng.random() < 0.3 else rng.choice(texts)))
    return out


@pytest.mark.parametrize("chunk", [1, 3, 512])
def test_matches_plain_version(spark, chunk):
    turns = some_turns(chunk, 60, 14)
    turns += turns[::7]  # repeated rows
    df = spark.createDataFrame(turns, SCHEMA).selectExpr("*", "1 as cost", "'x' as audit", "2 as copies")
    assert told(conv_repair.repair(conv_repair.damage(df), chunk)) == plain_version(turns)


def test_one_conversation_over_many_tasks(spark):
    turns = [(9, k, ("user", "assistant")[k % 2], f"row {k % 1700}{'.' if k % 11 else ''}") for k in range(4000)] + [(9, 2000, "user", "the same.")] * 500
    assert told(conv_repair.repair(conv_repair.damage(spark.createDataFrame(turns, SCHEMA).repartition(4)), 64)) == plain_version(turns)


def test_search_gives_the_least_audit():
    rng = random.Random(5)
    for _ in range(400):
        rows = [conv_repair.Row(rng.choice("suaux"), rng.choice([0, 0, 0, 1, 2, 3]), 1) for _ in range(rng.randrange(9))]
        names = {0: "", 1: "blank", 2: "duplicate", 3: "truncated"}
        assert conv_repair.cheapest(rows, 0, (0, 3)) == least_repair([(r.initial, "t", names[r.fault]) for r in rows])[:2]


def test_query_over_all_conversations(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert told(queries.op13_conversation_repair(spark, "/root/testdata/sf0.01")) == plain_version([tuple(r) for r in table.collect()])


def test_empty_table_and_lost_rows(spark):
    assert told(conv_repair.repair(conv_repair.damage(spark.createDataFrame([], SCHEMA)))) == {}
    turn = next(t for t in range(1000) if zlib.crc32(f"4:{t}".encode()) % 20 == 0)
    nothing = hashlib.sha256(b"").hexdigest()
    assert told(conv_repair.repair(conv_repair.damage(spark.createDataFrame([(4, turn, "user", "gone.")], SCHEMA)))) == {4: (0, 0, 0, 0, 0, 0, "", nothing)}
