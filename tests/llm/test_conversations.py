"""Conversation repair against a plain dynamic programme, and its distributed form against one task."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from bedside.llm import common, conversations
from bedside.llm.conversations import ASSISTANT, START, STATES, ENDS, search

SCHEMA = "conv_id long, turn long, role string, text string, _conv string, _segment int, times string"


def brute(rows, entry, goals):
    """Least (cost, audit) over all edits, shortest rows first."""
    ways = {entry: (0, "")}

    def settle(ways):
        for _ in range(4):
            for s, (c, a) in list(ways.items()):
                t = 3 if s == 2 else 2
                ways[t] = min(ways.get(t, (10**9, "")), (c + 2, a + "I"))
        return ways

    for initial, f in rows:
        new = {}
        for s, (c, a) in settle(dict(ways)).items():
            t, extra = (3 if s == 2 else 2), f == 3
            options = [(s, c + 3, a + "D")]
            if f in (0, 3):
                options.append((t, c + 2 + extra, a + "R"))
                k = {"s": 1 if s == 0 else None, "u": 2 if s != 2 else None, "a": 3 if s == 2 else None}.get(initial)
                options += [(k, c + extra, a + "K")] if k else []
            for state, *way in options:
                new[state] = min(new.get(state, (10**9, "")), tuple(way))
        ways = new
    return min((w for s, w in settle(ways).items() if s in goals), default=None)


@pytest.mark.parametrize("seed", range(4))
def test_search_is_optimal(seed):
    rng = random.Random(seed)
    kinds = [(c, f) for c in ("s", "u", "a", "t", "", " ") for f in range(4)]
    for _ in range(400):
        rows = [rng.choice(kinds if rng.random() < 0.5 else [("u", 0), ("a", 0)]) for _ in range(rng.randint(0, 9))]
        for entry in STATES:
            for goals in (ENDS, *((s,) for s in STATES)):
                got = search(rows, entry, goals)
                assert (got[:2] if got else None) == brute(rows, entry, goals), (rows, entry, goals)


def test_every_short_conversation():
    for n in range(5):
        for rows in itertools.product([("s", 0), ("u", 0), ("a", 0), ("u", 1), ("a", 3)], repeat=n):
            cost, audit, state = search(list(rows), START, ENDS)
            assert (cost, audit) == brute(rows, START, ENDS)
            initials, at = "", 0
            for e in audit:
                if e in "IR":
                    initials += "a" if initials[-1:] == "u" else "u"
                elif e == "K":
                    initials += rows[at][0]
                at += e != "I"
            assert re.fullmatch("(s?(ua)+)?", initials) and (state == ASSISTANT or not initials)


def test_long_conversation_folds():
    rng = random.Random(1)
    rows = [(rng.choice("suuaat"), rng.choice([0, 0, 0, 1, 2, 3])) for _ in range(700)]
    assert conversations.Solver().whole(rows) == brute(rows, START, ENDS)


def expected(rows):
    """conv_id to figures, from rows (conv_id, turn, role, text) that are damaged here."""
    spaced = lambda x: " " if x is None else str(x)
    out = {c: [] for c, *_ in rows}
    for conv, turn, role, text in rows:
        kind = zlib.crc32(f"{spaced(conv)}:{spaced(turn)}".encode()) % 20
        role, text = "user" if kind == 4 else spaced(role), spaced(text)
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out[conv] += [(turn, role, text)] * {0: 0, 3: 2}.get(kind, 1)
    want = {}
    for conv, found in out.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        rows_, seen = [], set()
        for _, role, text in found:
            body = re.findall(r"[^\x20\x09-\x0D]", text)
            rows_.append((role, text, 1 if not body else 2 if (role, text) in seen else 3 if body[-1] not in ".!?" else 0))
            seen.add((role, text))
        turns = {t for t, *_ in found if t is not None}
        cost, audit = brute([(r[:1], f) for r, _, f in rows_], START, ENDS)
        lines, state, left = [], 0, iter(rows_)
        for e in audit:
            role, text, _ = next(left) if e != "I" else ("", "", 0)
            if e == "D":
                continue
            if e != "K":
                role = "assistant" if state == 2 else "user"
            state = {"s": 1, "u": 2, "a": 3}[role[0]]
            lines.append(f"{role}:{text}")
        initials = [r[:1] for r, *_ in rows_]
        want[conv] = (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(sum(f == k for *_, f in rows_) for k in (1, 2, 3)),
                      sum(a + b not in ("su", "ua", "au") or not a or not b for a, b in zip(initials, initials[1:])), cost, audit,
                      hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return want


def table(seed):
    rng = random.Random(seed)
    texts = ["Yes.", "No!", "Why?", "half a", "", " ", "\t\n", "done. ", "Yes.", "ends with\x85", "é.", None, "x" * 20_000 + "."]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", None, "", "User"]
    rows = [(c, t, rng.choice(roles[:5] if rng.random() < 0.8 else roles), rng.choice(texts)) for c in range(120) for t in range(rng.randint(1, 9)) if rng.random() < 0.9]
    rows += [(None, None, "user", "no id, no turn."), (None, 3, "assistant", "no id."), (500, None, "user", "a."), (500, None, None, None), (501, 7, "user", "same."), (501, 7, "user", "same.")]
    rows += [(900, t // 2, "assistant" if t % 2 else "user", f"turn {t % 700}.") for t in range(1500)]  # one long conversation
    rows += [(901, 1, "user", "again.")] * 300
    return rows


@pytest.mark.parametrize("partitions", ["1", "7", "40"])
def test_tables_dealt_over_partitions(spark, partitions):
    common.prepare(spark)
    rows, was = table(int(partitions)), spark.conf.get("spark.sql.shuffle.partitions")
    df = spark.createDataFrame([(*r, "c", 1, "t") for r in rows], SCHEMA).repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = conversations.digests(conversations.segments(conversations.damaged(df), times="times")).collect()
        assert conversations.digests(conversations.segments(conversations.damaged(df.limit(0)), times="times")).count() == 0
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = expected(rows)
    assert len(got) == len(want)
    assert {r[0]: tuple(r[1:]) for r in got} == want
