"""Conversation structure repair by depth-first branch and bound.

Rows of a conversation are kept, reroled or deleted and empty turns inserted until the roles read system?, then
user and assistant in turn. A node is (rows consumed, last role); an explicit stack holds the open
prefixes (cost, audit). A prefix is dropped when its cost and the lower bound of the rows to come (what each costs in its
best place) cannot beat the incumbent (cost, audit), or when its node was reached at a smaller (cost, audit) before:
equal ends have equal futures, and of two prefixes of equal cost at one node none begins the other.
An empty stack proves the incumbent optimal.

Conversations of any length: rows are dealt by ranges of (conversation, turn), so a task holds a
stretch of them. Conversations inside a stretch are repaired there. Those that touch its ends are
repaired per segment from every role before it to every role after it (blocks of ``BLOCK`` rows, folded), the
segments' tables are folded per conversation, and each segment is then written by its part of the audit.
Only tables of (role before, role after, cost, audit) meet in one task, the rows of a conversation never do.

Nulls read as one space in role and text; null turns come first and count for no gap; a null conversation id is a
conversation. Rows of a turn are in the order of role and a hash of the text. An empty role has no initial and fits
nowhere. Very long texts are handled as they are; repeated rows are duplicates; extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.sources.tables import materialise

START, SYSTEM, USER, ASSISTANT = range(4)
STATES, ENDS = (START, SYSTEM, USER, ASSISTANT), (START, ASSISTANT)
#: Roles that may follow: initial to the state it leads to.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NAMES = {USER: "user", ASSISTANT: "assistant"}
NONE, BLANK, DUPLICATE, TRUNCATED = range(4)
REROLE, DELETE, INSERT, UNFINISHED = 2, 3, 2, 1
WHITE = " \t\n\x0b\x0c\r"
#: Rows searched at once; longer stretches are folded from such blocks.
BLOCK = 48


def fault(text: str, seen: bool) -> int:
    last = text.rstrip(WHITE)[-1:]
    return BLANK if not last else DUPLICATE if seen else TRUNCATED if last not in ".!?" else NONE


def made(state: int) -> int:
    """State after an inserted or reroled turn."""
    return ASSISTANT if state == USER else USER


def search(rows: list[tuple[str, int]], entry: int, goals: tuple[int, ...]) -> tuple[int, str, int] | None:
    """Least (cost, audit) and the state reached, from ``entry`` to one of ``goals`` over rows of (initial, fault)."""
    n = len(rows)
    bound = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        initial, f = rows[i]
        extra = UNFINISHED * (f == TRUNCATED)
        bound[i] = bound[i + 1] + (DELETE if f in (BLANK, DUPLICATE) else extra if initial in ("s", "u", "a") else min(DELETE, REROLE + extra))
    table: list[list] = [[None] * 4 for _ in range(n + 1)]
    table[0][entry] = (0, "")
    stack, best = [(0, entry, 0, "")], None
    while stack:
        i, state, cost, audit = stack.pop()
        if table[i][state] != (cost, audit):
            continue  # a better prefix came to this node since
        if best is not None and (cost + bound[i] > best[0] or cost + bound[i] == best[0] and audit > best[1][:len(audit)]):
            continue
        if i == n and state in goals and (best is None or (cost, audit) < best[:2]):
            best = (cost, audit, state)
        children = [(i, made(state), cost + INSERT, audit + "I")]
        if i < n:
            initial, f = rows[i]
            if f not in (BLANK, DUPLICATE):
                extra = UNFINISHED * (f == TRUNCATED)
                children.append((i + 1, made(state), cost + REROLE + extra, audit + "R"))
                if initial in FOLLOWS[state]:
                    children.append((i + 1, FOLLOWS[state][initial], cost + extra, audit + "K"))
            children.append((i + 1, state, cost + DELETE, audit + "D"))
        # the most promising child goes on top
        for child in sorted(children, key=lambda c: (c[2] + bound[c[0]], c[3]), reverse=True):
            known = table[child[0]][child[1]]
            if known is None or child[2:] < known:
                table[child[0]][child[1]] = child[2:]
                stack.append(child)
    return best


class Solver:
    """Searches by the signature of a block: initials and faults."""

    def __init__(self, bound: int = 200_000) -> None:
        self.known, self.bound = {}, bound

    def best(self, rows: list[tuple[str, int]], entry: int, goals: tuple[int, ...]) -> tuple[int, str, int] | None:
        key = (tuple(rows), entry, goals)
        if key not in self.known:
            if len(self.known) >= self.bound:
                self.known.clear()
            self.known[key] = search(rows, entry, goals)
        return self.known[key]

    def table(self, rows: list[tuple[str, int]], entries: tuple[int, ...] = STATES) -> dict[tuple[int, int], tuple[int, str]]:
        """(cost, audit) from each entry to each state that can be reached."""
        out = {(e, e): (0, "") for e in entries}
        for at in range(0, max(len(rows), 1), BLOCK):
            part = rows[at:at + BLOCK]
            step = {(a, b): got[:2] for a in STATES for b in STATES if (got := self.best(part, a, (b,))) is not None}
            out = fold(out, step)
        return out

    def whole(self, rows: list[tuple[str, int]]) -> tuple[int, str]:
        if len(rows) <= BLOCK:
            return self.best(rows, START, ENDS)[:2]
        return min(v for (_, end), v in self.table(rows, (START,)).items() if end in ENDS)


def fold(first: dict, second: dict) -> dict[tuple[int, int], tuple[int, str]]:
    out: dict = {}
    for (a, b), (cost, audit) in first.items():
        for c in STATES:
            if (b, c) in second:
                new = (cost + second[b, c][0], audit + second[b, c][1])
                if (a, c) not in out or new < out[a, c]:
                    out[a, c] = new
    return out


def written(rows: list[tuple], audit: str, entry: int = START) -> str:
    """``role:text`` lines of rows (role, text, fault) after the edits of the audit."""
    state, todo, out = entry, iter(rows), []
    for edit in audit:
        if edit == "I":
            state = made(state)
            out.append(f"{NAMES[state]}:")
            continue
        role, text, _ = next(todo)
        if edit == "K":
            state = FOLLOWS[state][role[:1]]
            out.append(f"{role}:{text}")
        elif edit == "R":
            state = made(state)
            out.append(f"{NAMES[state]}:{text}")
    return "\n".join(out)


def illegal(initials: list[str]) -> int:
    return sum((a, b) not in (("s", "u"), ("u", "a"), ("a", "u")) for a, b in zip(initials, initials[1:], strict=False))


def tally(rows: list[tuple]) -> list[int]:
    """Counts of blank, duplicate, truncated and illegal of rows (role, text, fault)."""
    return [*(sum(f == k for *_, f in rows) for k in (BLANK, DUPLICATE, TRUNCATED)), illegal([r[:1] for r, *_ in rows])]


COUNTS = "blank long, duplicate long, truncated long, illegal long"
RESULT = f"gaps long, {COUNTS}, cost long, audit string, repaired string"


def damaged(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``key``, ``turn``, ``role``, ``text`` and ``times`` (0 dropped, 2 repeated) by the CRC-32 of ``key:turn``."""
    spaced = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(key), F.lit(":"), spaced(turn)).cast("binary")) % 20
    return df.select(F.col(f"`{key}`").alias(key), F.col(f"`{turn}`").cast("long").alias(turn), F.when(kind == 4, "user").otherwise(spaced(role)).alias(role),
                     F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced(text), "[.!?]", "")).otherwise(spaced(text)).alias(text),
                     F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).alias("times"))


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Consecutive rows of one conversation: its id as an array of one, and its rows (times, turn, role, text)."""
    held, rows, value = None, [], None
    for batch in batches:
        columns = [batch.column(c).to_pylist() for c in ("_conv", "_times", "_turn", "_role", "_text")]
        for i, (conv, *row) in enumerate(zip(*columns, strict=True)):
            if held is None or conv != value:
                if held is not None:
                    yield held, rows
                held, rows, value = batch.column("_conv").slice(i, 1), [], conv
            rows.append(row)
    if held is not None:
        yield held, rows


def _solve(rows: list[list], solver: Solver) -> list:
    seen, out, turns = set(), [], set()
    for times, turn, role, text in rows:
        for _ in range(times):
            out.append((role, text, fault(text, (role, text) in seen)))
            seen.add((role, text))
            turns.add(turn)
    turns.discard(None)
    cost, audit = solver.whole([(r[:1], f) for r, _, f in out])
    return [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *tally(out), cost, audit, written(out, audit)]


def segments(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", times: str | None = None) -> DataFrame:
    """``key``, ``segment`` (order inside the conversation), ``only`` (the conversation has no other) and per segment gaps, blank,
    duplicate, truncated, illegal, cost, audit and ``repaired`` (``role:text`` lines). Sums over the segments of a conversation are its
    figures, audits and lines follow each other."""
    kind = df.schema[key].dataType.simpleString()
    read = lambda c: F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(" "))
    rows = df.select(F.col(f"`{key}`").alias("_conv"), (F.col(f"`{times}`") if times else F.lit(1)).cast("int").alias("_times"),
                     F.col(f"`{turn}`").cast("long").alias("_turn"), read(role).alias("_role"), read(text).alias("_text"))
    order = ["_conv", "_turn", "_role", F.sha2("_text", 256), "_id"]
    rows = rows.withColumn("_id", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)

    def first_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        solver, done, last = Solver(), 0, None

        def edge(number: int, conv: pa.Array, found: list) -> Iterator[pa.RecordBatch]:
            for at in range(0, len(found), 4096):
                part = found[at:at + 4096]
                empty = [pa.nulls(len(part), t) for t in [pa.int64()] * 6 + [pa.string()] * 2]
                yield pa.RecordBatch.from_arrays([conv.take(pa.array([0] * len(part))), *empty, pa.array([number] * len(part), pa.int32()), pa.array(range(at, at + len(part)), pa.int64()),
                                                  *(pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int32(), pa.int64(), pa.string(), pa.string()), strict=True))], names)

        def result(conv: pa.Array, found: list) -> pa.RecordBatch:
            values = _solve(found, solver)
            return pa.RecordBatch.from_arrays([conv, *(pa.array([v], t) for v, t in zip(values, [pa.int64()] * 6 + [pa.string()] * 2, strict=True)),
                                               *(pa.nulls(1, t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.string()))], names)

        held = []
        for conv, found in _stretches(batches):
            if done == 0:
                yield from edge(0, conv, found)
            else:
                if last is not None:
                    held.append(result(*last))
                    if len(held) >= 256:
                        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        held = []
                last = (conv, found)
            done += 1
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        if last is not None:
            yield from edge(1, *last)

    names = ["_conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired", "_edge", "_pos", "_times", "_turn", "_role", "_text"]
    first = rows.drop("_id").mapInArrow(first_pass, f"_conv {kind}, {RESULT}, _edge int, _pos long, _times int, _turn long, _role string, _text string")
    first = materialise(first.withColumn("_segment", F.spark_partition_id().cast("long") * 2 + F.coalesce("_edge", F.lit(0))), "conversations")
    result = [F.col(c) for c in names[1:9]]
    inside = first.where("_edge is null").select(F.col("_conv").alias(key), F.lit(0).cast("long").alias("segment"), F.lit(True).alias("only"), *result)
    return inside.unionByName(_edges(first.where("_edge is not null"), kind).select(F.col("_conv").alias(key), "segment", "only", *result))


def _edges(rows: DataFrame, kind: str) -> DataFrame:
    """Segments of the conversations that touch the end of a stretch."""
    rows = rows.select("_conv", "_segment", "_pos", "_times", "_turn", "_role", "_text").withColumn("_hash", F.sha2("_text", 256))
    here = F.struct("_segment", "_pos")
    firsts = (rows.where("_times > 0").groupBy("_conv", "_role", "_hash").agg(F.min(here).alias("_first"))
              .select(F.col("_conv").alias("_c"), F.col("_role").alias("_r"), F.col("_hash").alias("_h"), "_first"))
    same = rows["_conv"].eqNullSafe(firsts["_c"]) & (rows["_role"] == firsts["_r"]) & (rows["_hash"] == firsts["_h"])
    rows = materialise(rows.join(firsts, same, "left").select("_conv", "_segment", "_pos", "_times", "_turn", "_role", "_text", (here != F.col("_first")).alias("_seen")), "segments")

    def read(table: pa.Table) -> tuple[list, list]:
        table = table.sort_by("_pos")
        out, turns = [], []
        for times, turn, role, text, seen in zip(*(table.column(c).to_pylist() for c in ("_times", "_turn", "_role", "_text", "_seen")), strict=True):
            for k in range(times):
                out.append((role, text, fault(text, seen or k > 0)))
                turns.append(turn)
        return out, turns

    def summary(table: pa.Table) -> pa.Table:
        found, turns = read(table)
        known = [t for t in turns if t is not None]
        steps = [{"a": a, "b": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in Solver().table([(r[:1], f) for r, _, f in found]).items()]
        values = [table.column("_segment")[0].as_py(), *tally(found), *(([known[0], known[-1], len(set(known))]) if known else [None, None, 0]),
                  found[0][0][:1] if found else None, found[-1][0][:1] if found else None]
        types = [pa.int64()] * 8 + [pa.string()] * 2
        return pa.Table.from_arrays([table.column("_conv").combine_chunks().slice(0, 1), *(pa.array([v], t) for v, t in zip(values, types, strict=True)),
                                     pa.array([steps], pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])))], fields)

    fields = ["_conv", "_segment", "blank", "duplicate", "truncated", "illegal", "least", "most", "turns", "head", "tail", "steps"]
    found = rows.groupBy("_segment").applyInArrow(summary, f"_conv {kind}, _segment long, {COUNTS}, least long, most long, turns long, head string, tail string, "
                                                  "steps array<struct<a:int,b:int,cost:long,audit:string>>")
    found = materialise(found, "tables")

    def choose(table: pa.Table) -> pa.Table:
        """A conversation's segments, one row each: the cheapest way through their tables."""
        table = table.sort_by("_segment")
        parts = table.drop_columns(["_conv"]).to_pylist()
        ways = {START: (0, "", [])}
        for p in parts:
            new: dict = {}
            for x in p["steps"]:
                if x["a"] in ways:
                    cost, audit, path = ways[x["a"]]
                    way = (cost + x["cost"], audit + x["audit"])
                    if x["b"] not in new or way < new[x["b"]][:2]:
                        new[x["b"]] = (*way, [*path, (x["a"], x["cost"], x["audit"])])
            ways = new
        _, _, path = min((w for end, w in ways.items() if end in ENDS), key=lambda w: w[:2])
        timed = [p for p in parts if p["turns"]]
        gaps = 0
        if timed:
            met = sum(a["most"] == b["least"] for a, b in zip(timed, timed[1:], strict=False))
            gaps = timed[-1]["most"] - timed[0]["least"] + 1 - (sum(p["turns"] for p in timed) - met)
        tail, rows_out = None, []
        for k, (p, (entry, cost, audit)) in enumerate(zip(parts, path, strict=True)):
            joint = illegal([tail, p["head"]]) if tail is not None and p["head"] is not None else 0
            tail = p["tail"] if p["tail"] is not None else tail
            rows_out.append([p["_segment"], k, len(parts) == 1, gaps if k == 0 else 0, p["blank"], p["duplicate"], p["truncated"], p["illegal"] + joint, cost, audit, entry])
        types = [pa.int64(), pa.int64(), pa.bool_(), *[pa.int64()] * 6, pa.string(), pa.int32()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_out, strict=True), types, strict=True)],
                                    ["_segment", "segment", "only", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "entry"])

    chosen = found.groupBy("_conv").applyInArrow(choose, f"_segment long, segment long, only boolean, gaps long, {COUNTS}, cost long, audit string, entry int")
    chosen = materialise(chosen, "chosen")

    def render(left: pa.Table, right: pa.Table) -> pa.Table:
        found, _ = read(left)
        text = written(found, right.column("audit")[0].as_py(), right.column("entry")[0].as_py())
        return right.drop_columns(["_segment", "entry"]).append_column("repaired", pa.array([text])).add_column(0, "_conv", left.column("_conv").combine_chunks().slice(0, 1))

    return rows.groupBy("_segment").cogroup(chosen.groupBy("_segment")).applyInArrow(
        render, f"_conv {kind}, segment long, only boolean, {RESULT}")


def digests(found: DataFrame, key: str = "conv_id") -> DataFrame:
    """One row per conversation of ``segments``, with the digest of its repaired lines. Conversations of several segments are hashed by
    one task each, line after line: their segments stream through it."""
    kind = found.schema[key].dataType.simpleString()
    found = materialise(found, "repaired")
    sums = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    single = found.where("only").select(key, *sums, "audit", F.sha2("repaired", 256).alias("repaired_sha256"))
    several = found.where("NOT only").withColumnRenamed(key, "_conv").select("_conv", "segment", *sums, "audit", "repaired")
    several = several.repartition("_conv").sortWithinPartitions("_conv", "segment")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None

        def out() -> pa.RecordBatch:
            conv, totals, audit, digest, _ = held
            return pa.RecordBatch.from_arrays([conv, *(pa.array([v], pa.int64()) for v in totals), pa.array(["".join(audit)]), pa.array([digest.hexdigest()])],
                                              ["_conv", *sums, "audit", "repaired_sha256"])

        for batch in batches:
            for i, row in enumerate(batch.drop_columns(["_conv"]).to_pylist()):
                if row["segment"] == 0:
                    if held is not None:
                        yield out()
                    held = [batch.column("_conv").slice(i, 1), [0] * len(sums), [], hashlib.sha256(), False]
                held[1] = [a + row[c] for a, c in zip(held[1], sums, strict=True)]
                held[2].append(row["audit"])
                if row["repaired"]:
                    held[3].update((b"\n" if held[4] else b"") + row["repaired"].encode("utf-8", "surrogatepass"))
                    held[4] = True
        if held is not None:
            yield out()

    several = several.mapInArrow(run, f"_conv {kind}, " + ", ".join(f"{c} long" for c in sums) + ", audit string, repaired_sha256 string")
    return single.unionByName(several.withColumnRenamed("_conv", key))
