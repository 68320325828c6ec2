"""Line dedup by pairwise alignment with patience diff.

Lines are compared by a hash of the line without the white space (space, tab, CR, FF, VT) around it. Documents meet by runs:
from each line on, and back from each line, the shortest run of lines that reaches ``min_bytes``. Every
block to delete is a union of such runs, and the earlier document has them all. A run first asks the
first document (least id) that has it. Runs not deleted then, since their lines come in another order
there or repeat, ask the other earlier documents that have them, until they are deleted or all were
asked: what is deleted is what alignment with every earlier document deletes. Documents of the same
lines stand for each other, the first is asked. Common lines are deleted with their first document,
so pairs are about as many as runs; only runs that no alignment deletes meet all documents that have them.
Sizes of blocks count white space, those of runs offered do not; shorter runs are offered where
white space makes a run long enough.
Each pair is aligned once: lines unique to both sides, in their longest common order, are the
anchors, the stretches between are aligned the same way, and where nothing is unique the k-th
occurrences of a line are paired. Aligned lines that follow each other on both sides are a block;
blocks of ``min_bytes`` or more are deleted from the later document.

Blank lines neither nominate nor fill a block, but go with the lines on both sides of them.
Documents are in the order of id and then of a hash of the text; null ids come last. Rows of equal
id and text are one document: none is later than another. Null texts have no lines and stay null.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.llm import common
from bedside.sources.tables import materialise

MIN_BYTES = 40
BLANK = 0
WHITE = " \t\r\f\v"


def rising(values: list[int]) -> list[int]:
    """Places of a longest rising subsequence."""
    tops, at, back = [], [], [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back[i] = at[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            at.append(i)
        else:
            tops[k], at[k] = v, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def numbered(lines: list) -> dict:
    """Place of every (line, occurrence)."""
    seen: Counter = Counter()
    out = {}
    for i, x in enumerate(lines):
        seen[x] += 1
        out[x, seen[x]] = i
    return out


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Pairs of places of equal lines, rising on both sides. Null lines never pair by themselves."""
    pairs: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, m, j, n = todo.pop()
        while i < m and j < n and a[i] == b[j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        while i < m and j < n and a[m - 1] == b[n - 1]:
            m, n = m - 1, n - 1
            pairs.append((m, n))
        if i >= m or j >= n:
            continue
        ca, cb = Counter(a[i:m]), Counter(b[j:n])
        place = {x: k for k, x in enumerate(b[j:n], j) if cb[x] == 1 and x is not None}
        met = [(k, place[x]) for k, x in enumerate(a[i:m], i) if ca[x] == 1 and x in place]
        if not met:
            place = numbered(b[j:n])
            met = [(k + i, place[x] + j) for x, k in numbered(a[i:m]).items() if x[0] is not None and x in place]
        anchors = [met[k] for k in rising([q for _, q in met])]
        # between anchors, and behind the last
        for (p, q), (r, s) in zip([(i - 1, j - 1), *anchors], [*anchors, (m, n)], strict=True):
            if p + 1 < r and q + 1 < s and anchors:
                todo.append((p + 1, r, q + 1, s))
        pairs += anchors
    return sorted(set(pairs))


def blocks(a: list, sizes: list[int], b: list, min_bytes: int) -> list[tuple[int, int]]:
    """Line ranges of ``a`` that lie in common blocks of ``min_bytes`` or more."""
    out, run = [], []
    for p in [*align(a, b), (-2, -2)]:
        if run and p != (run[-1][0] + 1, run[-1][1] + 1):
            first, last = run[0][0], run[-1][0] + 1
            while first < last and a[first] is None:
                first += 1
            while first < last and a[last - 1] is None:
                last -= 1
            if sum(sizes[k] for k in range(first, last) if a[k] is not None) >= min_bytes:
                out.append((first, last))
            run = []
        run.append(p)
    return out


def windows(blank: np.ndarray, sizes: np.ndarray, inner: np.ndarray, first: np.ndarray, min_bytes: int) -> tuple[np.ndarray, ...]:
    """Starts, ends and the flags ask and offer of the shortest runs that reach ``min_bytes`` from each line on, and back
    from each line. Every block of ``min_bytes`` is a union of such runs. Runs by ``sizes`` ask, runs by ``inner`` offer.
    The lines are those of many documents, of which ``first`` has the first line of each line's document: no run leaves it."""
    filled = np.flatnonzero(~blank)
    n, wide = len(filled), len(blank) + 1
    least, place = np.searchsorted(filled, first[filled]), np.arange(len(filled))
    most = np.searchsorted(least, least, side="right")
    codes = []
    for values in (sizes, inner):
        total = np.concatenate([[0], np.cumsum(values[filled], dtype=np.int64)])
        ends = np.searchsorted(total, total[:n] + min_bytes)
        starts = np.searchsorted(total, total[1:] - min_bytes, side="right") - 1
        on, back = ends <= most, starts >= least
        i, m = np.concatenate([place[on], starts[back]]), np.concatenate([ends[on], place[back] + 1])
        codes.append(np.unique(filled[i] * wide + filled[m - 1] + 1))
    runs = np.union1d(*codes)
    return runs // wide, runs % wide, np.isin(runs, codes[0], assume_unique=True), np.isin(runs, codes[1], assume_unique=True)


def short_runs(lines: list, inner: list[int], min_bytes: int) -> tuple[np.ndarray, ...]:
    """Starts and ends of all runs below ``min_bytes`` by ``inner``."""
    filled = [i for i, x in enumerate(lines) if x is not None]
    out = []
    for k, i in enumerate(filled):
        size = 0
        for j in filled[k:]:
            size += inner[j]
            if size >= min_bytes:
                break
            out.append((i, j + 1))
    return tuple(np.array(out, dtype=np.int64).reshape(-1, 2).T)


def runs_of(lined: DataFrame, min_bytes: int, short: bool = False) -> DataFrame:
    """d, hash, start, end, ask and offer of the ``windows`` of each document, or of its ``short_runs``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = common.Rolling(0x9E3779B97F4A7C15)
        for batch in batches:
            many = np.array([len(x) for x in batch.column("lines")], dtype=np.int64)
            lines, sizes, inner = (batch.column(c).flatten() for c in ("lines", "sizes", "inner"))
            doc = np.repeat(np.arange(len(many)), many)
            first = np.repeat(np.cumsum(many) - many, many)
            if short:
                parts = [short_runs(x, i, min_bytes) for x, i in zip(*(batch.column(c).to_pylist() for c in ("lines", "inner")), strict=True)]
                start, end = (np.concatenate([p[k] + f for p, f in zip(parts, np.cumsum(many) - many, strict=True)]) for k in (0, 1))
                ask, offer = np.zeros(len(start), bool), np.ones(len(start), bool)
            else:
                start, end, ask, offer = windows(lines.is_null().to_numpy(zero_copy_only=False), sizes.to_numpy(), inner.to_numpy(), first, min_bytes)
            if len(start):
                h = rolling.spans(lines.fill_null(BLANK).to_numpy().view(np.uint64), start, end).view(np.int64)
                begin = first[start]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("d").take(pa.array(doc[start])), pa.array(h), pa.array((start - begin).astype(np.int32)),
                     pa.array((end - begin).astype(np.int32)), pa.array(ask), pa.array(offer)], ["d", "h", "start", "end", "ask", "offer"])

    return lined.select("d", "lines", "sizes", "inner").mapInArrow(
        run, common.with_fields(lined.select("d"), "h long, start int, end int, ask boolean, offer boolean"))


def aligned(pairs: DataFrame, lined: DataFrame, min_bytes: int) -> DataFrame:
    """d, start and end of the common blocks of each pair of documents (d, owner)."""
    both = (pairs.join(lined.select("d", "lines", "sizes"), "d")
            .join(lined.select(F.col("d").alias("owner"), F.col("lines").alias("others")), "owner")
            .select("d", "lines", "sizes", "others"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            found = [[{"start": s, "end": e} for s, e in blocks(a, sizes, b, min_bytes)] for a, sizes, b in
                     zip(*(batch.column(c).to_pylist() for c in ("lines", "sizes", "others")), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("d"), pa.array(found, kind)], ["d", "marks"])

    marks = both.mapInArrow(run, common.with_fields(both.select("d"), "marks array<struct<start:int,end:int>>"))
    return materialise(marks.select("d", F.explode("marks").alias("m")).distinct(), "marks")


def collected(marks: DataFrame) -> DataFrame:
    # a document's marks are bounded by its lines
    return marks.groupBy("d").agg(F.collect_set("m").alias("marks"))


def open_runs(asks: DataFrame, marks: DataFrame) -> DataFrame:
    """Asking runs that have a line outside all marks of their document."""
    marked = F.forall(F.sequence("start", F.col("end") - 1), lambda i: F.exists("marks", lambda m: (m["start"] <= i) & (i < m["end"])))
    return materialise(asks.join(collected(marks), "d", "left").where(F.col("marks").isNull() | ~marked).drop("marks"), "open")


def trimmed(x: Column | str) -> Column:
    return F.btrim(x, F.lit(WHITE))


def overlaps(docs: DataFrame, key: str, text: str, min_bytes: int) -> DataFrame:
    """doc, row and marks: the line ranges (start, end exclusive) to delete from each document."""
    line = F.split(text, "\n", -1)
    lined = docs.where(F.col(text).isNotNull()).select(
        F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("doc"), F.xxhash64(key, text).alias("row")).alias("d"),
        F.transform(line, lambda x: F.when(trimmed(x) != "", F.xxhash64(trimmed(x)))).alias("lines"),
        F.transform(line, lambda x: F.when(trimmed(x) != "", F.octet_length(x)).otherwise(0)).alias("sizes"),
        F.transform(line, lambda x: F.octet_length(trimmed(x))).alias("inner"))
    whole = F.struct(F.size("lines").alias("n"), F.xxhash64(F.transform("lines", lambda x: F.coalesce(x, F.lit(BLANK)))).alias("h"))
    # as many parts as the texts came in: the columns kept are small, the work on them is not
    parts = max(docs.rdd.getNumPartitions(), docs.sparkSession.sparkContext.defaultParallelism)
    lined = materialise(lined.repartition(parts, "d").dropDuplicates(["d"]).withColumn("whole", whole), "lines")
    # a document of the same lines as an earlier one is aligned with the first of them: nothing is left to ask for
    heads = materialise(lined.groupBy("whole").agg(F.min("d").alias("owner"), F.max("d").alias("last"))
                        .where("owner < last").select("whole", "owner"), "heads")
    copies = lined.select("d", "whole").join(heads, "whole").where("owner < d").select("d", "owner")
    singles = lined.join(heads, "whole", "left").where("owner IS NULL OR owner = d")
    runs = materialise(runs_of(singles, min_bytes), "runs")
    short = materialise(runs.where("ask AND NOT offer").select("h").distinct(), "short")
    if not short.isEmpty():
        runs = runs.unionByName(runs_of(singles, min_bytes, short=True).join(short, "h", "left_semi"))
    # written first: both sides of the join are then plain scans, whose skewed keys Spark can split
    first = materialise(runs.groupBy("h").agg(F.min(F.when(F.col("offer"), F.col("d"))).alias("owner"), F.max(F.when(F.col("ask"), F.col("d"))).alias("last"))
                        .where("owner < last").select("h", "owner"), "first")
    asks = materialise(runs.where("ask").join(first, "h").where("owner < d").select("h", "d", "start", "end", "owner"), "asks")
    tried = materialise(asks.select("d", "owner").union(copies).distinct(), "pairs")
    marks = aligned(tried, lined, min_bytes)
    asks = open_runs(asks, marks)
    if asks.isEmpty():
        return collected(marks)
    # what the first documents left open asks the others that have the run, about eight times as many in each round
    others = (runs.where("offer").join(asks.groupBy("h").agg(F.min("owner").alias("owner")), "h").where("owner < d")
              .select("h", F.col("d").alias("owner")).distinct())
    others = materialise(others, "others")
    rounds = others.groupBy("h").agg(F.ceil(F.log(8.0, F.count("*").cast("double"))).cast("int").alias("rounds"))
    chance = (F.pmod(F.xxhash64("owner"), F.lit(1 << 40)) + 1) / F.lit(float(1 << 40))
    others = materialise(others.join(rounds, "h").select("h", "owner", (F.col("rounds") - F.least(
        "rounds", F.floor(-F.log(8.0, chance)).cast("int"))).alias("round")), "others")
    for r in range((others.agg(F.max("round")).first()[0] or 0) + 1):
        pairs = (asks.select("h", "d").distinct().join(others.where(F.col("round") == r), "h").where("owner < d")
                 .select("d", "owner").distinct().join(tried, ["d", "owner"], "left_anti"))
        pairs = materialise(pairs, "pairs")
        if pairs.isEmpty():
            continue
        tried, found = tried.union(pairs), aligned(pairs, lined, min_bytes)
        marks = marks.union(found)
        asks = open_runs(asks, marks)
    return collected(marks)


def dedup(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", min_bytes: int = MIN_BYTES) -> DataFrame:
    """``keep`` columns, ``n_lines`` long, ``n_removed`` long and ``deduped``: the text without the deleted lines."""
    marks = overlaps(docs, key, text, min_bytes)
    marks = marks.select("d.none", F.coalesce("d.doc", F.lit(0)).alias("_doc"), F.col("d.row").alias("_hash"),
                         F.col("marks").alias("_marks")).withColumnRenamed("none", "_none")
    rows = common.packed(docs, keep, _text=text, _id=key).select(
        "_row", "_text", F.col("_id").isNull().alias("_none"), F.coalesce("_id", F.lit(0)).alias("_doc"),
        F.xxhash64("_id", "_text").alias("_hash"))
    joined = rows.join(marks, ["_none", "_doc", "_hash"], "left")
    lines = F.split("_text", "\n", -1)
    left = F.filter(lines, lambda _, i: ~F.exists("_marks", lambda m: (m["start"] <= i) & (i < m["end"])))
    n_lines = F.coalesce(F.size(lines), F.lit(0)).cast("long")
    left = F.when(F.col("_marks").isNull(), lines).otherwise(left)
    return (joined.withColumn("_left", left)
            .select("_row.*", n_lines.alias("n_lines"), (n_lines - F.coalesce(F.size("_left"), F.lit(0))).alias("n_removed"),
                    F.when(F.col("_marks").isNull(), F.col("_text")).otherwise(F.array_join("_left", "\n")).alias("deduped")))


def result(docs: DataFrame) -> DataFrame:
    return dedup(docs, ["doc_id"]).withColumnRenamed("deduped", "text")


def shortened(docs: DataFrame) -> DataFrame:
    """Documents with what is left of their texts, and its length in ``n_chars`` where that column
    exists. Documents of which nothing is left go; those that had no line to lose stay."""
    rows = docs.select(F.struct("*").alias("_all"), F.col("doc_id").alias("_id"), F.col("text").alias("_t"))
    done = dedup(rows, ["_all"], "_id", "_t").where((F.col("n_removed") == 0) | (trimmed("deduped") != ""))
    new = {"text": F.col("deduped"), "n_chars": F.length("deduped").cast("long")}
    return done.select(*[(new[c] if c in new else F.col(f"_all.`{c}`")).alias(c) for c in docs.columns])
