"""Substring dedup on a compacted De Bruijn graph of token k-mers.

The edges are the windows of ``window`` consecutive words. A window that occurs in several
documents need not be sent around alone: consecutive windows of a document that have their least
k-mer (by hash; the leftmost of equal ones) at the same place form one nonbranching run, and a
run is one row. Both the place and, inside a shared passage, the run follow from the words alone,
so documents that share a passage have equal runs.

* Runs whose k-mer lies in one document only are done with: their windows occur nowhere else.
* Runs of equal words are one path of the graph, known by its first source coordinate (document
  and word). Joined back, it marks the run in every later document.
* Where one k-mer has runs of different words the path branches: a shared passage begins or ends
  there, or texts differ. One copy of each such run, fetched by its coordinate, is opened into
  single windows, which are compared the same way.

Marked stretches of a document that touch or overlap are compacted, and their words removed.
Equality means equality of two 64-bit hashes of the words at the coordinates.

Documents compete by id. Rows of equal id are one document, whose rows don't mark each other; a
null id is neither smaller nor larger than another, so such a row is kept whole. Null texts have
no words; a document of fewer words than a window is kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm import common
from bedside.llm.decontaminate import merged
from bedside.sources.tables import materialise

WINDOW, ANCHOR = 50, 8
#: Odd bases of the two hashes.
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def least_places(kmers: np.ndarray, width: int) -> np.ndarray:
    """Place of the least value (leftmost of equal ones) in each ``width`` consecutive values."""
    views = np.lib.stride_tricks.sliding_window_view(kmers, width)
    return np.concatenate([views[i:i + 4096].argmin(axis=1) + np.arange(i, min(i + 4096, len(views)))
                           for i in range(0, len(views), 4096)])


class Runs:
    """Cuts texts into runs of windows, and runs into windows."""

    def __init__(self, window: int, k: int) -> None:
        self.window, self.k = window, k
        self.words, (self.one, self.two) = common.WordHashes(), map(common.Rolling, BASES)

    def of(self, raw: bytes) -> list[np.ndarray] | None:
        """start, windows, anchor and two hashes of each run of a text."""
        words = raw.split()
        if len(words) < self.window:
            return None
        hashes = self.words.of(words)
        kmers = self.one.runs(hashes, self.k)
        places = least_places(kmers, self.window - self.k + 1)
        starts = np.flatnonzero(np.concatenate([[True], places[1:] != places[:-1]]))
        n = np.diff(np.append(starts, len(places)))
        ends = starts + n + self.window - 1
        return [starts.astype(np.int32), n.astype(np.int32), kmers[places[starts]].view(np.int64),
                self.one.spans(hashes, starts, ends).view(np.int64), self.two.spans(hashes, starts, ends).view(np.int64)]

    def windows(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        hashes = self.words.of(raw.split())
        return tuple(r.runs(hashes, self.window).view(np.int64) for r in (self.one, self.two))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))


def runs(docs: DataFrame, window: int, k: int) -> DataFrame:
    """One row per run of windows: doc, row, start, n, anchor, h, g."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Runs(window, k)
        for batch in batches:
            parts, lengths = [], []
            for text in batch.column("text").to_pylist():
                got = cutter.of(common.is_null_or(text))
                lengths.append(len(got[0]) if got else 0)
                if got:
                    parts.append(got)
            if parts:
                at = pa.array(np.repeat(np.arange(len(lengths)), lengths))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc").take(at), batch.column("row").take(at),
                     *[pa.array(np.concatenate(c)) for c in zip(*parts, strict=True)]],
                    ["doc", "row", "start", "n", "anchor", "h", "g"])

    kind = docs.schema["doc"].dataType.simpleString()
    return docs.where("doc IS NOT NULL").mapInArrow(
        run, f"doc {kind}, row long, start int, n int, anchor long, h long, g long")


def opened(wanted: DataFrame, docs: DataFrame, window: int, k: int) -> DataFrame:
    """The windows of the wanted runs (doc, row, start, n, h, g): doc, h, g, offset, a, b."""
    by_doc = wanted.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "n", "h", "g")).alias("runs"))
    # a document's runs are bounded by its length; equal rows give equal windows more than once, which is harmless
    joined = docs.join(by_doc, ["doc", "row"]).select("doc", "text", "runs")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cutter = Runs(window, k)
        for batch in batches:
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i, (text, wants) in enumerate(zip(batch.column("text").to_pylist(), batch.column("runs").to_pylist(),
                                                  strict=True)):
                a, b = cutter.windows(common.is_null_or(text))
                for r in wants:
                    s, n = r["start"], r["n"]
                    for c, v in zip(out, (np.full(n, i), np.full(n, r["h"], np.int64), np.full(n, r["g"], np.int64),
                                          np.arange(n, dtype=np.int32), a[s:s + n], b[s:s + n]), strict=True):
                        c.append(v)
            if out[0]:
                cols = [np.concatenate(c) for c in out]
                yield pa.RecordBatch.from_arrays([batch.column("doc").take(pa.array(cols[0])), *map(pa.array, cols[1:])],
                                                 ["doc", "h", "g", "offset", "a", "b"])

    kind = docs.schema["doc"].dataType.simpleString()
    return joined.mapInArrow(run, f"doc {kind}, h long, g long, offset int, a long, b long")


def repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, k: int = ANCHOR) -> DataFrame:
    """Stretches to remove: doc, row (hash of id and text), start and end word (exclusive)."""
    rows = _keyed(docs, key, text)
    edges = materialise(runs(rows, window, k), "edges")
    # written first: both sides of the joins are then plain scans, whose skewed keys Spark can split
    anchors = materialise(edges.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"))
                          .where("lo < hi").select("anchor"), "anchors")
    shared = materialise(edges.join(anchors, "anchor", "left_semi"), "shared")
    paths = materialise(shared.groupBy("anchor", "h", "g").agg(
        F.min(F.struct("doc", "row", "start", "n")).alias("first"), F.max("doc").alias("last")), "paths")

    # equal runs: all but the first document's
    again = paths.where("first.doc < last").select("h", "g", F.col("first.doc").alias("owner"))
    whole = (shared.join(again, ["h", "g"]).where("doc > owner")
             .select("doc", "row", "start", (F.col("start") + F.col("n") + (window - 1)).alias("end")))

    # branching k-mers: window by window, one copy of each run
    forks = materialise(paths.groupBy("anchor").agg(F.count(F.lit(1)).alias("v")).where("v > 1").select("anchor"), "forks")
    wanted = paths.join(forks, "anchor", "left_semi").select("first.*", "h", "g")
    windows = materialise(opened(wanted, rows, window, k), "windows")
    least = materialise(windows.groupBy("a", "b").agg(F.min("doc").alias("owner"), F.max("doc").alias("last"))
                        .where("owner < last").drop("last"), "least")
    # windows of a run lie closer than they are long, so the marked ones cover all between the outermost
    partly = (windows.join(least, ["a", "b"]).where("doc > owner")
              .groupBy("h", "g", "doc").agg(F.min("offset").alias("lo"), F.max("offset").alias("hi")))
    part = shared.join(partly, ["h", "g", "doc"]).select(
        "doc", "row", (F.col("start") + F.col("lo")).alias("start"), (F.col("start") + F.col("hi") + window).alias("end"))
    return whole.unionByName(part)


def remove(docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", window: int = WINDOW,
           k: int = ANCHOR) -> DataFrame:
    """``keep`` columns, ``n_words`` long, ``n_removed`` long, ``kept`` binary: the remaining words joined by a space."""
    marks = (repeats(docs, key, text, window, k).groupBy(F.col("doc").alias("_doc"), F.col("row").alias("_hash"))
             .agg(F.collect_set(F.struct("start", "end")).alias("_marks")))
    rows = common.packed(docs, keep, _text=text, _doc=key).withColumn("_hash", F.xxhash64("_doc", "_text"))
    joined = rows.join(marks, ["_doc", "_hash"], "left").select("_row", "_text", "_marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, removed, kept = [], [], []
            for text, marks in zip(batch.column("_text").to_pylist(), batch.column("_marks").to_pylist(), strict=True):
                words = common.is_null_or(text).split()
                ends = merged([(m["start"], m["end"]) for m in marks or ()])
                left, at = [], 0
                for start, end in zip(ends[::2], ends[1::2], strict=True):
                    left += words[at:start]
                    at = end
                left += words[at:]
                counts.append(len(words))
                removed.append(len(words) - len(left))
                kept.append(b" ".join(left))
            yield pa.RecordBatch.from_arrays([batch.column("_row"), pa.array(counts, pa.int64()),
                                              pa.array(removed, pa.int64()), pa.array(kept, pa.binary())],
                                             ["_row", "n_words", "n_removed", "kept"])

    schema = common.with_fields(joined.select("_row"), "n_words long, n_removed long, kept binary")
    return joined.mapInArrow(run, schema).select("_row.*", "n_words", "n_removed", "kept")


def digests(docs: DataFrame) -> DataFrame:
    return remove(docs, ["doc_id"]).select("doc_id", "n_words", "n_removed",
                                           common.sha256_hex(F.col("kept")).alias("kept_sha256"))
