"""Byte-level BPE encoding and decoding with DuckDB recursive queries inside each partition.

A text is cut by the pattern of the vocabulary. Its distinct pieces become rows
(piece, position, token, next position and token), one per byte at first. A recursive query joins neighbouring
tokens with the merge table, contracts the leftmost pair of least rank of every piece, gives both neighbours
the new token and repeats until no piece has a pair left. Decoding joins a buffer's tokens with their bytes and puts those of each text
together by an ordered aggregate. Pieces recur, so they are encoded once each
and remembered up to a bound of bytes.

The vocabulary has a fixed size (a rank file), so it is broadcast. Each row is encoded where
it was read: no shuffle, no group, memory bounded by the buffer. A null text counts as empty
and has no tokens; repeated rows are encoded each; extra columns do not reach the workers.
"""

from __future__ import annotations

import base64
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm import common
from bedside.llm.remembered import Remembered, ends_of

#: Texts are handled in buffers of so many bytes, new words in slices of so many.
BUFFER_BYTES, SLICE = 1 << 20, 20_000
#: Bytes of remembered words in a worker.
WORDS = 120 << 20

_ENCODE = """
WITH RECURSIVE t(w, p, id, np, nid, live) AS (
  SELECT w, p, id, np, nid, true FROM start
  UNION ALL
  SELECT t.w, t.p, CASE WHEN t.p = best.hit THEN best.made ELSE t.id END,
         CASE WHEN t.p = best.hit THEN best.np ELSE t.np END,
         CASE WHEN t.p = best.hit THEN best.nid WHEN t.np = best.hit THEN best.made ELSE t.nid END, best.w IS NOT NULL
  FROM (SELECT * FROM t WHERE live) t
  LEFT JOIN (SELECT c.w, c.hit, c.gone, c.made, g.np, g.nid
             FROM (SELECT t.w, arg_min(t.p, (m.made::BIGINT << 32) | t.p) AS hit,
                          arg_min(t.np, (m.made::BIGINT << 32) | t.p) AS gone, min(m.made) AS made
                   FROM t JOIN merges m ON m.pair = ((t.id::BIGINT << 32) | t.nid) WHERE t.live GROUP BY t.w) c
             JOIN t g ON g.w = c.w AND g.p = c.gone) best ON best.w = t.w
  WHERE t.p IS DISTINCT FROM best.gone
)
SELECT w, id FROM t WHERE NOT live ORDER BY w, p
"""
_DECODE = """
SELECT w, unhex(string_agg(hex, '')) AS bytes
FROM (SELECT w, v.hex FROM tokens JOIN vocabulary v USING (id) ORDER BY w, p) GROUP BY w
"""


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 token and rank per line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (x.split() for x in lines if x.strip())}


def merge_table(ranks: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Every pair of tokens whose bytes together are a token; rank and id of the latter are one number."""
    rows = [(ranks[t[:i]] << 32 | ranks[t[i:]], made) for t, made in ranks.items() for i in range(1, len(t))
            if t[:i] in ranks and t[i:] in ranks]
    return np.array([r[0] for r in rows], dtype=np.int64), np.array([r[1] for r in rows], dtype=np.int32)


class Coder:
    """One partition's DuckDB tables and remembered pieces."""

    def __init__(self, ranks: dict[bytes, int], merges: tuple[np.ndarray, np.ndarray], pattern: str) -> None:
        import duckdb
        import regex

        # memory alone: nothing is spilled to a folder of the executor
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "400MB", "temp_directory": ""})
        self.db.register("_merges", pa.table({"pair": merges[0], "made": merges[1]}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM _merges")
        self.db.register("_vocabulary", pa.table({"id": pa.array(ranks.values(), pa.int32()),
                                                  "hex": [t.hex() for t in ranks]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT * FROM _vocabulary")
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        self.bytes_id = np.array([ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.words = Remembered(self._words, {"ids": np.int32}, WORDS)

    def _merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words one after another, and how many each has."""
        flat, lengths = [np.empty(0, np.int32)], [np.empty(0, np.int64)]
        for at in range(0, len(words), SLICE):
            part = words[at:at + SLICE]
            n = np.fromiter(map(len, part), dtype=np.int64, count=len(part))
            begin = np.cumsum(n) - n
            w = np.repeat(np.arange(len(part), dtype=np.int32), n)
            p = (np.arange(len(w)) - np.repeat(begin, n)).astype(np.int32)
            ids = self.bytes_id[np.frombuffer(b"".join(part), dtype=np.uint8)]
            last = p == np.repeat(n, n) - 1  # the last byte of a word has no neighbour
            self.db.register("start", pa.table({"w": w, "p": p, "id": ids, "np": pa.array(p + 1, mask=last),
                                                "nid": pa.array(np.roll(ids, -1), mask=last)}))
            got = self.db.sql(_ENCODE).to_arrow_table()
            self.db.unregister("start")
            flat.append(got["id"].to_numpy())
            lengths.append(np.bincount(got["w"].to_numpy(), minlength=len(part)))
        return np.concatenate(flat), np.concatenate(lengths)

    def _words(self, new: list[str]) -> dict:
        """A word that is a token by itself needs no merging."""
        spelt = [w.encode("utf-8", "surrogatepass") for w in new]
        whole = np.fromiter(map(self.ranks.get, spelt, itertools.repeat(-1)), dtype=np.int32, count=len(spelt))
        merged, n = self._merge([spelt[i] for i in np.flatnonzero(whole < 0).tolist()])
        lengths = np.ones(len(new), dtype=np.int64)
        lengths[whole < 0] = n
        flat = np.repeat(whole, lengths)
        flat[np.repeat(whole < 0, lengths)] = merged
        return {"ids": (lengths, flat)}

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's end, from 0."""
        pieces = [self.find(t) if t else [] for t in texts]
        flat, lengths = self.words.take(list(itertools.chain.from_iterable(pieces)), "ids")
        return flat, ends_of(lengths, list(map(len, pieces)))

    def decode(self, ids: np.ndarray, ends: np.ndarray) -> list[bytes]:
        """Bytes of each text, by one ordered aggregate over the buffer's tokens."""
        n = np.diff(ends)
        self.db.register("tokens", pa.table({"w": np.repeat(np.arange(len(n), dtype=np.int32), n), "p": np.arange(len(ids), dtype=np.int32),
                                             "id": np.ascontiguousarray(ids)}))
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("tokens")
        out = [b""] * len(n)
        for w, spelt in zip(got["w"].to_pylist(), got["bytes"].to_pylist(), strict=True):
            out[w] = spelt
        return out


def encode(docs: DataFrame, ranks_path: str, pattern: str, key: str = "doc_id", text: str = "text",
           decode: bool = False) -> DataFrame:
    """``key``, ``ids`` array of int and, with ``decode``, ``decoded`` binary: the bytes that the ids stand for."""
    spark = docs.sparkSession
    ranks = read_ranks(ranks_path)
    shared = spark.sparkContext.broadcast((ranks, merge_table(ranks), pattern))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in common.buffered(batches, "_text", BUFFER_BYTES):
            coder = coder or Coder(*shared.value)
            flat, ends = coder.encode(batch.column("_text").to_pylist())
            out = [batch.column("_key"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))]
            if decode:
                out.append(pa.array(coder.decode(flat, ends), pa.binary()))
            yield pa.RecordBatch.from_arrays(out, ["_key", "ids", "decoded"][:len(out)])

    kind = docs.schema[key].dataType.simpleString()
    return (docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
            .mapInArrow(run, f"_key {kind}, ids array<int>" + ", decoded binary" * decode)
            .withColumnRenamed("_key", key))


def decode(tokens: DataFrame, ranks_path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``key`` and ``decoded`` binary of arrays of ids; null arrays decode to no bytes."""
    ranks = read_ranks(ranks_path)
    shared = tokens.sparkSession.sparkContext.broadcast((ranks, merge_table(ranks), ""))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = None
        for batch in common.buffered(batches, "_ids", BUFFER_BYTES):
            coder = coder or Coder(*shared.value)
            rows = [x or [] for x in batch.column("_ids").to_pylist()]
            flat = np.array([i for x in rows for i in x], dtype=np.int32)
            done = coder.decode(flat, np.cumsum([0, *map(len, rows)]))
            yield pa.RecordBatch.from_arrays([batch.column("_key"), pa.array(done, pa.binary())],
                                             ["_key", "decoded"])

    kind = tokens.schema[key].dataType.simpleString()
    return (tokens.select(F.col(key).alias("_key"), F.col(ids).alias("_ids"))
            .mapInArrow(run, f"_key {kind}, decoded binary").withColumnRenamed("_key", key))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token counts and digests of ids and of decoded bytes per document."""
    return encode(docs, ranks_path, pattern, decode=True).select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        common.sha256_hex(F.array_join("ids", " ")).alias("ids_sha256"),
        common.sha256_hex(F.col("decoded")).alias("decoded_sha256"))
