"""Shortest-pack-first packing of token sequences over the histogram of lengths.

Texts are encoded and cut into pieces of at most ``capacity`` ids. What is then planned is the
histogram of piece lengths, at most ``capacity`` numbers however many documents there are. Lengths
are placed longest first, all pieces of a length at once, onto the packs with the most room left.
Packs of the same content are one pattern with a count: a stretch of sequence numbers. Placing
fewer pieces than a pattern has packs splits the pattern in two. As many packs are opened as the ids need; a piece
that no pack has room for is cut to fill the roomiest one, and the rest of it is placed when its
length comes up. Cuts leave at least ``least`` ids in the pack, more packs are opened instead.

A pattern's slot takes the pieces of one length from one rank on, so patterns join back to the
documents by (length, rank). Ranks are numbers inside the writing task plus counts of the tasks before:
no length is gathered anywhere. Plan and histogram are bounded by the number of lengths. Texts
are read and encoded once; ids travel only for pieces that were cut, or where asked for.

A null text counts as empty: its document is the end id alone. Repeated rows, null keys and equal
texts are documents of their own, extra columns are not read, very long texts become many pieces,
and an empty table has no sequences.
"""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections import defaultdict, deque
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.llm import common
from bedside.llm.remembered import Remembered, byte_alphabet, ends_of
from bedside.sources.tables import materialise

CAPACITY, END_ID, LEAST = 2048, 1, 64
#: Texts are encoded in buffers of so many bytes.
BUFFER_BYTES, STRETCHES, WORDS = 4 << 20, 128 << 20, 64 << 20
#: How a tokenizer's file says that it lower-cases, drops white space and cuts words.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {"type": "Sequence", "pretokenizers": [
    {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
    {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
RANK_BITS = 40
SLOT = ("level", "length", "first", "count", "start", "part", "sequence", "packs", "offset")


def place(histogram: dict[int, int], capacity: int = CAPACITY, least: int = LEAST) -> np.ndarray:
    """Slots, one row of ``SLOT`` each: ``count`` pieces of ``length`` from rank ``first`` on have ``part`` ids from
    ``start`` on placed at ``offset`` of ``packs`` sequences from ``sequence`` on, again and again ``part`` further."""
    bins: dict[int, list] = defaultdict(list)
    for length, n in histogram.items():
        bins[length].append((length, 0, n, 0, 0))
    opened = -(-sum(length * n for length, n in histogram.items()) // capacity)
    patterns: dict[int, deque] = defaultdict(deque, {capacity: deque([(0, opened)])})
    rooms = [-capacity] if opened else []
    out = []

    def keep(room: int, pattern: tuple[int, int], first: bool = False) -> None:
        if room:
            if not patterns[room]:
                heapq.heappush(rooms, -room)
            (patterns[room].appendleft if first else patterns[room].append)(pattern)

    for length in range(capacity, 0, -1):
        for whole, first, n, start, level in bins.pop(length, ()):
            while n:
                while rooms and not patterns[-rooms[0]]:
                    heapq.heappop(rooms)
                room = -rooms[0] if rooms else 0
                if room < min(length, least):
                    more = -(-n // (capacity // length))
                    keep(capacity, (opened, more))
                    opened += more
                    continue
                sequence, packs = patterns[room].popleft()
                part, taken, times = min(length, room), min(n, packs), 1
                if part == length and n >= packs:
                    # several at once, as long as these stay the shortest packs
                    while rooms and not patterns[-rooms[0]]:
                        heapq.heappop(rooms)
                    times = max(1, min((room + (rooms[0] if rooms else 0)) // length, n // packs))
                if taken < packs:
                    keep(room, (sequence + taken, packs - taken), True)
                out.append((level, whole, first, taken * times, start, part, sequence, taken, capacity - room))
                keep(room - part * times, (sequence, taken))
                if part < length:
                    bins[length - part].append((whole, first, taken, start + part, level + 1))
                first, n = first + taken * times, n - taken * times
    return np.array(out, dtype=np.int64).reshape(-1, len(SLOT))


class Slots:
    """Where the pieces of a (length, rank) go: one sorted table per number of cuts before."""

    def __init__(self, slots: np.ndarray) -> None:
        self.levels = []
        for level in range(int(slots[:, 0].max()) + 1 if len(slots) else 0):
            rows = slots[slots[:, 0] == level, 1:]
            keys = rows[:, 0] << RANK_BITS | rows[:, 1]
            order = np.argsort(keys)
            self.levels.append((keys[order], rows[order]))

    def find(self, length: np.ndarray, rank: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
        """Per level: rows found, and their start, part, sequence and offset."""
        key = length << RANK_BITS | rank
        for keys, rows in self.levels:
            at = np.searchsorted(keys, key, side="right") - 1
            found = np.flatnonzero((at >= 0) & (key - keys[at] < rows[at, 2]))
            _, _, _, start, part, sequence, packs, offset = rows[at[found]].T
            nth = key[found] - keys[at[found]]
            yield found, start, part, sequence + nth % packs, offset + nth // packs * part


#: Stretches of ASCII and Latin-1 letters, which need no Unicode tables, and their words in lower case, one stretch a line.
_PLAIN = "^[\x20-\x7e\xc0-\xd6\xd8-\xf6\xf8-\xff]*$"
_WORDS = re.compile("\n|'s|'t|'re|'ve|'m|'ll|'d|[a-z\xdf-\xf6\xf8-\xff]+|[0-9]|[^\n a-z0-9\xdf-\xf6\xf8-\xff]+")


def listed(strings: pa.StringArray) -> list[str]:
    return strings.to_numpy(zero_copy_only=False).tolist()  # several times as fast as to_pylist()


def numbered(strings: pa.StringArray) -> tuple[list[str], np.ndarray]:
    """The distinct strings, and for every string the number of its own."""
    coded = strings.dictionary_encode()
    return listed(coded.dictionary), coded.indices.to_numpy()


class Encoder:
    """Ids of stretches without space and line feed: the tokenizer drops white space, and no match spans it.

    Plain stretches are lower-cased and cut into words here and their distinct words encoded by the tokenizer's model, where
    its file says that this is what it does; all other stretches go through the whole tokenizer. Words go to the model as one
    text with spaces between; its ids are told apart by the suffix of a word's last token, which no word has inside it: a
    suffix of letters and signs is never in one word."""

    def __init__(self, tokenizer_json: str) -> None:
        import tokenizers

        self.whole = tokenizers.Tokenizer.from_str(tokenizer_json)
        spec = json.loads(tokenizer_json)
        self.model = None
        if spec["normalizer"] == NORMALIZER and spec["pre_tokenizer"] == PRE_TOKENIZER:
            self.model = tokenizers.Tokenizer(self.whole.model)
            self.line = tokenizers.Tokenizer(self.whole.model)
            self.line.pre_tokenizer = tokenizers.pre_tokenizers.CharDelimiterSplit(" ")
            vocabulary = spec["model"]["vocab"]
            self.last = np.zeros(max(vocabulary.values(), default=0) + 1, dtype=bool)
            if spec["model"].get("end_of_word_suffix") == "</w>":
                self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.letters = np.zeros(256, dtype="<u4")
        for c, b in byte_alphabet().items():
            self.letters[b] = ord(c)
        self.letters[ord(" ")] = ord(" ")
        self.words = Remembered(self._words, {"ids": np.uint32}, WORDS)

    @staticmethod
    def _flat(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        return n, np.fromiter(chain.from_iterable(ids), np.uint32, n.sum())

    def _words(self, new: list[str]) -> dict:
        line = " ".join(new)
        if not line.isascii():
            line = self.letters[np.frombuffer(line.encode(), np.uint8)].tobytes().decode("utf-32-le")
        ids = np.array(self.line.encode_batch_fast([line], add_special_tokens=False)[0].ids, dtype=np.uint32)
        stops = np.flatnonzero(self.last[ids]) + 1
        if len(stops) == len(new) and stops[-1] == len(ids):
            return {"ids": (np.diff(stops, prepend=0), ids)}
        return {"ids": self._flat([x.ids for x in self.model.encode_batch_fast(line.split(" "), add_special_tokens=False)])}

    def _plain(self, stretches: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each plain stretch, and the ids."""
        words, at = numbered(pa.array(_WORDS.findall("\n".join(listed(stretches)).lower()), pa.string()))
        numbers = self.words.find([w for w in words if w != "\n"])
        cut = words.index("\n") if "\n" in words else len(words)
        cuts, at = np.flatnonzero(at == cut), at[at != cut]
        flat, lengths = self.words.flat["ids"].at(numbers[at - (at > cut)])
        before = np.concatenate([[0], np.cumsum(lengths)])  # cuts are not words
        return np.diff(before[[0, *(cuts - np.arange(len(cuts))), len(lengths)]]), flat

    def learn(self, new: list[str]) -> dict:
        stretches = pa.array(new, pa.string())
        fit = np.zeros(len(new), dtype=bool)
        if self.model:
            fit = pc.and_not(pc.match_substring_regex(stretches, _PLAIN), pc.match_substring(stretches, "<|")).to_numpy(zero_copy_only=False)
        counts, order = np.zeros(len(new), dtype=np.int64), np.concatenate([np.flatnonzero(fit), np.flatnonzero(~fit)])
        flat = np.empty(0, np.uint32)
        if fit.any():
            counts[fit], flat = self._plain(stretches.filter(pa.array(fit)))
        counts[~fit], rest = self._flat([x.ids for x in self.whole.encode_batch_fast(listed(stretches.filter(pa.array(~fit))), add_special_tokens=False)])
        # put both in the order of the stretches
        parts = np.concatenate([flat, rest])
        begin = np.empty(len(new), dtype=np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return {"ids": (counts, parts[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())])}


def encoded(texts: pa.StringArray, known: Remembered) -> tuple[np.ndarray, np.ndarray]:
    """Ids of the texts one after another, and where each text begins and the last one ends. Null counts as empty."""
    cuts = pc.split_pattern(pc.replace_substring(pc.fill_null(texts, ""), "\n", " "), " ")
    stretches, at = numbered(cuts.flatten())
    numbers = known.find(stretches)  # before its table is looked up: it may be a new one afterwards
    flat, lengths = known.flat["ids"].at(numbers[at])
    return flat, ends_of(lengths, pc.list_value_length(cuts).to_numpy())


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Written table of ``_key``, ``doc_tokens``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit, by zstd),
    ``nth`` (number among the pieces of this length in the writing task), ``ids_crc32``, ``task`` and ``piece``."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:
        shared = spark.sparkContext.broadcast(f.read())
    names = ["_key", "doc_tokens", "start", "length", "ids", "ids_crc32", "nth"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import zstandard
        press = zstandard.ZstdCompressor(level=1).compress
        known, seen = None, np.zeros(capacity + 1, dtype=np.int64)
        for batch in common.buffered(batches, "_text", BUFFER_BYTES):
            known = known or Remembered(Encoder(shared.value).learn, {"ids": np.uint32}, STRETCHES)
            flat, ends = encoded(batch.column("_text"), known)
            flat = np.insert(flat, ends[1:], np.uint32(end_id)).astype("<u4")
            ends = ends + np.arange(len(ends))
            tokens = np.diff(ends)
            many = -(-tokens // capacity)
            row = np.repeat(np.arange(len(tokens)), many)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)) * capacity
            length = np.minimum(tokens[row] - start, capacity)
            nth = np.empty(len(row), dtype=np.int64)
            for n in np.unique(length).tolist():
                at = np.flatnonzero(length == n)
                nth[at] = seen[n] + np.arange(len(at))
                seen[n] += len(at)
            stops, raw = (np.cumsum(length) * 4).tolist(), memoryview(flat).cast("B")
            parts = [raw[i:j] for i, j in zip([0, *stops], stops)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array(row)), *map(pa.array, (tokens[row], start, length)), pa.array(map(press, parts), pa.binary()),
                 pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(nth)], names)

    kind = docs.schema[key].dataType.simpleString()
    cut = (docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
           .mapInArrow(run, f"_key {kind}, doc_tokens long, start long, length long, ids binary, ids_crc32 long, nth long")
           .select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("piece")))
    return materialise(cut, "pieces")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, least: int = LEAST, key: str = "doc_id", text: str = "text",
         with_ids: bool = False) -> DataFrame:
    """One row per placed piece: ``key``, ``start`` (its document's ids before it), ``length``, ``ids_crc32``, ``doc_tokens``,
    ``sequence_id``, ``offset`` and, with ``with_ids``, ``ids`` (little-endian unsigned 32-bit)."""
    spark = docs.sparkSession
    cut = pieces(docs, tokenizer_path, capacity, end_id, key, text)
    counts = materialise(cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n")), "lengths")
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    shared = spark.sparkContext.broadcast(place(histogram, capacity, least))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    light = cut.drop("ids").join(bases, ["length", "task"]).withColumn("rank", F.col("base") + F.col("nth")).drop("base", "nth", "task")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = Slots(shared.value)
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            for found, *spot in slots.find(length, rank):
                rows = batch.take(pa.array(found))
                yield pa.RecordBatch.from_arrays([*rows.columns, *map(pa.array, spot)], [*rows.schema.names, *where])

    where = ["_from", "_part", "sequence_id", "offset"]
    placed = light.mapInArrow(run, common.with_fields(light, ", ".join(f"{c} long" for c in where)))
    placed = materialise(placed, "placed")
    out = [F.col("_key").alias(key), (F.col("start") + F.col("_from")).alias("start"), F.col("_part").alias("length"), "ids_crc32", "doc_tokens",
           "sequence_id", "offset", *["ids"] * with_ids]

    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard
        opened = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            ids = [opened(x)[4 * i:4 * (i + n)] for x, i, n in zip(*(batch.column(c).to_pylist() for c in ("ids", "_from", "_part")), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.drop_columns(["ids", "ids_crc32"]).columns, pa.array(ids if with_ids else [None] * len(ids), pa.binary()),
                                              pa.array(map(zlib.crc32, ids), pa.int64())], fields.names)

    partly = placed if with_ids else placed.where("_part < length")
    # the ids are the larger side whatever the size: the plan is the same for all
    partly = partly.hint("merge").join(cut.select("piece", "ids"), "piece")
    fields = common.with_fields(partly.drop("ids", "ids_crc32"), "ids binary, ids_crc32 long")
    partly = partly.mapInArrow(slices, fields).select(*out)
    return partly if with_ids else placed.where("_part = length").select(*out).unionByName(partly)
