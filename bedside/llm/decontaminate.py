"""Benchmark decontamination by Wu-Manber search over words.

Patterns are the 13-word windows of the benchmark items (a shorter item is one window),
grouped by length. A shift table over blocks of two words tells how far the search may jump;
where it may not, the block is the end of some window, its bucket is looked up by the window's
first block and the candidates there are compared word by word.

Documents are searched where they are read: no shuffle and no pairs. The benchmark is cut into
blocks of bounded size by a hash of the item; the tables of one block are broadcast, and the
blocks follow each other over the same rows, each adding its hits. Null texts have no words,
an item without words never occurs, items of equal id count once and an item without an id
marks words but is not listed. An empty benchmark hits nothing.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.llm import common

WINDOW, BLOCK_BYTES = 13, 8 << 20


class Searcher:
    """Shift tables, buckets and windows of one pattern length each."""

    def __init__(self, items: list[tuple[int | None, str | None]], window: int) -> None:
        self.ids: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = defaultdict(set)
        for item, text in items:
            words = [self.ids.setdefault(w, len(self.ids)) for w in common.folded_words(common.is_null_or(text))]
            m = min(window, len(words))
            for i in range(len(words) - m + 1) if m else ():
                owners[tuple(words[i:i + m])].add(item)
        self.groups: dict[int, tuple[dict, dict]] = {}
        for pattern, who in owners.items():
            m = len(pattern)
            shift, buckets = self.groups.setdefault(m, ({}, {}))
            b = min(2, m)
            for end in range(b, m + 1):
                block = pattern[end - b:end]
                shift[block] = min(shift.get(block, m), m - end)
            buckets.setdefault(pattern[-b:], {}).setdefault(pattern[:b], []).append((pattern, who))

    def search(self, text: bytes) -> tuple[int, list[int], set]:
        """Number of words, hit ranges (start, end, ...) in order, and the items found."""
        words = common.folded_words(text)
        ids, n = list(map(self.ids.get, words)), len(words)
        ranges: list[tuple[int, int]] = []
        found: set = set()
        for m, (shift, buckets) in self.groups.items():
            b = min(2, m)
            jump, end = m - b + 1, m
            while end <= n:  # the window under test ends before ``end``
                last = ids[end - 1]
                if last is None:
                    end += m
                    continue
                block = (last,) if b == 1 else (ids[end - 2], last)
                step = shift.get(block, jump)
                if step:
                    end += step
                    continue
                here = tuple(ids[end - m:end])
                for pattern, who in buckets[block].get(here[:b], ()):
                    if pattern == here:
                        ranges.append((end - m, end))
                        found |= who
                end += 1
        return n, merged(ranges), found


def merged(ranges: list[tuple[int, int]]) -> list[int]:
    out: list[int] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1]:
            out[-1] = max(out[-1], end)
        else:
            out += (start, end)
    return out


def scan(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item: str = "item_id",
         item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns, ``n_words`` long, ``n_hit`` long, ``ranges`` array of int (start and end
    of each run of hit words, in turn) and ``items`` array of the item ids found, each once."""
    spark = docs.sparkSession
    items = benchmark.select(F.col(item).alias("item"), F.col(item_text).alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // block_bytes
    kind = benchmark.schema[item].dataType.simpleString()
    out = common.packed(docs, keep, _text=text).withColumns({
        "_words": F.lit(0).cast("long"), "_ranges": F.array().cast("array<int>"),
        "_items": F.array().cast(f"array<{kind}>")})
    schema = out.schema
    for b in range(blocks):
        part = items if blocks == 1 else items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b)
        shared = spark.sparkContext.broadcast([tuple(r) for r in part.collect()])

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            searcher = Searcher(shared.value, window)
            for batch in batches:
                words, ranges, found = [], [], []
                for text, old, known in zip(*(batch.column(c).to_pylist() for c in ("_text", "_ranges", "_items")),
                                            strict=True):
                    n, hit, items = searcher.search(common.is_null_or(text))
                    words.append(n)
                    ranges.append(merged([*zip(old[::2], old[1::2], strict=True),
                                          *zip(hit[::2], hit[1::2], strict=True)]) if old else hit)
                    found.append(sorted({*known, *(items - {None})}))
                names = ["_row", "_text", "_words", "_ranges", "_items"]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("_row"), batch.column("_text"), pa.array(words, pa.int64()),
                     pa.array(ranges, pa.list_(pa.int32())), pa.array(found, batch.column("_items").type)], names)

        out = out.mapInArrow(run, schema)
    starts = F.filter("_ranges", lambda _, i: i % 2 == 0)
    ends = F.filter("_ranges", lambda _, i: i % 2 == 1)
    n_hit = F.aggregate(F.zip_with(ends, starts, lambda e, s: (e - s).cast("long")), F.lit(0).cast("long"),
                        lambda a, x: a + x)
    return out.select("_row.*", F.col("_words").alias("n_words"), n_hit.alias("n_hit"),
                      F.col("_ranges").alias("ranges"), F.col("_items").alias("items"))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    """A twentieth of the words at least, and one."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def digests(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    listed = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return scan(docs, benchmark, ["doc_id"]).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        common.sha256_hex(listed).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Documents that are not contaminated, with their columns."""
    rows = docs.select(F.struct("*").alias("_doc"), F.col("text").alias("_t"))
    seen = scan(rows, benchmark, ["_doc"], "_t")
    return seen.where(~contaminated(F.col("n_hit"), F.col("n_words"))).select("_doc.*")
