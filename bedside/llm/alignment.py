"""Alignment of two tokenizations of the same texts, and corpus-wide counts of linked ids by external spill counting.

A text is encoded by A (a byte-level tokenizer, space+text) and by B (a piece model, which adds the space).
Both are cut before every space that stands alone between other characters: there A begins
a match and no piece of B goes across, so both encode the stretches apart, and stretches recur. Offsets where tokens of both end cut
the tokens into groups; every stretch between two neighbouring ends, of A or B, is a link of the two tokens over it.

An id pair counts once per document that holds it linked. Each writing task keeps, per buffer of documents, the
document's distinct pairs as positions in a sorted list of pairs, and spills that list with the number of documents of each
pair as a run compressed by zstd: records (pair, documents), ordered by A id and cut in cells of A ids. A k-way heap merge of
the task's runs by cell adds them up, and the result is dealt by radix of the pair (the A id and a few bits of the B id, so that a frequent A id is
dealt over several counters). A counter merges the runs of all tasks cell by cell: counts are final when their cell is, the maxima per A id follow from the order
by A id, and the counts stream back to the tasks in the order of each run. Maxima of the counters meet in a table of at most the ids of A.

What travels are pairs per task, never tokens; a pair that every document has is one record per task. A document's figures are
sums over its own positions. Texts are whole; a text that is null or empty, or whose bytes are not those
of its tokens, has no tokens. Repeated rows and null keys are documents of their own, extra columns are not read, very long
texts are buffers of their own, and an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm import common
from bedside.llm.remembered import Remembered, byte_alphabet
from bedside.sources.tables import materialise

BUFFER_BYTES, REMEMBERED = 3 << 20, 160 << 20
#: A ids per cell of a run; low bits of the B id that take part in the radix.
CELL, SPREAD = 256, 4
PAIR_BITS = 32
#: Fixed value: the pattern of byte-level pre-tokenizers.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Cut points inside a text that holds other white space than single spaces between words.
_CUT = re.compile(r"(?<=\S)(?= \S)")


def piece_bytes(piece: str) -> bytes:
    if re.fullmatch("<0x[0-9A-F]{2}>", piece):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


class Both:
    """The two tokenizers and what they make of stretches."""

    def __init__(self, tokenizer_json: str, model: bytes) -> None:
        import sentencepiece
        import tokenizers

        self.a = tokenizers.Tokenizer.from_str(tokenizer_json)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_proto=model)
        alphabet = byte_alphabet()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        spelt = {i: (bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()) for t, i in vocabulary.items()}
        self.a_bytes = [spelt.get(i, b"") for i in range(max(spelt) + 1)]
        self.b_bytes = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes))
        # every id with what may follow it in the text of groups: , or | after ids of A, , or ; after ids of B
        self.written = [b"%d%c" % (i, end) for t, ends in ((self.a_bytes, b",|"), (self.b_bytes, b",;")) for i in range(len(t)) for end in ends]
        self.width = np.array([len(w) for w in self.written], dtype=np.int64)
        self.opens = np.array([t[:1] == b" " for t in self.a_bytes])
        self.fast = self._ranked(tokenizer_json, alphabet)

    def _ranked(self, tokenizer_json: str, alphabet: dict[str, int]):
        """The same encoder by ranks, where the file is one whose ids are its merge order and that cuts by the usual byte-level pattern."""
        import json

        import tiktoken
        spec = json.loads(tokenizer_json)
        usual = spec["normalizer"] is None and spec["model"]["type"] == "BPE" and spec["pre_tokenizer"]["type"] == "ByteLevel" and spec["pre_tokenizer"]["use_regex"]
        if not usual or spec["pre_tokenizer"]["add_prefix_space"]:
            return None
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        vocabulary = spec["model"]["vocab"]
        if [vocabulary["".join(m)] for m in merges] != list(range(256, 256 + len(merges))):
            return None
        ranks = {bytes(alphabet[c] for c in t): i for t, i in vocabulary.items() if i < 256 + len(merges)}
        return tiktoken.Encoding("a", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode_a(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of space+stretch one after another, and how many each has."""
        plain = [k for k, s in enumerate(stretches) if s and " " not in s and s.isprintable() and max(s) < "\u0250"] if self.fast else []
        other = sorted(set(range(len(stretches))) - set(plain))
        counts = np.zeros(len(stretches), dtype=np.int64)
        got = [np.empty(0, np.int64)]
        for at in range(0, len(plain), 4096):
            # each begins with the only space it has, so ids that open with a space begin stretches
            got.append(np.array(self.fast(" " + " ".join([stretches[k] for k in plain[at:at + 4096]])), dtype=np.int64))
        ids = np.concatenate(got)
        counts[plain] = np.diff(np.flatnonzero(self.opens[ids]), append=len(ids))
        rest = [x.ids for x in self.a.encode_batch_fast([" " + stretches[k] for k in other], add_special_tokens=False)]
        counts[other] = list(map(len, rest))
        # put both in the order of the stretches
        parts = np.concatenate([ids, np.fromiter(chain.from_iterable(rest), np.int64)])
        order = np.concatenate([np.asarray(plain, dtype=np.int64), np.asarray(other, dtype=np.int64)])
        begin = np.empty(len(stretches), dtype=np.int64)
        begin[order] = np.cumsum(counts[order]) - counts[order]
        return parts[np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())], counts

    def aligned(self, stretches: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Ids of A and how many per stretch (without its leading space), the same of B: none where their bytes are not those of space+stretch."""
        a, n_a = self.encode_a(stretches)
        lists = self.b.encode(stretches, num_threads=1)
        n_b = np.fromiter(map(len, lists), np.int64, len(lists))
        b = np.fromiter(chain.from_iterable(lists), np.int64, n_b.sum())
        raw = [b" " + s.encode("utf-8", "surrogatepass") for s in stretches]
        size = np.fromiter(map(len, raw), np.int64, len(raw))
        good = np.ones(len(raw), dtype=bool)
        for ids, n, sizes, spelt in ((a, n_a, self.a_size, self.a_bytes), (b, n_b, self.b_size, self.b_bytes)):
            total = np.concatenate([[0], np.cumsum(sizes[ids])])
            ends = np.concatenate([[0], np.cumsum(n)])
            same = total[ends[1:]] - total[ends[:-1]] == size
            joined = b"".join(map(spelt.__getitem__, ids.tolist()))
            if not same.all() or joined != b"".join(raw):
                at = total[ends].tolist()
                same &= np.array([joined[i:j] == r for i, j, r in zip(at[:-1], at[1:], raw, strict=True)], dtype=bool)
            good &= same
        return a[np.repeat(good, n_a)], n_a * good, b[np.repeat(good, n_b)], n_b * good

    def learn(self, stretches: list[str]) -> dict:
        """Figures, links and group text of stretches."""
        a, n_a, b, n_b = self.aligned(stretches)
        many = len(stretches)
        # every stretch has the same bytes on both sides, so ends can run through
        a_ends, b_ends = np.cumsum(self.a_size[a]), np.cumsum(self.b_size[b])
        a_last, b_last = np.isin(a_ends, b_ends, assume_unique=True), np.isin(b_ends, a_ends, assume_unique=True)
        ends = np.union1d(a_ends, b_ends)
        at_a, at_b = np.searchsorted(a_ends, ends), np.searchsorted(b_ends, ends)
        of_a, of_b = np.repeat(np.arange(many), n_a), np.repeat(np.arange(many), n_b)
        links, groups = np.bincount(of_a[at_a], minlength=many), np.bincount(of_a[a_last], minlength=many)
        # ids of A of a group come before its ids of B
        group_a, group_b = np.cumsum(a_last) - a_last, np.cumsum(b_last) - b_last
        place_a = np.arange(len(a)) + np.searchsorted(group_b, group_a)
        place_b = np.arange(len(b)) + np.searchsorted(group_a, group_b, side="right")
        codes = np.empty(len(a) + len(b), dtype=np.int64)
        codes[place_a], codes[place_b] = a * 2 + a_last, 2 * len(self.a_bytes) + b * 2 + b_last
        of = np.empty(len(codes), dtype=np.int64)
        of[place_a], of[place_b] = of_a, of_b
        text = b"".join(map(self.written.__getitem__, codes.tolist()))
        # a stretch with space at an end, or none in between, makes its text be cut with more care
        loose = np.array([not s or s[0].isspace() or s[-1].isspace() for s in stretches], dtype=bool)
        bad = (n_a == 0) & np.array([bool(s) for s in stretches], dtype=bool)
        figures = np.stack([n_a, n_b, groups, links, loose, bad], axis=1)
        return {"figures": (np.full(many, 6), figures.ravel()), "links": (links, a[at_a] << PAIR_BITS | b[at_b]),
                "groups": (np.bincount(of, weights=self.width[codes], minlength=many).astype(np.int64), np.frombuffer(text, dtype=np.uint8))}


def pressed(values: np.ndarray) -> bytes:
    import zstandard
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(values).tobytes())


def opened(blob: bytes, dtype) -> np.ndarray:
    import zstandard
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=dtype)


def run_of(pairs: np.ndarray, counts: np.ndarray) -> list[tuple[int, bytes, bytes]]:
    """A run: cells (first A id, steps between pairs, counts) in the order of pairs."""
    cells = pairs >> PAIR_BITS + CELL.bit_length() - 1
    cut = np.concatenate([[0], np.flatnonzero(np.diff(cells)) + 1, [len(pairs)]]) if len(pairs) else [0]
    return [(int(cells[i]), pressed(np.diff(pairs[i:j], prepend=0)), pressed(counts[i:j].astype(np.uint32)))
            for i, j in zip(cut[:-1], cut[1:], strict=True)]


def merged(runs: Iterable[list[tuple[int, bytes, bytes]]]) -> Iterator[tuple[np.ndarray, np.ndarray, list[tuple[int, np.ndarray]]]]:
    """K-way heap merge by cell: the cell's distinct pairs, their counts over all runs, and per run in the cell its
    number and where its pairs are among them. One cell is held at a time."""
    numbered = ([(cell, k, pairs, counts) for cell, pairs, counts in run] for k, run in enumerate(runs))
    for _, cells in groupby(heapq.merge(*numbered, key=lambda c: c[:2]), key=lambda c: c[0]):
        held = [(k, np.cumsum(opened(p, np.int64)), opened(c, np.uint32)) for _, k, p, c in cells]
        pairs, at = np.unique(np.concatenate([p for _, p, _ in held]), return_inverse=True)
        counts = np.bincount(at, weights=np.concatenate([c for *_, c in held]), minlength=len(pairs)).astype(np.int64)
        yield pairs, counts, list(zip((k for k, *_ in held), np.split(at, np.cumsum([len(p) for _, p, _ in held])[:-1]), strict=True))


def radix(pairs: np.ndarray, counters: int) -> np.ndarray:
    mixed = common.mix((pairs >> PAIR_BITS << SPREAD | pairs & (1 << SPREAD) - 1).astype(np.uint64))
    return (mixed % np.uint64(counters)).astype(np.int64)


BLOB = "struct<cell:int,pairs:binary,counts:binary>"
FIGURES = ["n_a", "n_b", "n_groups", "n_links"]


class Reader:
    """Buffers of texts to figures, positions of pairs and runs."""

    def __init__(self, both: Both) -> None:
        self.known = Remembered(both.learn, {"figures": np.int32, "links": np.int64, "groups": np.uint8}, REMEMBERED)
        self.both = both

    def read(self, texts: list[str | None]) -> tuple:
        """Per text: figures and group bytes; and of all texts the links with the end of each text's."""
        cuts = [t.split(" ") if t else [] for t in texts]
        at, ends = self._find(cuts)
        # texts with other white space than single spaces between words are cut at those alone
        loose = np.add.reduceat(np.append(self._figures(at)[:, 4], 0), np.minimum(ends[:-1], len(at))) * (np.diff(ends) > 0)
        again = np.flatnonzero((loose > 0) & np.array([bool(t) for t in texts], dtype=bool))
        if len(again):
            for i in again.tolist():
                first, *rest = _CUT.split(texts[i])
                cuts[i] = [first, *(s[1:] for s in rest)]
            at, ends = self._find(cuts)
        figures = self._figures(at)
        sums = np.concatenate([np.zeros((1, 6), np.int64), np.cumsum(figures, axis=0)])
        sums = sums[ends[1:]] - sums[ends[:-1]]
        links, n_links = self.known.flat["links"].at(at)
        texts_, n_text = self.known.flat["groups"].at(at)
        raw, stops = texts_.tobytes(), np.concatenate([[0], np.cumsum(n_text)])[ends].tolist()
        groups = [raw[i:max(i, j - 1)] for i, j in zip(stops[:-1], stops[1:], strict=True)]
        link_ends = np.concatenate([[0], np.cumsum(n_links)])[ends]
        keep = np.ones(len(links), dtype=bool)
        for i in np.flatnonzero(sums[:, 5] > 0).tolist():  # some stretch differs, so the text does
            sums[i, :4], groups[i] = 0, b""
            keep[link_ends[i]:link_ends[i + 1]] = False
        kept = np.concatenate([[0], np.cumsum(keep)])
        return sums[:, :4], groups, links[keep], kept[link_ends]

    def _find(self, cuts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        at = self.known.find([s for c in cuts for s in c])
        return at, np.cumsum([0, *map(len, cuts)])

    def _figures(self, at: np.ndarray) -> np.ndarray:
        return self.known.flat["figures"].values.reshape(-1, 6)[at].astype(np.int64)


def _read(docs: DataFrame, tokenizer_path: str, model_path: str, counters: int, key: str, text: str, groups: bool) -> DataFrame:
    """Written table. ``kind`` 0: a buffer's documents, with the steps between positions of their distinct pairs and the links of
    each. ``kind`` 1: the distinct pairs of a task that go to one counter, as a run."""
    spark = docs.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f, open(model_path, "rb") as g:
        shared = spark.sparkContext.broadcast((f.read(), g.read()))
    kind = docs.schema[key].dataType.simpleString()
    names = ["kind", "counter", "run", "pairs", "positions", "links", "ends", "docs"]
    run_type = pa.list_(pa.struct([("cell", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())]))
    types = [pa.int32(), pa.int64(), run_type, *[pa.binary()] * 4]

    def row(*values) -> pa.RecordBatch:
        *plain, rows = values
        return pa.RecordBatch.from_arrays([*(pa.array([v], t) for v, t in zip(plain, types, strict=True)), rows], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        reader, spills, no_docs = None, [], None
        for batch in common.buffered(batches, "_text", BUFFER_BYTES):
            reader = reader or Reader(Both(*shared.value))
            figures, texts, links, ends = reader.read(batch.column("_text").to_pylist())
            pairs, at = np.unique(links, return_inverse=True)
            wide = max(len(pairs), 1)
            mine, times = np.unique(np.repeat(np.arange(len(ends) - 1), np.diff(ends)) * wide + at, return_counts=True)
            doc, place = mine // wide, mine % wide
            spills.append(run_of(pairs, np.bincount(place, minlength=len(pairs))))
            some = [t != b"" for t in texts]
            rows = pa.StructArray.from_arrays(
                [batch.column("_key"), *(pa.array(figures[:, k]) for k in range(4)),
                 pa.array([hashlib.sha256(t).hexdigest() if s else "" for t, s in zip(texts, some, strict=True)]),
                 pa.array([t.decode() if groups else None for t in texts], pa.string())], names=["_key", *FIGURES, "sha", "groups"])
            rows = pa.ListArray.from_arrays(pa.array([0, len(rows)], pa.int32()), rows)
            no_docs = pa.nulls(1, rows.type)
            stops = np.searchsorted(doc, np.arange(len(ends) - 1), side="right")
            steps = np.diff(place, prepend=0).astype(np.int32)
            yield row(0, None, None, pressed(pairs), pressed(steps), pressed(times.astype(np.uint32)), pressed(stops), rows)
        if spills:
            found = [(p, c) for p, c, _ in merged(spills)]
            pairs, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
            to = radix(pairs, counters)
            order = np.argsort(to, kind="stable")  # inside a counter the order of pairs stays
            stops = np.searchsorted(to[order], np.arange(counters + 1))
            for c, (i, j) in enumerate(zip(stops[:-1], stops[1:], strict=True)):
                if i < j:
                    cells = run_of(pairs[order[i:j]], counts[order[i:j]])
                    yield row(1, c, [dict(zip(("cell", "pairs", "counts"), x, strict=True)) for x in cells], None, None, None, None, no_docs)

    ddl = (f"kind int, counter long, run array<{BLOB}>, pairs binary, positions binary, links binary, ends binary, "
           f"docs array<struct<_key:{kind},{','.join(f'{c}:long' for c in FIGURES)},sha:string,groups:string>>")
    read = (docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text")).mapInArrow(run, ddl)
            .select("*", F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("buffer")))
    return materialise(read, "alignment")


def _counted(read: DataFrame) -> DataFrame:
    """Written table of all counters: task, and the counts of its pairs as a run, in the order of its own run."""
    def count(table: pa.Table) -> pa.Table:
        tasks = table.column("task").to_pylist()
        runs = [[(x["cell"], x["pairs"], x["counts"]) for x in run] for run in table.column("run").to_pylist()]
        back: list[list] = [[] for _ in runs]
        top_ids, tops = [], []
        for pairs, counts, places in merged(runs):
            a = pairs >> PAIR_BITS
            first = np.flatnonzero(np.diff(a, prepend=-1))  # pairs of an A id follow each other
            top_ids.append(a[first])
            tops.append(np.maximum.reduceat(counts, first))
            for k, at in places:
                back[k].append({"cell": int(a[0]) // CELL, "pairs": pressed(np.diff(pairs[at], prepend=0)), "counts": pressed(counts[at])})
        kind = pa.list_(pa.struct([("cell", pa.int32()), ("pairs", pa.binary()), ("counts", pa.binary())]))
        best = pa.array([[{"a": i, "top": t} for i, t in zip(np.concatenate(top_ids).tolist(), np.concatenate(tops).tolist(), strict=True)]]
                        + [None] * (len(runs) - 1), pa.list_(pa.struct([("a", pa.int64()), ("top", pa.int64())])))
        return pa.Table.from_arrays([pa.array(tasks, pa.int32()), pa.array(back, kind), best], ["task", "run", "best"])

    runs = read.where("kind = 1").select("counter", "task", "run")
    return materialise(runs.groupBy("counter").applyInArrow(count, f"task int, run array<{BLOB}>, best array<struct<a:long,top:long>>"), "counts")


def align(docs: DataFrame, tokenizer_path: str, model_path: str, key: str = "doc_id", text: str = "text", groups: bool = False) -> DataFrame:
    """``key``, n_a, n_b, n_groups, n_links, n_best, count_sum (long), groups_sha256 and, with ``groups``, ``groups``: the text of them."""
    spark = docs.sparkSession
    partitions = max(docs.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism)
    read = _read(docs, tokenizer_path, model_path, max(32, partitions // 4), key, text, groups)
    counted = _counted(read)
    tops = counted.select(F.explode("best").alias("b")).groupBy("b.a").agg(F.max("b.top").alias("top")).collect()  # at most the ids of A
    top = np.zeros(max((r.a for r in tops), default=0) + 1, dtype=np.int64)
    for r in tops:
        top[r.a] = r.top
    shared = spark.sparkContext.broadcast(top)
    kind = docs.schema[key].dataType.simpleString()

    def figures(left: pa.Table, right: pa.Table) -> pa.Table:
        """The documents of one task with the counts of its pairs."""
        found = [(p, c) for run in right.column("run").to_pylist()
                 for p, c in ((np.cumsum(opened(x["pairs"], np.int64)), opened(x["counts"], np.int64)) for x in run)]
        pairs, counts = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.empty(0, np.int64),) * 2
        order = np.argsort(pairs)
        pairs, counts = pairs[order], counts[order]
        best, out = counts == shared.value[pairs >> PAIR_BITS], []
        for k in range(left.num_rows):
            own, steps, times, stops = (opened(left.column(c)[k].as_py(), t) for c, t in
                                        (("pairs", np.int64), ("positions", np.int32), ("links", np.uint32), ("ends", np.int64)))
            at = np.searchsorted(pairs, own)[np.cumsum(steps.astype(np.int64))]
            rows = left.column("docs")[k].values
            sums = [np.concatenate([[0], np.cumsum(times * v[at])])[np.concatenate([[0], stops])] for v in (best, counts)]
            field = {n: rows.field(n) for n in ("_key", *FIGURES, "sha", "groups")}
            out.append(pa.RecordBatch.from_arrays([field["_key"], *(field[n] for n in FIGURES), *(pa.array(np.diff(s).astype(np.int64)) for s in sums), field["sha"], field["groups"]],
                                                  ["_key", *FIGURES, "n_best", "count_sum", "groups_sha256", "groups"]))
        return pa.Table.from_batches(out)

    buffers = read.where("kind = 0").select("task", "pairs", "positions", "links", "ends", "docs")
    done = buffers.groupBy("task").cogroup(counted.select("task", "run").groupBy("task")).applyInArrow(
        figures, f"_key {kind}, " + ", ".join(f"{c} long" for c in (*FIGURES, "n_best", "count_sum")) + ", groups_sha256 string, groups string")
    return done.withColumnRenamed("_key", key) if groups else done.withColumnRenamed("_key", key).drop("groups")
