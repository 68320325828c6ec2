"""N-gram Jaccard join by MinHash banding, with exact verification.

Words are those of the benchmark rule (A-Z lowered, runs of letters, digits and signs beyond ASCII), n-grams
five consecutive words; a text of fewer words, but not none, is one n-gram. Documents of the same
word sequence are one class before anything else, however many they are.

Bands and rows are chosen for a recall at the threshold; band hashes are shuffled, and classes that
share one are candidates. Pairs come from small buckets only. Larger buckets that share members are
joined to hot clusters, whose members are cut into blocks by hash; a task compares two blocks, so
no task holds a whole cluster and no pair of it becomes a row: a block pair returns link counts and
the components it sees. All candidates are decided on their full n-gram sets.

Links join classes of similarity >= threshold; a document's links also count the copies of its
own words. Its class is named by the least document id of the connected component. Null and empty
texts have no n-grams, no links and a class of their own. Rows of equal id and text are one
document to ``representatives``: they stay or go together. Null ids can't name a class unless alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.llm import common
from bedside.llm.components import components
from bedside.sources.tables import materialise

SIZE, THRESHOLD, RECALL, MOST_HASHES = 5, 0.8, 0.9999, 80
#: Buckets up to so many classes make pairs; blocks of larger ones hold about so many classes.
PAIR_BUCKET, BLOCK = 16, 256
BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def bands_and_rows(threshold: float, recall: float, most: int) -> tuple[int, int]:
    """The most rows for which ``most`` hashes reach the recall at the threshold, and so many bands."""
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-threshold ** rows)) if threshold ** rows < 1 else 1
        if bands * rows <= most:
            best = (bands, rows)
    return best


class Signer:
    """N-gram sets and band hashes of texts."""

    def __init__(self, size: int, bands: int, rows: int) -> None:
        self.size, self.bands, self.rows = size, bands, rows
        self.words, (self.one, self.two) = common.WordHashes(), map(common.Rolling, BASES)
        numbers = np.random.default_rng(20).integers(0, 1 << 63, (2, bands * rows), dtype=np.uint64)
        self.times, self.plus = numbers[0] * np.uint64(2) + np.uint64(1), numbers[1]
        self.weights = np.random.default_rng(21).integers(0, 1 << 63, (1, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def hashes(self, raw: bytes) -> np.ndarray:
        return self.words.of(common.folded_words(raw))

    def grams(self, hashes: np.ndarray) -> np.ndarray:
        return np.unique(self.one.runs(hashes, min(self.size, len(hashes)))) if len(hashes) else hashes

    def sign(self, grams: np.ndarray) -> np.ndarray:
        least = np.full(self.bands * self.rows, np.iinfo(np.uint64).max, dtype=np.uint64)
        with np.errstate(over="ignore"):
            for i in range(0, len(grams), 2048):
                np.minimum(least, (grams[i:i + 2048, None] * self.times + self.plus).min(axis=0), out=least)
            mixed = (common.mix(least.reshape(self.bands, self.rows)) * self.weights).sum(axis=1, dtype=np.uint64)
            return common.mix(mixed + np.arange(self.bands, dtype=np.uint64)).view(np.int64)

    def name(self, hashes: np.ndarray) -> tuple[int, int]:
        """Two hashes of the whole word sequence."""
        ends = (np.zeros(1, np.int64), np.full(1, len(hashes), np.int64))
        return tuple(int(r.spans(hashes, *ends).view(np.int64)[0]) for r in (self.one, self.two))


def _keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    return docs.select(F.col(key).alias("doc"), F.xxhash64(key, text).alias("row"), F.col(text).alias("text"))


def signatures(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc, row, c (struct of two hashes of the words; null without words), n (n-grams), bands."""
    kind = docs.schema["doc"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size, bands, rows)
        for batch in batches:
            names, counts, signs = [], [], []
            for text in batch.column("text").to_pylist():
                hashes = signer.hashes(common.is_null_or(text))
                grams = signer.grams(hashes)
                names.append(dict(zip("xy", signer.name(hashes), strict=True)) if len(hashes) else None)
                counts.append(len(grams))
                signs.append(signer.sign(grams) if len(grams) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc"), batch.column("row"), pa.array(names, pa.struct([("x", pa.int64()), ("y", pa.int64())])),
                 pa.array(counts, pa.int32()), pa.array(signs, pa.list_(pa.int64()))], ["doc", "row", "c", "n", "bands"])

    return docs.mapInArrow(run, f"doc {kind}, row long, c struct<x:long,y:long>, n int, bands array<long>")


def gram_sets(docs: DataFrame, wanted: DataFrame, size: int) -> DataFrame:
    """c and grams (sorted hashes) for the wanted rows (row, c)."""
    joined = docs.select("row", "text").join(wanted, "row").select("c", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer = Signer(size, 1, 1)
        for batch in batches:
            sets = [signer.grams(signer.hashes(common.is_null_or(t))).view(np.int64) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("c"), pa.array(sets, pa.list_(pa.int64()))], ["c", "grams"])

    return joined.mapInArrow(run, "c struct<x:long,y:long>, grams array<long>")


def overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the common parts of all sets of a and of b, over slices of their vocabulary."""
    words, at = np.unique(np.concatenate([*a, *b]), return_inverse=True)
    row = np.repeat(np.arange(len(a) + len(b)), [len(x) for x in (*a, *b)])
    order = np.argsort(at, kind="stable")
    at, row = at[order], row[order]
    common_, step = np.zeros((len(a), len(b))), 8192
    for first in range(0, len(words), step):
        lo, hi = np.searchsorted(at, [first, first + step])
        has = np.zeros((len(a) + len(b), step), dtype=np.float32)
        has[row[lo:hi], at[lo:hi] - first] = 1
        common_ += has[:len(a)] @ has[len(a):].T
    return common_


def compare_blocks(group: pd.DataFrame, threshold: float) -> pd.DataFrame:
    """Links between two blocks (or within one): per class, copies linked and the least class reached."""
    group = group.drop_duplicates(["x", "y"]).sort_values(["x", "y"], ignore_index=True)
    sides = [group[group.block == b].index.to_numpy() for b in dict.fromkeys((group.i[0], group.j[0]))]
    left, right = sides[0], sides[-1]
    empty = pd.DataFrame({"x": [], "y": [], "links": [], "rx": [], "ry": []}, dtype="int64")
    if not len(left) or not len(right):
        return empty
    grams = [np.asarray(g, dtype=np.int64) for g in group.grams]
    n = np.array([len(g) for g in grams])
    inter = overlaps([grams[k] for k in left], [grams[k] for k in right])
    linked = inter >= threshold * (n[left][:, None] + n[right][None, :] - inter) - 1e-9
    linked &= left[:, None] != right[None, :]
    copies = group.copies.to_numpy()
    links = np.zeros(len(group), dtype=np.int64)
    links[left] += linked @ copies[right]
    if len(sides) == 2:
        links[right] += linked.T @ copies[left]
    root = np.arange(len(group))  # rows are in order, so the least index is the least class
    a, b = left[np.nonzero(linked)[0]], right[np.nonzero(linked)[1]]
    while len(a):
        least = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, a, least)
        np.minimum.at(root, b, least)
        root = root[root]
        if (root == before).all():
            break
    some = np.flatnonzero(links > 0)
    xy = group[["x", "y"]].to_numpy()
    return pd.DataFrame({"x": xy[some, 0], "y": xy[some, 1], "links": links[some], "rx": xy[root[some], 0], "ry": xy[root[some], 1]})


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE, threshold: float = THRESHOLD,
            recall: float = RECALL, most_hashes: int = MOST_HASHES, pair_bucket: int = PAIR_BUCKET,
            block: int = BLOCK) -> DataFrame:
    """doc, row, class_id, n_links, n_copies and keeper (the row that may stand for its class) per document."""
    rows = _keyed(docs, key, text)
    bands, per_band = bands_and_rows(threshold, recall, most_hashes)
    signed = materialise(signatures(rows, size, bands, per_band), "signatures")
    one_of = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "row"))
    words = materialise(signed.where("c IS NOT NULL").groupBy("c").agg(
        one_of.alias("at"), F.min("doc").alias("least"), F.count(F.lit(1)).alias("copies"), F.min("n").alias("n"),
        F.min("bands").alias("bands")), "words")

    spread = words.select("c", "n", F.explode("bands").alias("bucket"))
    # written first: both sides of the joins are then plain scans, whose skewed keys Spark can split
    shared = materialise(spread.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"), F.min("c").alias("m"))
                         .where("size > 1"), "buckets")
    members = materialise(spread.join(shared, "bucket"), "members")

    # hot clusters: large buckets joined where they share members
    large = members.where(F.col("size") > pair_bucket)
    linked = components(large.select(F.col("c").alias("u"), F.col("m").alias("v")))
    hot = materialise(linked.select(F.col("u").alias("c"), F.col("root").alias("cluster"))
                      .unionByName(linked.select(F.col("root").alias("c"), F.col("root").alias("cluster")).distinct()), "hot")

    # candidate pairs of small buckets whose sizes allow the similarity, but for those inside one hot cluster
    small = members.where(F.col("size") <= pair_bucket).join(hot, "c", "left")
    x, y = (small.select("bucket", *[F.col(k).alias(k + s) for k in ("c", "n", "cluster")]) for s in ("a", "b"))
    pairs = (x.join(y, "bucket").where("ca < cb AND NOT (clustera <=> clusterb AND clustera IS NOT NULL)")
             .where((F.least("na", "nb") >= threshold * F.greatest("na", "nb") - 1e-9)).select("ca", "cb").distinct())
    pairs = materialise(pairs, "pairs")
    needed = (pairs.select(F.col("ca").alias("c")).unionByName(pairs.select(F.col("cb").alias("c")))
              .unionByName(hot.select("c")).distinct())
    wanted = words.join(needed, "c", "left_semi").select(F.col("at.row").alias("row"), "c")
    sets = materialise(gram_sets(rows, wanted, size), "sets")

    inter = F.size(F.array_intersect("ga", "gb"))
    links = (pairs.join(sets.select(F.col("c").alias("ca"), F.col("grams").alias("ga")), "ca")
             .join(sets.select(F.col("c").alias("cb"), F.col("grams").alias("gb")), "cb")
             .where(inter >= threshold * (F.size("ga") + F.size("gb") - inter) - 1e-9).select("ca", "cb").distinct())
    links = materialise(links, "links")

    # block pairs of hot clusters
    blocks = hot.groupBy("cluster").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    dealt = (hot.join(blocks, "cluster").withColumn("block", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int"))
             .join(words.select("c", "copies"), "c").join(sets, "c")
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
             .select(F.col("cluster.x").alias("kx"), F.col("cluster.y").alias("ky"), F.least("block", "other").alias("i"),
                     F.greatest("block", "other").alias("j"), "block", F.col("c.x").alias("x"), F.col("c.y").alias("y"),
                     "copies", "grams"))
    met = materialise(dealt.groupBy("kx", "ky", "i", "j").applyInPandas(
        lambda group: compare_blocks(group, threshold), "x long, y long, links long, rx long, ry long"), "met")
    met = met.select(F.struct("x", "y").alias("c"), "links", F.struct(F.col("rx").alias("x"), F.col("ry").alias("y")).alias("root"))

    own = words.select("c", "copies")
    ends = links.unionByName(links.select(F.col("cb").alias("ca"), F.col("ca").alias("cb")))
    counts = (ends.join(own.withColumnRenamed("c", "cb"), "cb").select(F.col("ca").alias("c"), F.col("copies").alias("links"))
              .unionByName(met.select("c", "links")).groupBy("c").agg(F.sum("links").alias("links")))
    roots = components(links.select(F.col("ca").alias("u"), F.col("cb").alias("v"))
                       .unionByName(met.select(F.col("c").alias("u"), F.col("root").alias("v"))))
    named = words.join(roots.withColumnRenamed("u", "c"), "c", "left").withColumn("root", F.coalesce("root", "c"))
    names = named.groupBy("root").agg(F.min("least").alias("class_id"), F.min("at").alias("keeper"))
    info = (named.select("c", "root", "copies").join(names, "root").join(counts, "c", "left")
            .select("c", "class_id", "keeper", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    return (signed.select("doc", "row", "c").join(materialise(info, "info"), "c", "left")
            .select("doc", "row", F.when(F.col("c").isNull(), F.col("doc")).otherwise(F.col("class_id")).alias("class_id"),
                    F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    (F.coalesce("copies", F.lit(1)) - 1).cast("long").alias("n_copies"),
                    (F.col("c").isNull() | (F.col("keeper.doc").eqNullSafe(F.col("doc")) & (F.col("keeper.row") == F.col("row"))))
                    .alias("keeper")))


def join(docs: DataFrame) -> DataFrame:
    return classes(docs).select(F.col("doc").alias("doc_id"), "class_id", "n_links", "n_copies")


def representatives(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class, with its columns."""
    kept = classes(docs, key, text).where("keeper").select(F.col("doc").alias("_doc"), F.col("row").alias("_hash")).distinct()
    kept = kept.withColumn("_doc", F.struct("_doc"))  # a null id equals itself inside a struct
    rows = docs.select(F.struct("*").alias("_all"), F.struct(F.col(key).alias("_doc")).alias("_doc"), F.xxhash64(key, text).alias("_hash"))
    return rows.join(kept, ["_doc", "_hash"], "left_semi").select("_all.*")
