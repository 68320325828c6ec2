"""Approximate nearest neighbours on robust-pruned directed graphs, one per shard.

Equal vectors are one node, however many rows hold them; a node keeps its least ids, as many as
an answer can need. Nodes are dealt to shards of bounded size by a hash, a task builds the graph of
one shard, and the graphs are written as a table (vectors, edges, entry point per shard).

Building inserts nodes in batches: a greedy beam search from the entry point proposes neighbours, and
robust pruning keeps an edge to the nearest proposal and drops the proposals that lie closer,
by a factor ``alpha``, to it than to the node, until ``degree`` edges are kept; edges are added in
both directions and pruned again where a node has too many. A second pass repeats this with the
finished graph. Largest inner products become smallest distances by one more coordinate that gives
all vectors of a shard equal length.

Queries are packed in blocks; every block meets every shard as an equal join on the shard number,
each query walks the graph by beam search, and what the walk has found is scored in double precision on
the original vectors. The best of all shards are the answer.

Vectors that are null, zero, of another length than most, or hold null or non-finite components
take no part. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedside.sources.tables import materialise

DEGREE, BEAM, SEARCH_BEAM, ALPHA, SHARD_ROWS, QUERY_BLOCK = 32, 96, 160, 1.2, 4096, 512


def usable(vector: Column) -> Column:
    """No null, NaN or infinite component, and one that isn't zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


def nodes(df: DataFrame, key: str, vector: str, ids_kept: int) -> DataFrame:
    """v and ids: distinct usable vectors and the least ``ids_kept`` ids of each, rising."""
    rows = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v")).where(
        usable(F.col("v")) & F.col("id").isNotNull())
    # -0.0 and 0.0 are one value
    rows = rows.withColumn("v", F.transform("v", lambda x: x + F.lit(0.0).cast("float")))
    top = Window.partitionBy("v").orderBy("id")  # a limit on the rank is applied before the shuffle, too
    return (rows.distinct().withColumn("r", F.row_number().over(top)).where(F.col("r") <= ids_kept)
            .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")))


class Graph:
    """Vectors (with the levelling coordinate), edges and entry point of a shard."""

    def __init__(self, x: np.ndarray, edges: np.ndarray, entry: int) -> None:
        self.x, self.edges, self.entry = x, edges, entry

    def walk(self, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Beam search of all queries at once: the nearest nodes found (-1: none) and their distances."""
        n, q = len(self.x), len(queries)
        beam = min(beam, n)
        near = np.full((q, beam), -1, dtype=np.int64)
        far = np.full((q, beam), np.inf, dtype=np.float32)
        done = np.ones((q, beam), dtype=bool)
        seen = np.zeros((q, n), dtype=bool)
        near[:, 0] = self.entry
        far[:, 0] = ((queries - self.x[self.entry]) ** 2).sum(axis=1)
        done[:, 0], seen[:, self.entry] = False, True
        rows = np.arange(q)
        while True:
            best = np.where(done, np.inf, far)
            at = best.argmin(axis=1)
            live = np.flatnonzero(np.isfinite(best[rows, at]))
            if not len(live):
                return near, far
            at = at[live]
            done[live, at] = True
            step = self.edges[near[live, at]]
            fresh = (step >= 0) & ~seen[live[:, None], step]
            r, c = np.nonzero(fresh)
            seen[live[r], step[r, c]] = True
            distance = np.full(step.shape, np.inf, dtype=np.float32)
            difference = self.x[step[r, c]] - queries[live[r]]
            distance[r, c] = np.einsum("ij,ij->i", difference, difference)
            ids = np.concatenate([near[live], np.where(fresh, step, -1)], axis=1)
            distances = np.concatenate([far[live], distance], axis=1)
            old = np.concatenate([done[live], ~fresh], axis=1)
            order = np.argpartition(distances, beam - 1, axis=1)[:, :beam] if distances.shape[1] > beam else None
            if order is None:
                order = np.argsort(distances, axis=1)[:, :beam]
            near[live], far[live], done[live] = (np.take_along_axis(z, order, axis=1) for z in (ids, distances, old))


def prune(x: np.ndarray, node: int, proposals: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Nearest proposals that no kept one is ``alpha`` times closer to than the node is."""
    proposals = np.unique(proposals[(proposals >= 0) & (proposals != node)])
    if not len(proposals):
        return proposals
    # seen from the node, so that tiny distances inside a dense group keep their digits
    points = (x[proposals] - x[node]).astype(np.float64)
    own = (points ** 2).sum(axis=1)
    order = np.argsort(own, kind="stable")
    proposals, own, points = proposals[order], own[order], points[order]
    between = np.maximum(own[:, None] + own[None, :] - 2 * points @ points.T, 0)
    left, kept = np.ones(len(proposals), dtype=bool), []
    for i in range(len(proposals)):
        if left[i]:
            kept.append(i)
            if len(kept) == degree:
                break
            left &= alpha ** 2 * between[i] > own
    return proposals[kept]


def build(vectors: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 5) -> Graph:
    """The graph of one shard."""
    length = (vectors.astype(np.float64) ** 2).sum(axis=1)
    x = np.concatenate([vectors, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], axis=1).astype(np.float32)
    n = len(x)
    edges = np.full((n, degree), -1, dtype=np.int64)
    entry = int(((x - x.mean(axis=0)) ** 2).sum(axis=1).argmin())
    graph = Graph(x, edges, entry)
    order = np.random.default_rng(seed).permutation(n)
    batch_of = lambda i: min(256, max(8, i // 4))  # noqa: E731  small batches while the graph is small
    for round_alpha in (1.0, alpha):
        i = 0
        while i < n:
            batch = order[i:i + batch_of(i if round_alpha == 1.0 else n)]
            i += len(batch)
            found, _ = graph.walk(x[batch], beam)
            back: dict[int, list[int]] = {}
            for node, near in zip(batch.tolist(), found, strict=True):
                # the batch itself is proposed while the graph is too small to know it
                more = batch if i <= 64 else edges[node]
                kept = prune(x, node, np.concatenate([near, edges[node], more]), degree, round_alpha)
                edges[node] = -1
                edges[node, :len(kept)] = kept
                for other in kept.tolist():
                    back.setdefault(other, []).append(node)
            for other, new in back.items():
                has = edges[other][edges[other] >= 0]
                both = np.union1d(has, new)
                if len(both) > degree:
                    both = prune(x, other, both, degree, round_alpha)
                edges[other] = -1
                edges[other, :len(both)] = both
    return graph


def index(table: DataFrame, shard_rows: int = SHARD_ROWS, **options) -> DataFrame:
    """shard, entry, dimension and the vectors, edges and ids of a shard as bytes; from v and ids."""
    table = table.withColumn("size", F.size("v"))
    most = table.groupBy("size").count().orderBy(F.desc("count"), "size").first()
    if most is None:
        most = (0, 0)
    shards = max(1, -(-most[1] // shard_rows))
    table = table.where(F.col("size") == most[0]).withColumn("shard", F.pmod(F.xxhash64("v"), F.lit(shards)).cast("int"))

    def make(group: pd.DataFrame) -> pd.DataFrame:
        group = group.assign(first=[x[0] for x in group.ids]).sort_values("first")
        vectors = np.stack(group.v.to_numpy()).astype(np.float32)
        graph = build(vectors, **options)
        counts = np.array([len(x) for x in group.ids], dtype=np.int32)
        return pd.DataFrame({"shard": [group.shard.iloc[0]], "entry": [graph.entry], "vectors": [vectors.tobytes()],
                             "edges": [graph.edges.astype(np.int32).tobytes()], "counts": [counts.tobytes()],
                             "ids": [np.concatenate([np.asarray(x, np.int64) for x in group.ids]).tobytes()]})

    # as many partitions as shards: small tables don't end in one task
    return table.select("shard", "v", "ids").repartition(shards, "shard").groupBy("shard").applyInPandas(
        make, "shard int, entry int, vectors binary, edges binary, counts binary, ids binary")


def search(queries: DataFrame, graphs: DataFrame, k: int, beam: int = SEARCH_BEAM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: nearest ``k`` of all shards for queries (id, v), never the query's own id."""
    total = queries.count()
    blocks = max(1, -(-total // block))
    shards = graphs.select("shard")
    packed = (queries.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
              .groupBy("block").agg(F.collect_list(F.struct("id", "v")).alias("queries")))
    count = (shards.agg(F.max("shard").alias("m")).first()["m"] or 0) + 1
    # every block for every shard: a stated query set in blocks, joined on the shard number
    asked = packed.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumn("shard", F.col("shard").cast("int"))
    met = asked.join(graphs, "shard").repartition(max(1, min(blocks * count, 4096)), "shard", "block")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples():
                ids = np.array([q["id"] for q in row.queries], dtype=np.int64)
                asks = np.array([q["v"] for q in row.queries], dtype=np.float32)
                counts = np.frombuffer(row.counts, np.int32)
                vectors = np.frombuffer(row.vectors, np.float32).reshape(len(counts), -1)
                if vectors.shape[1] != asks.shape[1]:
                    continue
                length = (vectors.astype(np.float64) ** 2).sum(axis=1)
                x = np.concatenate([vectors, np.sqrt(np.maximum(length.max() - length, 0))[:, None]], axis=1).astype(np.float32)
                graph = Graph(x, np.frombuffer(row.edges, np.int32).reshape(len(counts), -1).astype(np.int64), row.entry)
                near, _ = graph.walk(np.concatenate([asks, np.zeros((len(asks), 1), np.float32)], axis=1), max(beam, 2 * k))
                members = np.split(np.frombuffer(row.ids, np.int64), np.cumsum(counts)[:-1])
                out = []
                for q, ask, found in zip(ids, asks.astype(np.float64), near, strict=True):
                    found = found[found >= 0]
                    scores = vectors[found].astype(np.float64) @ ask
                    mine = [(-s, m) for s, f in zip(scores.tolist(), found, strict=True) for m in members[f].tolist() if m != q]
                    out += [(q, m, -s) for s, m in sorted(mine)[:k]]
                yield pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype(
                    {"query_id": "int64", "vec_id": "int64", "score": "float64"})

    found = met.select("shard", "queries", "entry", "vectors", "edges", "counts", "ids").mapInPandas(
        run, "query_id long, vec_id long, score double").distinct()
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 20, k: int = 20) -> DataFrame:
    """The ``k`` nearest rows for each row whose key is divisible by ``every``."""
    graphs = materialise(index(materialise(nodes(df, key, vector, k + 1), "nodes")), "graphs")
    asks = (df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))
            .where((F.col("id") % every == 0) & usable(F.col("v"))).groupBy("id").agg(F.min("v").alias("v")))
    return search(asks, graphs, k)
