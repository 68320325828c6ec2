"""Exact grouped quantiles without gathering a group in one task.

Values are counted per (group, slice, value) with map-side combine; the slice
totals say which slice holds each wanted rank; only those slices are ranked.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bedside.functions import slices
from bedside.functions.expr import attach
from bedside.functions.ordered import value_slice
from bedside.sources.tables import materialise

QUARTILES = {"median": 0.5, "q1": 0.25, "q3": 0.75}


def _rank(n, p, interpolation):
    h = (n - 1) * F.lit(float(p))
    return F.bround(h, 0) if interpolation == "nearest" else h


def group_quantiles(df: DataFrame, keys: list[str], probs: dict[str, dict[str, float]],
                    interpolation: str = "linear") -> DataFrame:
    """One row per group with ``{column: {output name: probability}}`` quantiles.

    ``linear`` interpolates between neighbours; ``nearest`` takes the row at
    ``round(p * (n - 1))``, half to even. Nulls and NaN do not count.
    """
    out = _by_struct(df, list(keys), probs, interpolation)
    return out.select("_group.*", *out.columns[1:]) if keys else out.drop("_group")


def _by_struct(df, keys, probs, interpolation):
    """Quantiles keyed by one struct ``_group``: null group values compare equal inside a
    struct, so plain equality works and partitionings carry over."""
    cols, part = list(probs), ["_group", "_m"]
    pairs = (
        df.select(_key(keys), F.explode(F.array(*[
            F.struct(F.lit(i).alias("_m"), F.col(c).cast("double").alias("_v"))
            for i, c in enumerate(cols)])).alias("_e"))
        .select("_group", "_e._m", "_e._v")
        .where(F.col("_v").isNotNull() & ~F.isnan("_v"))
        .withColumn("_slice", value_slice("_v"))
        .groupBy(*part, "_slice", "_v").agg(F.count(F.lit(1)).alias("_c"))
    )
    target = slices.target_rows(df)
    if slices.may_exceed(df, target):
        # many distinct values within a slice's width: cut it at their quantiles
        pairs = materialise(pairs.withColumn("_line", F.struct(*part)), "counted")
        pairs = slices.equi_depth(pairs, "_line", "_slice", [F.col("_v")], target).drop("_line")
    ws = Window.partitionBy(*part)
    wo = ws.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    ranks = sorted({p for d in probs.values() for p in d.values()})
    n, lo_hi = F.col("_n"), {}
    for p in ranks:
        h = _rank(n, p, interpolation)
        lo_hi[p] = (F.floor(h), F.ceil(h))
    seg = (
        pairs.groupBy(*part, "_slice").agg(F.sum("_c").alias("_sc"))
        .withColumn("_b", F.coalesce(F.sum("_sc").over(wo), F.lit(0)))
        .withColumn("_n", F.sum("_sc").over(ws))
    )
    hit = F.lit(False)
    for lo, hi in lo_hi.values():
        hit = hit | ((F.col("_b") <= hi) & (lo < F.col("_b") + F.col("_sc")))
    seg = seg.where(hit).drop("_sc")
    ranked = (
        pairs.join(seg, [*part, "_slice"])
        .withColumn("_hi", F.col("_b") + F.sum("_c").over(
            Window.partitionBy(*part, "_slice").orderBy("_v")))
        .withColumn("_lo", F.col("_hi") - F.col("_c"))
    )
    aggs, outs = [], []
    for i, c in enumerate(cols):
        mine = F.col("_m") == i
        aggs.append(F.max(F.when(mine, n)).alias(f"_n{i}"))
        for name, p in probs[c].items():
            for tag, r in zip("lh", lo_hi[p]):
                aggs.append(F.max(F.when(mine & (F.col("_lo") <= r) & (r < F.col("_hi")),
                                         F.col("_v"))).alias(f"_{tag}_{i}_{name}"))
            h = _rank(F.col(f"_n{i}"), p, interpolation)
            a, b = F.col(f"_l_{i}_{name}"), F.col(f"_h_{i}_{name}")
            outs.append((a + (b - a) * (h - F.floor(h))).alias(name))
    return ranked.groupBy("_group").agg(*aggs).select("_group", *outs)


def _key(keys):
    return F.struct(*[F.col(k) for k in keys] or [F.lit(0).alias("_all")]).alias("_group")


def with_quantiles(df: DataFrame, keys: list[str], aggs: list, probs: dict,
                   interpolation: str = "linear") -> DataFrame:
    """Ordinary aggregates and exact quantiles of the same groups side by side."""
    q = _by_struct(df, keys, probs, interpolation)
    if not keys:
        return attach(df.agg(*aggs), q.drop("_group"))
    out = df.withColumn("_group", _key(keys)).groupBy("_group").agg(*aggs).join(q, "_group", "left")
    return out.select("_group.*", *out.columns[1:])
