"""Column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: two-sided 95 % point of the standard normal distribution.
Z95 = 1.959963984540054


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def norm(c) -> Column:
    """Lower-cased and trimmed category text."""
    return F.lower(F.trim(as_col(c)))


def micros(c) -> Column:
    return F.unix_micros(as_col(c))


def seconds_between(start, end) -> Column:
    """Elapsed seconds from ``start`` to ``end`` as a double."""
    return (micros(end) - micros(start)) / F.lit(1e6)


def hours_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(3.6e9)


def days_between(start, end) -> Column:
    return (micros(end) - micros(start)) / F.lit(8.64e10)


def flag(cond: Column) -> Column:
    """Condition as 0/1; unknown counts as 0."""
    return F.coalesce(cond.cast("int"), F.lit(0))


def any_flag(cond: Column) -> Column:
    """Aggregate: 1 when any row of the group meets the condition."""
    return F.max(flag(cond))


def count_when(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def pct(part: Column, whole: Column) -> Column:
    """Percentage; null when the whole is zero."""
    return F.when(whole != 0, part * F.lit(100.0) / whole)


def lookup(c, table: dict, default=None) -> Column:
    """Value of a short fixed table for a column."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), as_col(c))
    return found if default is None else F.coalesce(found, F.lit(default))


def wilson(events: Column, n: Column, z: float = Z95) -> tuple[Column, Column, Column]:
    """Centre, lower and upper bound of the Wilson score interval (0..1)."""
    p, z2 = events / n, z * z
    denom = 1 + F.lit(z2) / n
    centre = (p + F.lit(z2) / (2 * n)) / denom
    half = F.lit(z) * F.sqrt((p * (1 - p) + F.lit(z2) / (4 * n)) / n) / denom
    return centre, F.greatest(centre - half, F.lit(0.0)), F.least(centre + half, F.lit(1.0))


def entropy_bits(counts: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """Shannon entropy of counts per key, three decimals, from sums only:
    H = log2(N) - sum(n * log2(n)) / N."""
    total = F.sum(n)
    return counts.groupBy(*keys).agg(
        F.round(F.log2(total) - F.sum(F.col(n) * F.log2(n)) / total, 3).alias("entropy"))


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def top_k(df: DataFrame, k: int, by: list[Column], keys: list[str] | None = None) -> DataFrame:
    """The k first rows (per key). Rows are few by construction: call it on counts."""
    if not keys:
        return df.orderBy(*by).limit(k)
    w = Window.partitionBy(*keys).orderBy(*by)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") <= k).drop("_rk")


def first_by(df: DataFrame, keys: list[str], order: list[str], cols: list[str] | None = None,
             last: bool = False) -> DataFrame:
    """Whole first (or last) row per key as an aggregate, so partial results combine
    before the shuffle."""
    cols = [c for c in (cols or df.columns) if c not in keys]
    pick = F.max_by if last else F.min_by
    return (df.groupBy(*keys)
            .agg(pick(F.struct(*cols), F.struct(*order)).alias("_r"))
            .select(*keys, "_r.*"))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Columns of a one-row result (totals, limits) on every row, as one scalar subquery;
    null when that result is empty."""
    one = one_row.select(F.struct(*[F.col(c) for c in one_row.columns]).alias("_one"))
    return df.withColumn("_one", one.scalar()).select(*[F.col(c) for c in df.columns], "_one.*")
