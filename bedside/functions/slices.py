"""Slices of about equal depth for ordered work on skewed keys.

A slice that holds more rows than the target is cut at the quantiles of its order column, taken from
one mergeable sketch per slice; a value that many rows share becomes a slice of its own and is cut by the
next order column, the tie breaker. Cuts are written before they are used, so every
branch of a plan and every recomputation sees the same ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.sources.tables import materialise

#: Rows a slice should hold at most, and the setting that changes it.
ROWS, ROWS_CONF = 2_000_000, "spark.bedside.slice.rows"
#: Rows of a key that are ordered in one task without cutting it, and the hash buckets in which keys are counted.
KEY_ROWS, BUCKETS = 250_000, 1 << 16
#: Parts that a slice is cut in, how exact the sketch is, and how often parts are cut again.
PARTS, ACCURACY, ROUNDS = 64, 2000, 6


def target_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(ROWS_CONF, str(ROWS)))


def may_exceed(df: DataFrame, target: int) -> bool:
    """Whether the input's sources are large enough for more rows than the target, by the sizes Spark knows of
    them: a row of a key and an order value takes two bytes at the least."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())) > 2 * target


def shallow(df: DataFrame, keys: list[str]) -> bool:
    """Whether no key has more than ``KEY_ROWS`` rows (nor more than the target of a slice). Rows are counted per hash bucket of the keys,
    which is at least the count of any key in it: a task sends no more rows than there are buckets, however many keys there are."""
    most = min(target_rows(df), KEY_ROWS)
    if not may_exceed(df, most):
        return True
    bucket = F.pmod(F.xxhash64(F.lit(0), *[F.col(f"`{k}`") for k in keys]), F.lit(BUCKETS))
    rows = df.groupBy(bucket.alias("_bucket")).agg(F.count(F.lit(1)).alias("_rows")).agg(F.max("_rows")).first()[0]
    return rows is None or rows <= most


def coordinates(df: DataFrame, order: list[str]) -> list[Column]:
    """Order columns as numbers, as far as they are numbers or times."""
    out = []
    for name in order:
        kind = dict(df.dtypes).get(name, "")
        if kind.startswith("timestamp"):
            out.append(F.unix_micros(F.col(f"`{name}`").cast("timestamp")).cast("double"))
        elif kind == "date":
            out.append(F.unix_date(f"`{name}`").cast("double"))
        elif kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
            out.append(F.col(f"`{name}`").cast("double"))
        else:
            break  # later columns only order rows that are equal in this one
    return out


def equi_depth(df: DataFrame, key: str, name: str, coords: list[Column], target: int) -> DataFrame:
    """``df`` whose slice column ``name`` is an array: the slice, then the parts of it. Inside a key arrays are in the order of
    the coordinates. Rows equal in all coordinates cannot be told apart and stay together."""
    df = df.withColumn(name, F.array(name))
    key, name_ = f"`{key}`", f"`{name}`"
    for _ in range(ROUNDS):
        ends = [f(c).alias(f"_{e}{i}") for i, c in enumerate(coords) for e, f in (("lo", F.min), ("hi", F.max))]
        heavy = df.groupBy(F.col(key).alias("_hk"), F.col(name_).alias("_hs")).agg(F.count(F.lit(1)).alias("_rows"), *ends)
        which = F.coalesce(*[F.when(F.col(f"_lo{i}") < F.col(f"_hi{i}"), F.lit(i)) for i in range(len(coords))])
        heavy = materialise(heavy.where(F.col("_rows") > target).select("_hk", "_hs", which.alias("_which")).where("_which is not null"), "heavy")
        if heavy.isEmpty():
            break
        value = F.lit(None).cast("double")
        for i, c in enumerate(coords):
            value = F.when(F.col("_which") == i, c).otherwise(value)
        here = (F.col(key) == F.col("_hk")) & (F.col(name_) == F.col("_hs"))
        rows = df.join(heavy, here).select("_hk", "_hs", "_which", value.alias("_at"))
        cuts = rows.groupBy("_hk", "_hs", "_which").agg(F.array_sort(F.array_distinct(F.percentile_approx(
            "_at", [i / PARTS for i in range(1, PARTS)], ACCURACY))).alias("_cuts"))
        cuts = materialise(cuts, "cuts")
        below = F.size(F.filter("_cuts", lambda x: x < F.col("_at"))) * 2 + F.array_contains("_cuts", F.col("_at")).cast("int")
        columns = [F.col(f"`{c}`") for c in df.columns if c != name]
        part = F.when(F.col("_cuts").isNull(), F.col(name_)).otherwise(F.concat(F.col(name_), F.array(below.cast("long"))))
        df = df.join(cuts, here, "left").withColumn("_at", value).select(*columns, part.alias(name))
    return df
