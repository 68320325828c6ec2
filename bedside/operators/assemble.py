"""One row per encounter from the feature tables of many operators."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.functions.expr import union_all
from bedside.sources.tables import materialise

BLOCK = "encounter_block"
#: Feature tables that are written at a time, so that the last tasks of one leave no cores idle.
WRITERS = 6
#: Tables that are merged at once: the code that merges one more is run for every row, and beyond what the JVM compiles it is slow.
MERGED = 6


def together(spark: SparkSession, makers: dict[str, Callable]) -> dict:
    """What the makers give, by name. They run side by side: a step that is written first leaves cores idle with its last tasks
    and while the next is planned. Makers must not start ``together`` themselves."""
    def make(item):
        return item[0], item[1]()

    with ThreadPoolExecutor(WRITERS) as pool:
        return dict(pool.map(inheritable_thread_target(spark)(make), makers.items()))


def assemble(base: DataFrame, features: dict[str, DataFrame], required: list[str], key: str = BLOCK) -> DataFrame:
    """``base`` with the columns of every feature table, encounters without a row in one get nulls.

    Each table is written once as one struct per row. The union of a few is aggregated by the key: one
    shuffle and one sort, and a task holds one encounter at a time, where a chain of joins would sort every table and hold a
    buffer for each. More tables are merged in blocks, which are written and merged in the same way.
    A column of two tables, or one of ``required`` in none, is an error, and so is a key that a feature
    table has twice: it would double the encounter. A key that ``base`` has twice is left out."""
    names = list(base.columns)
    for name, f in features.items():
        twice = [c for c in f.columns if c != key and c in names]
        if twice:
            raise ValueError(f"{name} brings columns that are there already: {', '.join(twice)}")
        names += [c for c in f.columns if c != key]
    absent = [c for c in required if c not in names]
    if absent:
        raise ValueError(f"no feature has {', '.join(absent)}")
    tables = {"base": base, **features}
    spark = base.sparkSession

    def packed(f, name):
        return f.where(F.col(key).isNotNull()).select(key, F.struct(*[F.col(f"`{c}`") for c in f.columns if c != key]).alias(f"_{name}"))

    def merged(some):
        types = {n: f.schema[f"_{n}"].dataType for n, f in some.items()}
        rows = union_all([f.select(key, *[F.col(f"_{n}") if n == name else F.lit(None).cast(t).alias(f"_{n}") for n, t in types.items()])
                          for name, f in some.items()])
        # rows of a key hardly ever meet before the shuffle, so they are sorted behind it alone
        found = rows.repartition(F.col(key)).groupBy(key).agg(
            *[F.first(f"_{n}", True).alias(f"_{n}") for n in types], *[F.count(f"_{n}").alias(f"_n_{n}") for n in types])
        for n in types:
            if n == "base":
                found = found.withColumn("_base", F.when(F.col("_n_base") == 1, F.col("_base")))
                continue
            # a second row of a key fails the job
            found = found.where(F.when(F.col(f"_n_{n}") > 1, F.raise_error(F.lit(f"{n} has an encounter twice")).cast("boolean")).otherwise(F.lit(True)))
        return found.select(key, *[f"_{n}" for n in types])

    written = together(spark, {n: lambda n=n, f=f: materialise(packed(f, n), n) for n, f in tables.items()})
    blocks = [dict(list(written.items())[i:i + MERGED]) for i in range(0, len(written), MERGED)]
    if len(blocks) == 1:
        found, at = merged(written), {n: f"_{n}" for n in tables}
    else:
        name = {i: f"block_{i}" for i in range(len(blocks))}
        found = merged(together(spark, {name[i]: lambda i=i: materialise(packed(merged(blocks[i]), name[i]), name[i]) for i in name}))
        at = {n: f"_{name[i]}._{n}" for i, b in enumerate(blocks) for n in b}
    return found.where(F.col(at["base"]).isNotNull()).select(key, *[F.col(f"{at[n]}.`{c}`") for n, f in tables.items() for c in f.columns if c != key])
