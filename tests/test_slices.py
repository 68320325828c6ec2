"""Equi-depth slices: depth, order, and equal results on skewed keys."""

import random

import pytest
from pyspark.sql import functions as F

from bedside.functions import slices
from bedside.functions.ordered import Ordered, value_slice
from bedside.functions.quantiles import group_quantiles


@pytest.fixture
def shallow(spark):
    spark.conf.set(slices.ROWS_CONF, "60")
    yield spark
    spark.conf.unset(slices.ROWS_CONF)


def skewed(spark, n=3000):
    """A third of the rows is one key in one hour, half of these at one moment."""
    rng = random.Random(4)
    rows = []
    for i in range(n):
        if i % 3 == 0:
            t = 1_700_000_000_000_000 if i % 2 else 1_700_000_000_000_000 + rng.randrange(3_600_000_000)
            rows.append(("hot", i, t))
        else:
            rows.append((rng.choice(["a", "b", None]), i, rng.choice([None, 1_700_000_000_000_000 + rng.randrange(20 * 86_400_000_000)])))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, i long, us long")
    return df.select("k", "i", F.timestamp_micros("us").alias("ts"), (F.col("i") % 7).alias("x")).repartition(5)


def passes(df):
    o = Ordered(df, ["k"], ["ts", "i"])
    o.lag("p", "x").lag("p2", "x", 2).lead("n", "i").cumsum("s", "x").row_number("r").fill("f", F.when(F.col("x") == 3, F.col("i"))).total("t", "x").cummax("m", "x")
    return sorted(map(tuple, o.apply().collect()), key=repr)


def test_equal_results_on_a_skewed_key(shallow):
    df = skewed(shallow)
    cut = passes(df)
    shallow.conf.set(slices.ROWS_CONF, str(10**9))
    assert cut == passes(df)


def test_no_slice_is_deeper_than_the_target(shallow):
    df = skewed(shallow)
    o = Ordered(df, ["k"], ["ts", "i"]).row_number("r")
    out = o.apply(keep_slice=True)
    depth = out.groupBy(f"`{o.key}`", f"`{o.slice}`").count().agg(F.max("count")).first()[0]
    assert depth <= 60
    # slices are in the order of the rows
    spans = out.groupBy("k", F.col(f"`{o.slice}`").alias("s")).agg(F.min("r").alias("lo"), F.max("r").alias("hi")).orderBy("k", "lo").collect()
    by = {}
    for x in spans:
        by.setdefault(x.k, []).append(x)
    for rows in by.values():
        assert [r.s for r in rows] == sorted(r.s for r in rows) and all(a.hi < b.lo for a, b in zip(rows, rows[1:], strict=False))


def test_values_close_to_each_other_spread(shallow):
    rng = random.Random(8)
    rows = [("g", 1000 + i * 1e-7) for i in rng.sample(range(100_000), 2000)] + [("h", float(i)) for i in range(40)] + [(None, 5.0)] * 30
    df = shallow.createDataFrame(rows, "k string, v double")
    d = df.withColumn("key", F.struct("k")).withColumn("s", value_slice("v"))
    assert d.where("k = 'g'").select("s").distinct().count() <= 3
    cut = slices.equi_depth(d, "key", "s", [F.col("v")], 60)
    assert cut.groupBy("key", "s").count().agg(F.max("count")).first()[0] <= 60 and cut.count() == len(rows)
    probs = {"v": {"median": 0.5, "q1": 0.25, "p": 0.99}}
    fine = sorted(map(tuple, group_quantiles(df, ["k"], probs).collect()), key=repr)
    shallow.conf.set(slices.ROWS_CONF, str(10**9))
    assert fine == sorted(map(tuple, group_quantiles(df, ["k"], probs).collect()), key=repr)


def test_rows_that_cannot_be_told_apart_end(shallow):
    df = shallow.createDataFrame([("a", 1.0)] * 200, "k string, v double").withColumn("key", F.struct("k")).withColumn("s", F.lit(0).cast("long"))
    assert slices.equi_depth(df, "key", "s", [F.col("v")], 60).select("s").distinct().count() == 1
