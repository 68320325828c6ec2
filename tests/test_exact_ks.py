"""Exact p-values of the two-sample Kolmogorov-Smirnov test at sizes where a switch once gave the large-sample form."""

import math
import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bedside.operators import dist


def outside(n1, n2, edge):
    """Share of the lattice paths that leave the band, in whole numbers; only the cells inside are visited."""
    ways, first = [1], 0
    for i in range(n1 + 1):
        lo, hi = max((i * n2 - edge) // n1 + 1, 0), min((i * n2 + edge - 1) // n1, n2)
        before, s, row = dict(enumerate(ways, first)), 0, []
        for j in range(lo, hi + 1):
            s = s + before.get(j, 0) if i or j else 1
            row.append(s if i else 1)
        ways, first = row, lo
    return float(1 - Fraction(ways[-1], math.comb(n1 + n2, n1)))


def alike(n, h):
    """The same share for two samples of n by reflection."""
    return float(Fraction(2 * sum((-1) ** (k - 1) * math.comb(2 * n, n - k * h) for k in range(1, n // h + 1)), math.comb(2 * n, n)))


def exact(spark, rows):
    df = spark.createDataFrame([(n, a, b, e / (a * b)) for n, (a, b, e) in enumerate(rows)], "n int, n1 long, n2 long, statistic double")
    return [r.p for r in df.coalesce(1).select("n", dist.ks_exact(F.col("n1"), F.col("n2"), F.col("statistic")).alias("p")).orderBy("n").collect()]


def test_query_beyond_a_million_cells(spark, tmp_path):
    rng = random.Random(4)
    n1, n2 = 1100, 1000
    x, y = [rng.random() for _ in range(n1)], [rng.random() + 0.01 for _ in range(n2)]
    rows = [(3, "BUILDING", v) for v in x] + [(3, "MACHINERY", v) for v in y] + [(4, "BUILDING", 5.0), (3, "FURNITURE", 6.0), (3, "BUILDING", None)]
    spark.createDataFrame(rows, "c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    c = edge = 0
    for _, d in sorted([(v, n2) for v in x] + [(v, -n1) for v in y]):
        c += d
        edge = max(edge, abs(c))
    want = outside(n1, n2, edge)
    r = entry.queries()["k18_ks_exact"](spark, str(tmp_path)).first()
    assert (r.n1, r.n2, r.statistic) == (n1, n2, round(edge / (n1 * n2), 8))
    assert r.p_value == pytest.approx(want, abs=5.1e-7)
    make = lambda s: spark.createDataFrame([(v,) for v in s], "v double")
    a, b = make(x), make(y)
    assert dist.ks_test(a, b, "v", exact_cells=None).first().p_value == pytest.approx(want, rel=1e-11)
    assert dist.ks_test(b, a, "v", exact_cells=None).first().p_value == pytest.approx(want, rel=1e-11)
    assert abs(dist.ks_test(a, b, "v").first().p_value - want) > 1e-4  # what the switch gave
    assert dist.ks_test(a, b.limit(0), "v", exact_cells=None).first().p_value is None
    assert dist.ks_test(a, a, "v", exact_cells=None).first().p_value == 1.0


def test_all_gaps_of_small_samples(spark):
    rows = [(a, b, e) for a in range(1, 6) for b in range(1, 6) for e in range(a * b + 1)]
    for row, got in zip(rows, exact(spark, rows), strict=True):
        assert got == pytest.approx(outside(*row) if row[2] else 1.0, abs=1e-13), row


def test_sizes_apart_and_small_shares(spark):
    rows = [(1, 5000, 4900), (5000, 1, 4900), (30, 1500, 12000), (997, 1003, 60000), (400, 600, 240000), (400, 600, 180000), (1500, 1500, 1)]
    for row, got in zip(rows, exact(spark, rows), strict=True):
        assert got == pytest.approx(outside(*row), rel=1e-10), row
    hs = [1, 40, 100, 400, 1000, 1480, 1600, 2500]
    for h, got in zip(hs, exact(spark, [(2500, 2500, 2500 * h) for h in hs]), strict=True):
        assert got == pytest.approx(alike(2500, h), rel=1e-9, abs=1e-300), h
