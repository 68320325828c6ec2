"""Exact p-values of small samples against every arrangement, and the normal tail against the library's."""

import math
import random
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from bedside.operators import dist


def gap(x, y):
    at = lambda s, v: sum(q <= v for q in s) / len(s)
    return max(abs(at(x, v) - at(y, v)) for v in (*x, *y))


def share(n1, n2, statistic):
    """Share of the arrangements of n1 + n2 distinct values whose statistic is at least as far out."""
    both = range(n1 + n2)
    hits = [statistic([v for v in both if v in c], [v for v in both if v not in c]) for c in map(set, combinations(both, n1))]
    return sum(hits) / len(hits)


def samples(spark, x, y):
    make = lambda s: spark.createDataFrame([(float(v),) for v in s], "v double")
    return make(x), make(y), "v"


@pytest.mark.parametrize("n1,n2,seed", [(1, 1, 0), (1, 5, 1), (3, 4, 2), (5, 5, 3), (8, 4, 4), (6, 7, 5), (8, 8, 6)])
def test_exact_against_all_arrangements(spark, n1, n2, seed):
    values = list(range(n1 + n2))
    random.Random(seed).shuffle(values)
    x, y = values[:n1], values[n1:]
    d = gap(x, y)
    k = dist.ks_test(*samples(spark, x, y), exact_cells=10_000).first()
    assert k.statistic == pytest.approx(d)
    assert k.p_value == pytest.approx(share(n1, n2, lambda p, q: gap(p, q) >= d - 1e-9), abs=1e-12)
    u = lambda p, q: sum(a > b for a in p for b in q)
    mine = u(x, y)
    m = dist.mann_whitney(*samples(spark, x, y), exact=8).first()
    low = share(n1, n2, lambda p, q: u(p, q) <= min(mine, n1 * n2 - mine))
    assert (m.n1, m.n2, m.statistic) == (n1, n2, mine)
    assert m.p_value == pytest.approx(min(1.0, 2 * low), abs=1e-12)


def test_published_case(spark):
    """Two samples of 8 without overlap: 2 of 12870 arrangements."""
    x, y = range(8), range(10, 18)
    assert dist.mann_whitney(*samples(spark, x, y), exact=8).first().p_value == pytest.approx(2 / 12870, abs=1e-15)
    assert dist.ks_test(*samples(spark, x, y), exact_cells=64).first().p_value == pytest.approx(2 / 12870, abs=1e-12)


def test_where_the_large_sample_form_stays(spark):
    x, y = [1, 2, 2, 3], [2, 4, 5]
    tied = dist.mann_whitney(*samples(spark, x, y), exact=8).first().p_value
    assert tied == dist.mann_whitney(*samples(spark, x, y)).first().p_value
    assert dist.mann_whitney(*samples(spark, [], y), exact=8).first().p_value == dist.mann_whitney(*samples(spark, [], y)).first().p_value
    big = samples(spark, range(0, 400, 2), range(1, 400, 2))
    assert dist.mann_whitney(*big, exact=500).first() == dist.mann_whitney(*big).first()  # too many arrangements
    assert dist.ks_test(*big, exact_cells=100).first() == dist.ks_test(*big).first()
    with pytest.raises(ValueError):
        dist.ks_test(*big, exact_cells=10**9)


def paths_inside(n1, n2, edge):
    """Lattice paths that stay inside the band, in whole numbers, cell by cell."""
    ways = {}
    for i in range(n1 + 1):
        for j in range(n2 + 1):
            before = 1 if i == j == 0 else ways.get((i - 1, j), 0) + ways.get((i, j - 1), 0)
            ways[i, j] = before if abs(i * n2 - j * n1) < edge else 0
    return ways[n1, n2]


def test_larger_samples_against_whole_numbers(spark):
    rng = random.Random(1)
    x, y = [rng.random() for _ in range(150)], [rng.random() + 0.1 for _ in range(170)]
    inside = paths_inside(150, 170, round(gap(x, y) * 150 * 170))
    want = 1 - inside / math.comb(320, 150)
    assert dist.ks_test(*samples(spark, x, y), exact_cells=100_000).first().p_value == pytest.approx(want, rel=1e-9)
    s = samples(spark, x[:8], y[:150])
    assert dist.mann_whitney(*s, exact=8).first().p_value == pytest.approx(dist.mann_whitney(*s).first().p_value, rel=0.1)


def test_normal_tail(spark):
    zs = [-8.0, -3.6, -3.4, -1.0, -0.1, 0.0, 1e-9, 0.5, 1.96, 3.5, 3.6, 4.3, 6.0, 20.0, None]
    got = [r[0] for r in spark.createDataFrame([(z,) for z in zs], "z double").select(dist.normal_tail(F.col("z"))).collect()]
    for z, p in zip(zs, got):
        assert p is None if z is None else p == pytest.approx(math.erfc(z / math.sqrt(2)) / 2, rel=1e-11, abs=1e-300)
