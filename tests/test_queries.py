"""Every query has its SQL twin; some are compared on the smallest data set."""

import os

import pytest

import __spark_entry__ as entry
from bedside.plans import catalogue

SF = "/root/testdata/sf0.001"
SOME = ["c1_encounter_stitching", "d14_mortality_by_stratum", "f15_ventilator_free_days", "g13_charlson", "i10_demographic_crosstab", "j5_small_cells", "k4_flat_bins", "n5_pool_display",
        "c7_window_depth", "f13_next_after_pairs", "f15_device_cover", "f16_interval_free_days", "k9_counted_once", "k26_panel"]


def test_registry():
    q, s = catalogue.QUERIES, catalogue.SQL
    assert set(q) == set(s) and set(q) <= set(entry.queries()) and set(s) <= set(entry.oracle_sql())
    ids = {n.split("_")[0] for n in q}
    want = {f"{a}{i}" for a, n in dict(a=9, b=16, c=15, d=15, e=12, f=31, g=17, h=14, i=20, j=6, k=27, l=24, m=8, n=11).items() for i in range(1, n + 1)}
    assert want == ids


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    import duckdb
    con = duckdb.connect()
    for t in ("region", "nation", "customer", "part", "orders", "lineitem", "events", "documents"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    r = con.execute(entry.oracle_sql()[name])
    cols = [d[0] for d in r.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*cols).collect()))) == sorted(map(repr, r.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0
