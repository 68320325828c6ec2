"""Ordered scans, quantiles and joins in time against plain windows or brute force."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from bedside.functions.ordered import Ordered
from bedside.functions.quantiles import group_quantiles
from bedside.operators import temporal as T

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def series(spark):
    """One key holds over a third of all rows; gaps, equal instants and nulls occur."""
    rnd = random.Random(7)
    rows = []
    for i in range(900):
        key = "hot" if i % 5 < 2 else f"k{rnd.randrange(12)}"
        t = T0 + timedelta(minutes=rnd.choice([rnd.randrange(20000), 600, 601]))
        v = None if rnd.random() < 0.4 else float(rnd.randrange(50))
        rows.append((key, t, i, v))
    return spark.createDataFrame(rows, "k string, t timestamp, i int, v double")


def test_matches_plain_windows(series):
    w = Window.partitionBy("k").orderBy("t", "i")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    want = series.withColumns({
        "lag1": F.lag("v").over(w), "lag2": F.lag("v", 2).over(w), "lead1": F.lead("v").over(w), "lead2": F.lead("v", 2).over(w),
        "fill": F.last("v", True).over(upto), "fillb": F.last("v", True).over(before), "back": F.first("v", True).over(w.rowsBetween(0, Window.unboundedFollowing)),
        "s": F.sum("v").over(upto), "m": F.max("v").over(upto), "mb": F.max("v").over(before), "rn": F.row_number().over(w).cast("long"), "tot": F.sum("v").over(Window.partitionBy("k"))})
    got = (Ordered(series, ["k"], ["t", "i"]).lag("lag1", "v").lag("lag2", "v", 2).lead("lead1", "v").lead("lead2", "v", 2).fill("fill", "v").fill_before("fillb", "v")
           .fill_back("back", "v").cumsum("s", "v").cummax("m", "v").cummax_before("mb", "v").row_number("rn").total("tot", "v").apply())
    cols = ["i", "lag1", "lag2", "lead1", "lead2", "fill", "fillb", "back", "s", "m", "mb", "rn", "tot"]
    key = lambda r: r["i"]
    assert sorted(got.select(cols).collect(), key=key) == sorted(want.select(cols).collect(), key=key)


def test_chained_pass_keeps_slices(series):
    a = Ordered(series, ["k"], ["t", "i"]).row_number("a").apply(keep_slice=True)
    b = Ordered(a, ["k"], ["t", "i"]).row_number("b").apply()
    assert "_slice" not in b.columns and b.where("a <> b").count() == 0


@pytest.mark.parametrize("interpolation", ["linear", "nearest"])
def test_quantiles(series, interpolation):
    got = {r["k"]: r for r in group_quantiles(series, ["k"], {"v": {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}}, interpolation).collect()}
    data = {}
    for r in series.where("v is not null").collect():
        data.setdefault(r["k"], []).append(r["v"])
    assert set(got) == set(data)
    for k, vs in data.items():
        vs = sorted(vs)
        for name, p in zip("abcde", (0, 0.25, 0.5, 0.9, 1)):
            want = np.quantile(vs, p) if interpolation == "linear" else vs[round(p * (len(vs) - 1))]
            assert math.isclose(got[k][name], want, abs_tol=1e-9), (k, name)


def test_quantiles_null_group_and_no_keys(spark):
    d = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0), ("a", None)], "g string, v double")
    got = {r["g"]: r["q"] for r in group_quantiles(d, ["g"], {"v": {"q": 0.5}}).collect()}
    assert got == {None: 2.0, "a": 5.0}
    assert group_quantiles(d, [], {"v": {"q": 0.5}}).collect()[0]["q"] == 3.0


def test_asof_edges(frame):
    left = frame([("a", "2024-01-01 10:00:00", 1), ("a", "2024-01-01 14:00:00", 2), ("a", "2024-01-01 14:01:00", 3), ("b", "2024-01-01 10:00:00", 4)], "k string, t ts, i int")
    right = frame([("a", "2024-01-01 10:00:00", 0.4), ("a", "2024-01-01 10:00:00", 0.5)], "k string, rt ts, f double")
    got = {r["i"]: r["f"] for r in T.asof_join(left, right, ["k"], "t", "rt", ["f"], 240).collect()}
    # equal instant matches, 240 minutes match, 241 do not; of two rows at one instant the larger wins
    assert got == {1: 0.5, 2: 0.5, 3: None, 4: None}
    assert {r["i"]: r["f"] for r in T.asof_join(left, right, ["k"], "t", "rt", ["f"]).collect()}[3] == 0.5


def test_asof_and_nearest_brute_force(series):
    left = series.where("i % 3 = 0").select("k", "t", "i")
    right = series.where("i % 3 = 1").select("k", F.col("t").alias("rt"), F.col("i").alias("ri"))
    rows, pool = left.collect(), {}
    for r in right.collect():
        pool.setdefault(r["k"], []).append((r["rt"], r["ri"]))
    got = {r["i"]: r["matched_ts"] for r in T.asof_join(left, right, ["k"], "t", "rt", ["ri"]).collect()}
    near = {r["i"]: r["matched_ts"] for r in T.nearest_join(left, right, ["k"], "t", "rt", ["ri"]).collect()}
    for r in rows:
        before = [t for t, _ in pool.get(r["k"], []) if t <= r["t"]]
        assert got[r["i"]] == (max(before) if before else None)
        gaps = [abs(t - r["t"]) for t, _ in pool.get(r["k"], [])]
        assert (abs(near[r["i"]] - r["t"]) if gaps else near[r["i"]]) == (min(gaps) if gaps else None)


@pytest.mark.parametrize("closed", ["both", "left"])
def test_interval_join_brute_force(series, spark, closed):
    rnd = random.Random(3)
    wins = [(rnd.choice(["hot", "k1", "k2"]), T0 + timedelta(minutes=rnd.choice([600, rnd.randrange(15000)])), rnd.randrange(6000), j) for j in range(25)]
    w = spark.createDataFrame([(k, s, s + timedelta(minutes=d), j) for k, s, d, j in wins], "k string, s timestamp, e timestamp, j int")
    got = {(r["i"], r["j"]) for r in T.interval_join(series, w, ["k"], "t", "s", "e", closed).collect()}
    want = {(r["i"], j) for r in series.collect() for k, s, d, j in wins
            if k == r["k"] and s <= r["t"] and (r["t"] <= s + timedelta(minutes=d) if closed == "both" else r["t"] < s + timedelta(minutes=d))}
    assert got == want and want


def test_assign_location_half_open(frame):
    adt = frame([("h", "2024-01-01 00:00:00", "2024-01-01 06:00:00", "icu"), ("h", "2024-01-01 08:00:00", "2024-01-01 09:00:00", "ward")], "h string, in_dttm ts, out_dttm ts, location_category string")
    ev = frame([("h", "2024-01-01 00:00:00", 1), ("h", "2024-01-01 06:00:00", 2), ("h", "2024-01-01 07:00:00", 3), ("h", "2024-01-01 08:30:00", 4), ("x", "2024-01-01 08:30:00", 5)], "h string, t ts, i int")
    got = {r["i"]: r["location_category"] for r in T.assign_location(ev, adt, ["h"], "t").collect()}
    assert got == {1: "icu", 2: T.NO_MATCH, 3: T.NO_MATCH, 4: "ward", 5: T.NO_MATCH}


def test_stitching(frame):
    rows = [("p", 1, "2024-01-01 00:00:00", "2024-01-02 00:00:00"), ("p", 2, "2024-01-02 05:59:00", "2024-01-02 08:00:00"),  # 5 h 59
            ("p", 3, "2024-01-02 14:00:00", "2024-01-05 00:00:00"),  # exactly 6 h
            ("p", 4, "2024-01-03 00:00:00", "2024-01-03 01:00:00"),  # nested
            ("p", 5, "2024-01-05 06:00:00", "2024-01-05 07:00:00"),  # 6 h after the longest, not after the nested one
            ("p", 6, "2024-01-05 13:01:00", "2024-01-05 14:00:00"),  # 6 h 01
            ("q", 7, "2024-01-02 01:00:00", "2024-01-02 02:00:00")]
    d = frame(rows, "patient_id string, hospitalization_id int, admission_dttm ts, discharge_dttm ts")
    s = T.stitch_encounters(d)
    assert {r[0]: r[1] for r in s.select("hospitalization_id", "encounter_block").collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 6, 7: 7}
    assert T.stitch_statistics(s).collect()[0].asDict() == {"before": 7, "after": 3, "linked": 4, "multi_blocks": 1, "max_per_block": 5}
    assert {tuple(r) for r in T.encounter_mapping(s).select("encounter_block", "admission_year").collect()} == {(1, 2024), (6, 2024), (7, 2024)}
