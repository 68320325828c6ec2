"""Cases that the tables never reach: missing times and keys, zero divisors, tiny values, clashing rules."""

import math

import pytest
from pyspark.sql import functions as F

from bedside.functions.ordered import Ordered
from bedside.operators import clean, dist, pool, resp, severity, temporal
from bedside.sources import tables

T0, T1, T2 = "2024-01-01 00:00:00", "2024-01-01 01:00:00", "2024-01-01 02:00:00"


@pytest.mark.parametrize("join", [temporal.asof_join, temporal.nearest_join])
def test_left_rows_without_a_time_stay(frame, join):
    left = frame([(1, "a", T1), (2, "a", None), (3, None, T2)], "i int, k string, ts ts")
    right = frame([("a", T0, 5.0), ("a", None, 9.0)], "k string, rts ts, v double")
    got = {r.i: r.v for r in join(left, right, ["k"], "ts", "rts", ["v"]).collect()}
    assert got == {1: 5.0, 2: None, 3: None}


def test_untimed_events_have_no_location(frame):
    adt = frame([("a", "icu", T0, T2)], "k string, location_category string, in_dttm ts, out_dttm ts")
    events = frame([(1, "a", T1), (2, "a", None)], "i int, k string, ts ts")
    got = {r.i: r.location_category for r in temporal.assign_location(events, adt, ["k"], "ts").collect()}
    assert got == {1: "icu", 2: temporal.NO_MATCH}


def test_null_keys_are_one_key_across_slices(frame):
    df = frame([(None, "2024-01-01 23:30:00", 1), (None, "2024-01-02 00:30:00", 2), ("a", T0, 4)], "k string, ts ts, n int")
    got = {(r.k, r.n): r.s for r in Ordered(df, ["k"], ["ts"]).cumsum("s", "n").apply().collect()}
    assert got == {(None, 1): 1, (None, 2): 3, ("a", 4): 4}


def test_ecdf_and_bins_of_a_null_group_and_of_tiny_values(spark):
    df = spark.createDataFrame([(None, i * 1e-11) for i in range(1, 41)] + [("m", float(i)) for i in range(40)], "metric string, value double")
    e = dist.ecdf(df, ["metric"]).where("metric IS NULL").collect()
    assert len(e) == 40 and max(r.probability for r in e) == 1.0
    bins = dist.flat_bins(df, ["metric"]).where("metric = 'm'").count()
    assert bins == 10
    tiny = dist.flat_bins(df.fillna("none"), ["metric"]).where("metric = 'none'").collect()
    assert len(tiny) == 10 and sum(r["count"] for r in tiny) == 40


def test_nan_is_missing_everywhere_in_the_summary(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", float("nan")), ("a", None)], "metric string, value double")
    r = dist.ecdf_summary(df, ["metric"]).first()
    assert (r["count"], r["min"], r["max"], r["mean"], r["std"], r["p50"]) == (2, 1.0, 3.0, 2.0, 1.0, 2.0)


def test_ks_p_values(spark):
    a = spark.range(0, 2000).select(F.col("id").cast("double").alias("v"))
    assert dist.ks_test(a, a, "v").first().p_value == 1.0
    near = dist.ks_test(a, a.withColumn("v", F.col("v") + 0.5), "v").first()
    assert near.p_value > 0.999
    far = dist.ks_test(a, a.withColumn("v", F.col("v") + 100), "v").first()
    x = math.sqrt(1000) * far.statistic
    assert far.p_value == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 60)), abs=1e-9)
    assert dist.ks_test(a, a.limit(0), "v").first() is None or dist.ks_test(a, a.limit(0), "v").first().p_value is None
    same = spark.createDataFrame([(1.0,)] * 5, "v double")
    assert dist.mann_whitney(same, same, "v").first().p_value == 1.0


def test_latest_oxygen_setting_counts_even_if_missing_or_zero(frame):
    measures = frame([(1, 1, T2, 80.0), (2, 2, T2, 80.0), (3, 3, T2, 80.0)], "event_id int, encounter_block int, ts ts, po2_arterial double")
    rows = frame([(1, T0, 0.5, "imv"), (1, T1, None, "room air"), (2, T1, 0.0, "imv"), (3, T1, 0.4, "imv")],
                 "encounter_block int, recorded_dttm ts, fio2_set double, device_category string")
    got = {r.event_id: r.concurrent_pf for r in resp.pf_ratio(measures, rows, ["encounter_block"], "ts").collect()}
    assert got == {3: 200.0}


def test_a_device_becoming_known_is_no_change(frame):
    rows = frame([(1, T0, 1, None, None), (1, T1, 2, "imv", None), (1, T2, 3, "cpap", "x")],
                 "encounter_block int, recorded_dttm ts, event_id int, device_category string, mode_category string")
    got = {r.event_id: (r.device_cat_id, r.mode_cat_id) for r in resp.fill_and_number(rows, ["recorded_dttm", "event_id"]).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (2, 2)}


def test_zero_weight_gives_no_dose(frame):
    meds = frame([(1, 1, T1, "norepinephrine", 10.0, "mcg/min"), (2, 2, T1, "norepinephrine", 10.0, "mcg/min"), (3, 1, None, "norepinephrine", 1.0, "mcg/kg/min")],
                 "event_id int, encounter_block int, admin_dttm ts, med_category string, med_dose double, med_dose_unit string")
    weights = frame([(1, T0, 0.0), (2, T0, 50.0)], "encounter_block int, recorded_dttm ts, weight_kg double")
    got = {r.event_id: (r.dose_mcg_kg_min, r.convert_status) for r in severity.to_preferred_unit(
        severity.convert_doses(meds, weights), ["norepinephrine"]).collect()}
    assert got == {1: (None, "missing_weight"), 2: (0.2, "success"), 3: (1.0, "success")}


def test_a_row_meets_one_outlier_rule(spark):
    rules = clean.range_table(spark, [("hr", None, 0.0, 100.0), ("hr", "bpm", 0.0, 50.0), ("hr", "hz", 0.0, 2.0), ("t", "c", None, 40.0), ("t", "f", 80.0, 110.0)])
    df = spark.createDataFrame([(1, "HR ", "bpm", 60.0), (2, "hr", "other", 60.0), (3, "hr", None, 120.0), (4, "t", "c", 39.0), (5, "q", "c", 9.0)],
                               "i int, category string, unit string, v double")
    by_unit = {r.i: r.v for r in clean.null_outliers_by_category(df, rules, "v", "category", "unit").collect()}
    assert by_unit == {1: None, 2: 60.0, 3: None, 4: 39.0, 5: 9.0}
    by_category = [(r.i, r.v) for r in clean.null_outliers_by_category(df, rules, "v", "category").orderBy("i").collect()]
    assert by_category == [(1, 60.0), (2, 60.0), (3, None), (4, 39.0), (5, 9.0)]


def test_repeated_cells_of_a_site_count_once(spark):
    long = spark.createDataFrame([("A", "k", "n", "10"), ("A", "k", "n", "10"), ("B", "k", "n", "5")], "site string, k string, metric string, value string")
    r = pool.pool_keyed(long, ["k"]).first()
    assert (r.pooled, r.n_sites) == (15.0, 2)


def test_windows_are_cut_to_the_events(frame):
    events = frame([(1, T1)], "k int, ts ts")
    windows = frame([(1, T0, "9999-12-31 00:00:00"), (1, T2, "2024-02-01 00:00:00")], "k int, s ts, e ts")
    out = temporal.interval_join(events, windows, ["k"], "ts", "s", "e")
    assert out.count() == 1
    assert temporal.interval_join(events.limit(0), windows, ["k"], "ts", "s", "e").count() == 0


def test_sites_written_at_once_and_found(spark, tmp_path):
    df = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "site string, n int")
    pool.write_sites(df, str(tmp_path / "a"), "t.parquet")
    assert {(r.site, r.n) for r in pool.read_sites(spark, str(tmp_path / "a"), "t.parquet").collect()} == {("x", 1), ("y", 2), ("z", 3)}
    df.where("site = 'x'").drop("site").write.parquet(str(tmp_path / "b/x/final/t.parquet"))
    assert {(r.site, r.n) for r in pool.read_sites(spark, str(tmp_path / "b"), "t.parquet").collect()} == {("x", 1)}


def test_intermediates_need_a_shared_root_on_a_cluster_and_can_be_deleted(spark, tmp_path):
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            tables.scratch_root(master, None)
        assert tables.scratch_root(master, "hdfs:///x/") == "hdfs:///x"
    tables.cleanup(spark)
    spark.conf.set(tables.ROOT_CONF, str(tmp_path))
    try:
        assert tables.materialise(spark.range(3), "t").count() == 3
        assert len(list((tmp_path / "bedside").iterdir())) == 1
        assert tables.cleanup(spark) == 1 and not list((tmp_path / "bedside").iterdir())
    finally:
        spark.conf.unset(tables.ROOT_CONF)


@pytest.mark.parametrize("first,second", [((10, 9.5), (2, 30.5)), ((2, 30.5), (10, 9.5))])
def test_repeated_rows_of_a_site_stay_whole(spark, first, second):
    cells = lambda site, k, row, n, mean: [(site, k, row, "n", str(n)), (site, k, row, "mean", str(mean))]
    rows = [*cells("a", "k", 0, *first), *cells("a", "k", 1, *second), *cells("b", "k", 0, 5, 1.5), *cells("b", None, 0, 3, 4.5)]
    long = spark.createDataFrame(rows, "site string, k string, row int, metric string, value string")
    got = {(r.k, r.metric): r.pooled for r in pool.pool_keyed(long, ["k"], row="row").collect()}
    assert got["k", "n"] == first[0] + 5
    assert got["k", "mean"] == pytest.approx((first[0] * first[1] + 7.5) / (first[0] + 5)) and got[None, "n"] == 3
    with pytest.raises(Exception, match="two values of one key"):
        pool.pool_keyed(long.drop("row"), ["k"]).collect()


def test_input_columns_named_like_internal_ones(frame):
    df = frame([("a", 7, T0, 1), ("a", 8, T1, 2), ("a", 9, T2, 3)], "k string, _key int, ts ts, _slice int")
    got = Ordered(df, ["k"], ["ts"]).lag("p", "_slice").apply()
    assert got.columns == ["k", "_key", "ts", "_slice", "p"]
    assert {(r._key, r._slice, r.p) for r in got.collect()} == {(7, 1, None), (8, 2, 1), (9, 3, 2)}
    # a slice that was kept for one key is not taken for another
    kept = Ordered(df, ["k"], ["ts"]).lag("p", "_slice").apply(keep_slice=True)
    other = Ordered(kept.withColumn("m", F.col("_key") % 2), ["m"], ["ts"]).lag("q", "_slice").apply()
    assert {(r._key, r.q) for r in other.collect()} == {(7, None), (8, None), (9, 1)}
