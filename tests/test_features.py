"""Hand-computed cases: ventilation, survival, scores, doses, bins, profiles, pooling."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from bedside.operators import dist as D
from bedside.operators import journey as J
from bedside.operators import pool as P
from bedside.operators import report as T
from bedside.operators import resp as R
from bedside.operators import severity as S

T0 = datetime(2024, 1, 1)


def tube_rows(spark, text, ident="e", hours=1.0):
    """'-' off, 'V' on, one row per hour."""
    return spark.createDataFrame([(ident, T0 + timedelta(hours=hours * i), i, "IMV" if c == "V" else "room air") for i, c in enumerate(text)],
                                 "encounter_block string, recorded_dttm timestamp, i int, device_category string")


def summary(spark, text, death=0, hours=1.0, discharged=True):
    enc = spark.createDataFrame([("e", T0, T0 + timedelta(days=60) if discharged else None, death)], "encounter_block string, admission_dttm timestamp, discharge_dttm timestamp, death_enc int")
    return R.extubation_summary(tube_rows(spark, text, hours=hours), enc, ["recorded_dttm", "i"]).collect()[0]


def test_clean_episode(spark):
    r = summary(spark, "--VVVV--")
    assert r["extubation_status"] == "extubated" and r["time_to_extubation_hours"] == 4.0 and r["imv_episodes_n"] == 1
    assert r["pre_admission_imv"] == 0 and r["intubated_within_24hr_admit"] == 1 and r["extubation_failure_48hr"] == 0


def test_flicker_is_not_an_intubation(spark):
    r = summary(spark, "--V--", death=1)
    assert r["intubation_start_dttm"] is None and r["imv_episodes_n"] == 0 and r["extubation_status"] == "death_on_imv"


def test_first_row_on(spark):
    r = summary(spark, "VVVV--")
    assert r["pre_admission_imv"] == 1 and r["intubation_start_dttm"] == T0 and r["time_to_extubation_hours"] is None and r["extubation_status"] == "extubated"


def test_reintubation_within_48(spark):
    r = summary(spark, "--VVV--VVV--")
    assert r["imv_episodes_n"] == 2 and r["time_to_reintubation_hours"] == 2.0 and r["extubation_failure_48hr"] == 1


def test_failed_attempt(spark):
    r = summary(spark, "--VVV--", hours=1 / 60)
    assert r["imv_episodes_n"] == 0 and r["extubation_status"] == "failed_attempt"


def test_status_unknown_and_on_discharge(spark):
    assert summary(spark, "--VVVV")["extubation_status"] == "discharged_on_imv"
    assert summary(spark, "--VVVV", discharged=False)["extubation_status"] == "unknown"


def test_kaplan_meier(spark):
    d = spark.createDataFrame([("a", 1.0, 1), ("a", 2.0, 1), ("a", 2.0, 0), ("a", 3.0, 0), ("a", 5.0, 1), ("b", 1.0, 0)], "stratum string, duration double, event int")
    got = {(r["stratum"], r["timeline"]): r for r in R.kaplan_meier(d).collect()}
    want = {0.0: (1.0, 5), 1.0: (0.8, 5), 2.0: (0.6, 4), 3.0: (0.6, 2), 5.0: (0.0, 1)}
    for t, (s, n) in want.items():
        assert math.isclose(got["a", t]["survival_prob"], s, abs_tol=1e-12) and got["a", t]["at_risk"] == n
    assert got["b", 1.0]["survival_prob"] == 1.0 and got["a", 5.0]["ci_upper"] == 0.0 and got["a", 0.0]["ci_lower"] == 1.0
    v = 1 / (5 * 4)  # one event of five: log-log band by hand
    ls = math.log(0.8)
    lo = math.exp(-math.exp(math.log(-ls) - 1.959963984540054 * math.sqrt(v) / ls))
    assert math.isclose(got["a", 1.0]["ci_lower"], lo, rel_tol=1e-12)
    cut = {r["timeline"]: r for r in R.kaplan_meier(d.where("stratum = 'a'"), limit=4).collect()}
    assert cut[4.0]["observed_events"] == 0 and math.isclose(cut[4.0]["survival_prob"], 0.6)


def test_waterfall(spark):
    rows = [(0, None, "SIMV", None, None), (1, None, None, 0.5, None), (2, None, None, None, None), (3, "nasal cannula", None, None, 2.5), (4, None, "pressure support/cpap", None, None),
            (5, "room air", None, None, None), (6, None, "pressure support", None, None)]
    d = spark.createDataFrame([("e", T0 + timedelta(hours=i), i, dev, mode, f, lpm) for i, dev, mode, f, lpm in rows],
                              "encounter_block string, recorded_dttm timestamp, i int, device_category string, mode_category string, fio2_set double, lpm_set double")
    got = R.waterfall(d, ["recorded_dttm", "i"], ["fio2_set"]).orderBy("i").collect()
    assert [r["device_category"] for r in got] == ["imv", "imv", "imv", "nasal cannula", "nasal cannula", "room air", "nippv"]
    assert [r["fio2_set"] for r in got] == [None, 0.5, 0.5, 0.28, None, 0.21, None]
    assert [r["device_cat_id"] for r in got] == [1, 1, 1, 2, 2, 3, 4] and [r["mode_cat_id"] for r in got] == [1, 1, 1, 2, 3, 4, 5]


@pytest.mark.parametrize("path,n", [("icu procedural icu", 1), ("icu ward icu", 2), ("icu ed icu", 1), ("ward icu icu other icu", 2), ("ward ed", None)])
def test_icu_episodes(spark, path, n):
    d = spark.createDataFrame([("e", T0 + timedelta(hours=i), i, p) for i, p in enumerate(path.split())], "encounter_block string, in_dttm timestamp, i int, location_category string")
    got = J.icu_episodes(d, ["in_dttm", "i"]).collect()
    assert (got[0]["icu_episodes"] if got else None) == n


def test_journey(spark):
    d = spark.createDataFrame([("e", T0 + timedelta(hours=i), i, p) for i, p in enumerate("ed icu ed ward".split())], "encounter_block string, in_dttm timestamp, i int, location_category string")
    w = J.journey_wide(J.journey_steps(d, ["in_dttm", "i"], max_steps=5), spark.createDataFrame([("e", 1)], "encounter_block string, death_enc int"), max_steps=5).collect()[0]
    assert [w[f"loc_{i}"] for i in range(1, 6)] == ["ED", "ICU", "Ward", "Died", "Died"]


INPUTS = ["dopamine", "epinephrine", "norepinephrine", "dobutamine", "map", "platelet_count", "bilirubin_total", "p_f", "gcs_total", "creatinine"]


def sofa(spark, **v):
    d = spark.createDataFrame([("e", v.pop("device", None), *[v.get(c) for c in INPUTS])], "encounter_block string, device_category string, " + ", ".join(f"{c} double" for c in INPUTS))
    return S.sofa_scores(d).collect()[0]


def test_sofa_borders(spark):
    r = sofa(spark)
    assert all(r[c] is None for c in S.SUBSCORES) and r["sofa_total"] == 0
    r = sofa(spark, platelet_count=20.0, bilirubin_total=1.2, creatinine=5.0, gcs_total=15.0, map=70.0, p_f=199.0, device="IMV")
    assert [r[c] for c in S.SUBSCORES] == [0, 3, 1, 3, 0, 4] and r["sofa_total"] == 11
    assert sofa(spark, p_f=99.0, device="CPAP")["sofa_resp"] == 4 and sofa(spark, p_f=99.0, device="face mask")["sofa_resp"] is None
    assert sofa(spark, p_f=400.0)["sofa_resp"] == 0 and sofa(spark, map=69.9)["sofa_cv_97"] == 1
    assert sofa(spark, norepinephrine=0.1)["sofa_cv_97"] == 3 and sofa(spark, norepinephrine=0.11)["sofa_cv_97"] == 4
    assert sofa(spark, dopamine=5.0)["sofa_cv_97"] == 2 and sofa(spark, dobutamine=1.0, map=90.0)["sofa_cv_97"] == 2


def test_dose_conversion(frame):
    m = frame([("e", "2024-01-01 02:00:00", "norepinephrine", 4.8, "mg/hr"), ("e", "2024-01-01 02:00:00", "norepinephrine", 0.1, "mcg/kg/min"), ("e", "2024-01-01 02:00:00", "norepinephrine", 80.0, "MICROG/min"),
               ("e", "2024-01-01 02:00:00", "norepinephrine", 8000.0, "ng / Minute"), ("e", "2024-01-01 02:00:00", "norepinephrine", 1.0, "mcg/lb/min"), ("e", "2023-12-31 00:00:00", "norepinephrine", 80.0, "mcg/min"),
               ("e", "2024-01-01 02:00:00", "norepinephrine", 1.0, "units/min"), ("e", "2024-01-01 02:00:00", "norepinephrine", 1.0, None)], "encounter_block string, admin_dttm ts, med_category string, med_dose double, med_dose_unit string")
    w = frame([("e", "2024-01-01 00:00:00", 80.0), ("e", "2024-01-01 03:00:00", 100.0)], "encounter_block string, recorded_dttm ts, weight_kg double")
    got = {(r["med_dose"], r["med_dose_unit"], r["admin_dttm"].day): r for r in S.to_preferred_unit(S.convert_doses(m, w), ["norepinephrine"]).collect()}
    assert math.isclose(got[4.8, "mg/hr", 1]["dose_converted"], 1.0) and got[0.1, "mcg/kg/min", 1]["dose_converted"] == 0.1
    assert math.isclose(got[8000.0, "ng / Minute", 1]["dose_converted"], 0.1) and math.isclose(got[1.0, "mcg/lb/min", 1]["dose_converted"], 2.20462)
    assert got[80.0, "mcg/min", 31]["convert_status"] == "missing_weight" and got[1.0, "units/min", 1]["convert_status"] == "unrecognized_unit" and got[1.0, None, 1]["convert_status"] == "missing_unit"


def test_charlson(spark):
    d = spark.createDataFrame([("h", c, f) for c, f in (("E11.9", "ICD10CM"), ("E11.2", "ICD10CM"), ("C78.0", "ICD10CM"), ("C50.9", "ICD10CM"), ("I21.4", "ICD9CM"))] + [("g", "Z00.0", "ICD10CM")],
                              "hospitalization_id string, diagnosis_code string, diagnosis_code_format string")
    got = {r["hospitalization_id"]: r for r in S.charlson(d, ["hospitalization_id"]).collect()}
    h = got["h"]
    assert (h["diabetes_uncomplicated"], h["diabetes_with_complications"], h["cancer"], h["metastatic_cancer"], h["myocardial_infarction"]) == (0, 1, 0, 1, 0)
    assert h["cci_score"] == 1 + 6 and got["g"]["cci_score"] == 0


def test_nee(frame):
    d = frame([("e", "2024-01-01 00:10:00", "norepinephrine", 0.2), ("e", "2024-01-01 00:50:00", "vasopressin", 0.04), ("e", "2024-01-01 01:00:00", "dopamine", 10.0), ("e", "2024-01-01 02:00:00", "propofol", 10.0)],
              "encounter_block string, admin_dttm ts, med_category string, med_dose double")
    r = S.norepinephrine_equivalent(d).collect()[0]
    assert math.isclose(r["nee_peak"], 0.3) and math.isclose(r["nee_median"], 0.1)


def edges(vs, n):
    return sorted({round(float(np.quantile(vs, i / n)), 9) for i in range(n + 1)})


@pytest.mark.parametrize("kind", ["spread", "ties", "few", "one"])
def test_flat_bins(spark, kind):
    rnd = random.Random(1)
    vs = {"spread": [rnd.gauss(0, 10) for _ in range(300)], "ties": [float(rnd.choice([1, 1, 1, 2, 9])) for _ in range(200)], "few": [float(i) for i in range(7)], "one": [4.0] * 30}[kind]
    got = D.flat_bins(spark.createDataFrame([("m", v) for v in vs], "metric string, value double"), ["metric"]).orderBy("bin_num").collect()
    n = 10 if len(vs) >= 20 else max(1, len(vs) // 2)
    e = edges(vs, n)
    pairs = list(zip(e, e[1:])) or [(e[0], e[0])]
    assert [(round(r["bin_min"], 9), round(r["bin_max"], 9)) for r in got] == pairs
    for i, (r, (a, b)) in enumerate(zip(got, pairs)):
        assert r["count"] == sum((a < round(v, 9) <= b) or (i == 0 and round(v, 9) == a) for v in vs)
    assert sum(r["count"] for r in got) == len(vs) and math.isclose(sum(r["percentage"] for r in got), 100)


def test_segmented_bins_cover_segments(spark):
    rnd = random.Random(2)
    vs = [round(rnd.uniform(0, 100), 2) for _ in range(500)]
    cfg = spark.createDataFrame([("m", 30.0, 60.0, 0.0, 100.0, 3, 4, 1)], "metric string, normal_lower double, normal_upper double, outlier_min double, outlier_max double, bins_below int, bins_normal int, bins_above int")
    got = D.segmented_bins(spark.createDataFrame([("m", v) for v in vs], "metric string, value double"), cfg, ["metric"], ["metric"]).collect()
    by = {s: sorted((r["bin_num"], r["count"]) for r in got if r["segment"] == s) for s in ("below", "normal", "above")}
    below = [v for v in vs if v <= 30]
    assert [b for b, _ in by["below"]] == list(range(1, 8))  # first of three split into five
    assert sum(c for _, c in by["below"]) == len(below) and len(by["normal"]) == 4 and len(by["above"]) == 1


def test_ecdf_ends_at_one(spark):
    d = spark.createDataFrame([("m", v) for v in (3.0, 1.0, 1.0, None, 8.0)], "metric string, value double")
    assert [(r["value"], r["probability"]) for r in D.ecdf(d, ["metric"]).orderBy("value").collect()] == [(1.0, 0.5), (3.0, 0.75), (8.0, 1.0)]


def test_bias_corrected_moments(spark):
    r = D.numeric_profile(spark.createDataFrame([(v,) for v in (1.0, 2.0, 3.0, 10.0)], "v double"), ["v"]).collect()[0]
    n, x = 4, np.array([1, 2, 3, 10.0])
    m = x - x.mean()
    g1, g2 = (m**3).mean() / (m**2).mean() ** 1.5, (m**4).mean() / (m**2).mean() ** 2 - 3
    assert math.isclose(r["skewness"], g1 * math.sqrt(n * (n - 1)) / (n - 2)) and math.isclose(r["kurtosis"], (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))


def test_two_samples(spark):
    a, b = [1.0, 2.0, 2.0, 5.0], [2.0, 6.0, 7.0]
    da, db = (spark.createDataFrame([(v,) for v in s], "v double") for s in (a, b))
    assert math.isclose(D.ks_test(da, db, "v").collect()[0]["statistic"], 2 / 3)
    u = sum((x > y) + 0.5 * (x == y) for x in a for y in b)
    assert D.mann_whitney(da, db, "v").collect()[0]["statistic"] == u
    ca, cb = (spark.createDataFrame([(v,) for v in s], "v string") for s in ("aab", "abb"))
    r = D.chi_square(ca, cb, "v").collect()[0]
    assert r["dof"] == 1 and math.isclose(r["statistic"], 0.0, abs_tol=1e-12) and math.isclose(r["p_value"], 1.0, abs_tol=1e-6)
    # erfc(sqrt(s / 2)) + sqrt(2 s / pi) exp(-s / 2) for three degrees of freedom
    da, db = (spark.createDataFrame([(v,) for v in s], "v string") for s in ("a" * 9 + "b" * 4 + "c" * 5 + "d" * 2, "a" * 3 + "b" * 6 + "c" * 4 + "d" * 9))
    r = D.chi_square(da, db, "v").collect()[0]
    s = r["statistic"]
    assert math.isclose(r["p_value"], math.erfc(math.sqrt(s / 2)) + math.sqrt(2 * s / math.pi) * math.exp(-s / 2), abs_tol=1e-6)


def test_time_to_icu(frame):
    d = frame([("a", 1, "2024-01-01 00:00:00", "2024-01-01 05:30:00"), ("b", 1, "2024-01-01 05:00:00", "2024-01-01 04:00:00"), ("c", 0, "2024-01-01 00:00:00", "2024-01-01 05:30:00"),
               ("d", 1, None, "2024-01-01 05:30:00"), ("e", 1, "2024-01-01 00:00:00", None)], "encounter_block string, vaso_ed_icu_enc int, first_pressor_admin_dttm ts, first_icu_in_dttm ts")
    t = R.time_to_target(d)
    assert {r[0]: r[1] for r in t.collect()} == {"a": 5.5, "b": -1.0}
    s = R.summarize_hours(t).collect()[0]
    assert (s["n"], s["n_negative"], s["median"], s["mean"]) == (2, 1, 2.25, 2.25)
    empty = R.summarize_hours(t.limit(0)).collect()[0]
    assert empty["n"] == 0 and empty["median"] is None


def test_pooling(spark):
    rows = [(s, "k", m, v) for s, vals in {"A": ("100", "10.0", "5", "7.0", "1,000"), "B": ("300", "20.0", "2", "9.0", None)}.items()
            for m, v in zip(("n", "age_mean", "los_min", "late_pct", "visits_total"), vals)] + [("A", "k", "late_n", "7"), ("B", "k", "late_n", "27")]
    d = spark.createDataFrame(rows, "site string, k string, metric string, value string")
    got = {r["metric"]: r["pooled"] for r in P.pool_keyed(d, ["k"]).collect()}
    assert got["n"] == 400 and got["los_min"] == 2 and math.isclose(got["late_pct"], 100 * 34 / 400) and got["visits_total"] == 1000
    # whole-number means count as counts, as their values give no other hint
    assert got["age_mean"] == 30
    frac = d.where("metric in ('n', 'age_mean')").replace("10.0", "10.5")
    assert math.isclose({r["metric"]: r["pooled"] for r in P.pool_keyed(frac, ["k"]).collect()}["age_mean"], (10.5 * 100 + 20 * 300) / 400)
    alone = frac.where("metric = 'age_mean'")
    assert P.pool_keyed(alone, ["k"]).collect()[0]["pooled"] is None


def test_crosstab_margins(spark):
    d = spark.createDataFrame([("White", "Hispanic", "Male")] * 12 + [("White", "Hispanic", "Female")] * 4 + [("Asian", None, "Male")] * 15, "race_category string, ethnicity_category string, sex_category string")
    got = {(r[0], r[1], r[2]): (r[3], r[4]) for r in T.demographic_crosstab(d).collect()}
    assert got["White", "Hispanic", "Female"] == (None, "<10") and got["White", "Hispanic", "Male"] == (12, "12") and got["Asian", "Unknown", "Male"] == (15, "15")
    assert got["White", "Total", ""][0] == 12 and got["Total", "Hispanic", "Female"][0] == 0 and got["Total", "Total", ""][0] == 27 and len(got) == 8 * 9 + 8


def test_table_one_cells(spark):
    d = spark.createDataFrame([("a", "p", 1, 50.0, "White"), ("b", "p", 0, 60.0, "White"), ("c", "q", 1, 71.0, None)], "encounter_block string, patient_id string, icu_enc int, age_at_admission double, race_category string")
    n = T.table_one(d.withColumn("col", F.lit("Overall")), T.table_one_rows(), ["col"])
    text = {r["label"]: r["Overall"] for r in T.display_table(n, [], "col", ["Overall"]).collect()}
    assert text["N: Encounter blocks"] == "3" and text["N: Unique patients"] == "2" and text["  ICU encounters, n (%)"] == "2 (66.7%)"
    assert text["Age at admission, median [Q1, Q3]"] == "60.0 [55.0, 65.5]" and text["  Race: White"] == "1 (50.0%)" and text["  Race: Missing"] == "1 (50.0%)"
