"""Encounter flags and the critical-illness cohort."""

import pytest
from pyspark.sql import functions as F

from bedside.operators import cohort as H

ADT, RESP, MEDS = "encounter_block string, location_category string, discharge_category string", "encounter_block string, device_category string, lpm_set double", "encounter_block string, med_category string"


def ids(df):
    return {r[0] for r in df.select("encounter_block").collect()}


def test_location_flags(frame):
    d = frame([("a", "Medical ICU", "Home"), ("a", "ward", "Home"), ("b", "WARD ", "Expired"), ("c", "procedural", "Hospice"), ("d", "L&D", "Home"), ("d", "icu", "Home"), ("e", None, None)], ADT)
    got = {r["encounter_block"]: (r["icu_enc"], r["death_enc"], r["ward_enc"], r["is_procedural_ld_only"]) for r in H.location_flags(d).collect()}
    assert got == {"a": (1, 0, 1, 0), "b": (0, 1, 1, 0), "c": (0, 1, 0, 1), "d": (1, 0, 0, 0), "e": (0, 0, 0, 0)}
    assert {r["encounter_block"]: r["icu_enc"] for r in H.location_flags(d, match="equals").collect()}["a"] == 0


def test_high_support_threshold(frame):
    d = frame([("a", "IMV", None), ("b", "CPAP", None), ("c", "High Flow NC", 30.0), ("d", "high flow nc", 29.0), ("e", "nasal cannula", 60.0), ("f", "high flow nc", None), ("g", "nippv", 1.0)], RESP)
    assert ids(H.high_support(d)) == {"a", "b", "c", "g"}
    assert ids(H.high_support(d, threshold=20)) == {"a", "b", "c", "d", "g"}
    assert ids(H.nippv_hfnc(d)) == {"c", "g"}
    assert ids(H.high_support(d.drop("lpm_set"))) == {"a", "b", "g"}
    assert ids(H.high_support(d.limit(0))) == set()


def test_flow_given_as_text(spark):
    d = spark.createDataFrame([("a", "high flow nc", "40"), ("b", "high flow nc", "n/a")], "encounter_block string, device_category string, lpm_set string")
    assert ids(H.high_support(d)) == {"a"}


def test_vaso_support(frame):
    d = frame([("a", "Norepinephrine"), ("b", "propofol"), ("c", "angiotensin")], MEDS)
    assert ids(H.vaso_support(d)) == {"a", "c"}
    assert ids(H.vaso_support(d, drugs=["PROPOFOL"])) == {"b"}


@pytest.fixture
def site(frame):
    adt = frame([("E_ICU", "icu", "Home"), ("E_ADV", "ward", "Home"), ("E_VASO", "ed", "Home"), ("E_DEATH", "ward", "Expired"), ("E_PROC", "procedural", "Home"), ("E_LD", "l&d", "Expired"),
                 ("E_WARD", "ward", "Home")], ADT)
    resp = frame([("E_ADV", "imv", None), ("E_PROC", "imv", None)], RESP)
    meds = frame([("E_VASO", "norepinephrine"), ("E_PROC", "epinephrine")], MEDS)
    return adt, resp, meds


def test_seven_encounters(site):
    f = H.build_flags(*site)
    assert ids(H.critical_illness(f)) == {"E_ICU", "E_ADV", "E_VASO", "E_DEATH"}
    assert H.cohort_counts(f).collect()[0].asDict() == {"total": 7, "icu_enc": 1, "high_support_enc": 1, "vaso_support_enc": 1, "death_enc": 2, "cohort_enc": 4}


def test_splits_partition_parents(site):
    f = H.derived_flags(H.build_flags(*site))
    for parent, stem in (("high_support_enc", "high_support"), ("vaso_support_enc", "vaso"), ("nippv_hfnc_enc", "nippv_hfnc"), ("no_imv_enc", "no_imv")):
        assert f.where(F.col(f"{stem}_icu_enc") + F.col(f"{stem}_no_icu_enc") != F.col(parent)).count() == 0
    assert ids(f.where("other_critically_ill = 1")) == {"E_DEATH", "E_LD"}


def test_ed_pressor(frame):
    adt = frame([("a", "ed", "2024-01-01 00:00:00", "2024-01-01 04:00:00"), ("a", "icu", "2024-01-01 04:00:00", "2024-01-02 00:00:00"),
                 ("b", "ed", "2024-01-01 00:00:00", "2024-01-01 04:00:00"), ("b", "ward", "2024-01-01 04:00:00", "2024-01-02 00:00:00"),
                 ("c", "ed", "2024-01-01 00:00:00", "2024-01-01 04:00:00"), ("c", "icu", "2024-01-01 04:00:00", "2024-01-02 00:00:00"),
                 ("d", "ed", "2024-01-01 00:00:00", "2024-01-01 04:00:00")], "encounter_block string, location_category string, in_dttm ts, out_dttm ts")
    meds = frame([("a", "norepinephrine", "2024-01-01 01:00:00"), ("b", "norepinephrine", "2024-01-01 00:00:00"), ("c", "norepinephrine", "2024-01-01 04:00:00"),
                  ("d", "norepinephrine", "2024-01-01 01:00:00"), ("d", "propofol", "2024-01-01 00:30:00")], "encounter_block string, med_category string, admin_dttm ts")
    got = {r["encounter_block"]: (r["vaso_ed_icu_enc"], r["vaso_ed_ward_enc"]) for r in H.ed_pressor_flags(adt, meds).collect()}
    assert got == {"a": (1, 0), "b": (0, 1), "d": (0, 0)}  # c was given at the moment of leaving


def test_strata(site):
    f = H.derived_flags(H.build_flags(*site))
    m = {(r[0], r[1]) for r in H.stratum_members(f).collect()}
    assert ("icu", "E_ICU") in m and ("vaso/no_icu", "E_VASO") in m and ("deaths", "E_DEATH") in m and ("advanced_resp", "E_PROC") not in m
