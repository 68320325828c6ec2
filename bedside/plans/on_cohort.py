"""Encounter flags, cohorts and strata (D)."""

from pyspark.sql import functions as F

from bedside.functions.expr import micros
from bedside.operators import cohort as H
from bedside.plans import views as V
from bedside.plans.registry import query


def parts(spark, sf):
    """Location, respiratory and medication rows of the stitched adult visits."""
    b = V.blocks(spark, sf)
    adt = b.select("encounter_block", "hospitalization_id", "location_category", "discharge_category",
                   F.col("admission_dttm").alias("in_dttm"), F.col("discharge_dttm").alias("out_dttm"))
    resp = b.select("encounter_block", "device_category", F.col("value").alias("lpm_set"))
    meds = b.select("encounter_block", "med_category", F.col("admission_dttm").alias("admin_dttm"))
    return adt, resp, meds


DRUGS = ["norepinephrine"]


def flags(spark, sf):
    return H.all_flags(*parts(spark, sf), drugs=DRUGS)


FLAGS = """ff AS (SELECT encounter_block,
    max(CASE WHEN location_category = 'icu' THEN 1 ELSE 0 END) AS icu_enc,
    max(CASE WHEN discharge_category IN ('Expired', 'Hospice') THEN 1 ELSE 0 END) AS death_enc,
    max(CASE WHEN location_category = 'ward' THEN 1 ELSE 0 END) AS ward_enc,
    max(CASE WHEN location_category = 'procedural' THEN 1 ELSE 0 END) AS proc,
    max(CASE WHEN device_category IN ('imv', 'nippv') OR (device_category = 'high flow nc' AND value >= 30) THEN 1 ELSE 0 END) AS hs,
    max(CASE WHEN device_category = 'nippv' OR (device_category = 'high flow nc' AND value >= 30) THEN 1 ELSE 0 END) AS nh,
    max(CASE WHEN device_category = 'imv' THEN 1 ELSE 0 END) AS imv,
    max(CASE WHEN med_category = 'norepinephrine' THEN 1 ELSE 0 END) AS va,
    min(admission_dttm) FILTER (med_category = 'norepinephrine') AS pt FROM blocks GROUP BY 1),
  ed AS (SELECT DISTINCT f.encounter_block, f.pt FROM ff f JOIN blocks b ON f.encounter_block = b.encounter_block
    AND b.location_category = 'ed' AND f.pt >= b.admission_dttm AND f.pt < b.discharge_dttm),
  ed2 AS (SELECT ed.encounter_block, ed.pt, max(CASE WHEN b.admission_dttm > ed.pt AND b.location_category = 'icu' THEN 1 ELSE 0 END) AS li,
    max(CASE WHEN b.admission_dttm > ed.pt AND b.location_category = 'ward' THEN 1 ELSE 0 END) AS lw
    FROM ed JOIN blocks b USING (encounter_block) GROUP BY ALL),
  g AS (SELECT *, CASE WHEN icu_enc = 0 AND proc = 1 THEN 1 ELSE 0 END AS po FROM ff),
  h AS (SELECT encounter_block, icu_enc, death_enc, ward_enc, po AS is_procedural_ld_only, hs * (1 - po) AS high_support_enc,
    nh * (1 - po) AS nippv_hfnc_enc, va * (1 - po) AS vaso_support_enc, imv * (1 - po) AS imv_enc FROM g),
  flags AS (SELECT h.*, CASE WHEN is_procedural_ld_only = 0 AND (icu_enc = 1 OR death_enc = 1 OR high_support_enc = 1 OR vaso_support_enc = 1)
      THEN 1 ELSE 0 END AS cohort_enc,
    vaso_support_enc * icu_enc AS vaso_icu_enc, vaso_support_enc * (1 - icu_enc) AS vaso_no_icu_enc,
    high_support_enc * icu_enc AS high_support_icu_enc, high_support_enc * (1 - icu_enc) AS high_support_no_icu_enc,
    nippv_hfnc_enc * icu_enc AS nippv_hfnc_icu_enc, nippv_hfnc_enc * (1 - icu_enc) AS nippv_hfnc_no_icu_enc,
    death_enc * (1 - icu_enc) * (1 - vaso_support_enc) * (1 - high_support_enc) AS other_critically_ill,
    (1 - death_enc) * (1 - icu_enc) * (1 - vaso_support_enc) * (1 - high_support_enc) AS ward_no_critical_care,
    1 - imv_enc AS no_imv_enc, (1 - imv_enc) * icu_enc AS no_imv_icu_enc, (1 - imv_enc) * (1 - icu_enc) AS no_imv_no_icu_enc,
    coalesce(li, 0) AS vaso_ed_icu_enc, CASE WHEN lw = 1 AND li = 0 THEN 1 ELSE 0 END AS vaso_ed_ward_enc
    FROM h LEFT JOIN ed2 USING (encounter_block))"""
MEMBERS = "members AS (" + " UNION ALL ".join(
    f"SELECT '{s}' AS stratum, * FROM flags WHERE {c} = 1" for s, c in H.STRATA.items()) + ")"


@query("d1_location_flags", views="blocks", cte=FLAGS, sql="SELECT encounter_block, icu_enc, death_enc, ward_enc FROM ff")
def d1(spark, sf):
    return H.location_flags(parts(spark, sf)[0]).drop("is_procedural_ld_only")


@query("d2_procedural_only", views="blocks", cte=FLAGS, sql="SELECT encounter_block, po AS is_procedural_ld_only FROM g")
def d2(spark, sf):
    return H.location_flags(parts(spark, sf)[0]).select("encounter_block", "is_procedural_ld_only")


@query("d3_high_support", views="blocks", cte=FLAGS, sql="SELECT encounter_block FROM ff WHERE hs = 1")
def d3(spark, sf):
    return H.high_support(parts(spark, sf)[1])


@query("d4_nippv_hfnc", views="blocks", cte=FLAGS, sql="SELECT encounter_block FROM ff WHERE nh = 1")
def d4(spark, sf):
    return H.nippv_hfnc(parts(spark, sf)[1])


@query("d5_vaso_support", views="blocks", sql="""SELECT DISTINCT encounter_block FROM blocks
  WHERE med_category IN ('norepinephrine', 'epinephrine', 'vasopressin', 'dopamine')""")
def d5(spark, sf):
    return H.vaso_support(parts(spark, sf)[2])


@query("d6_critical_illness_cohort", views="blocks", cte=FLAGS, sql="""SELECT encounter_block, icu_enc, death_enc, ward_enc, is_procedural_ld_only,
  high_support_enc, nippv_hfnc_enc, vaso_support_enc, imv_enc, cohort_enc FROM flags WHERE cohort_enc = 1""")
def d6(spark, sf):
    return H.critical_illness(H.build_flags(*parts(spark, sf), drugs=DRUGS))


@query("d6_cohort_counts", views="blocks", cte=FLAGS, sql="""SELECT count(*) AS total, CAST(sum(icu_enc) AS BIGINT) AS icu_enc,
  CAST(sum(high_support_enc) AS BIGINT) AS high_support_enc, CAST(sum(vaso_support_enc) AS BIGINT) AS vaso_support_enc,
  CAST(sum(death_enc) AS BIGINT) AS death_enc, CAST(sum(cohort_enc) AS BIGINT) AS cohort_enc FROM flags""")
def d6c(spark, sf):
    return H.cohort_counts(H.build_flags(*parts(spark, sf), drugs=DRUGS))


@query("d7_ward_cohort", views="blocks", cte=FLAGS, sql="SELECT encounter_block, death_enc, icu_enc FROM flags WHERE ward_enc = 1")
def d7(spark, sf):
    return H.ward_cohort(H.location_flags(parts(spark, sf)[0])).select("encounter_block", "death_enc", "icu_enc")


@query("d8_ed_pressor_strata", views="blocks", cte=FLAGS, sql="""SELECT encounter_block, epoch_us(pt) AS first_us, li AS vaso_ed_icu_enc,
  CASE WHEN lw = 1 AND li = 0 THEN 1 ELSE 0 END AS vaso_ed_ward_enc FROM ed2""")
def d8(spark, sf):
    adt, _, meds = parts(spark, sf)
    return H.ed_pressor_flags(adt, meds, drugs=DRUGS).select(
        "encounter_block", micros("first_pressor_admin_dttm").alias("first_us"), "vaso_ed_icu_enc", "vaso_ed_ward_enc")


SPLIT = ["vaso_icu_enc", "vaso_no_icu_enc", "high_support_icu_enc", "high_support_no_icu_enc", "nippv_hfnc_icu_enc",
         "nippv_hfnc_no_icu_enc", "other_critically_ill", "ward_no_critical_care"]


@query("d9_split_flags", views="blocks", cte=FLAGS, sql=f"SELECT encounter_block, {', '.join(SPLIT)} FROM flags")
def d9(spark, sf):
    return H.derived_flags(H.build_flags(*parts(spark, sf), drugs=DRUGS)).select("encounter_block", *SPLIT)


@query("d10_no_imv_flags", views="blocks", cte=FLAGS, sql="SELECT encounter_block, no_imv_enc, no_imv_icu_enc, no_imv_no_icu_enc FROM flags")
def d10(spark, sf):
    return H.derived_flags(H.build_flags(*parts(spark, sf), drugs=DRUGS)).select(
        "encounter_block", "no_imv_enc", "no_imv_icu_enc", "no_imv_no_icu_enc")


@query("d11_stratum_membership", views="blocks", cte=FLAGS + "," + MEMBERS, sql="SELECT stratum, encounter_block FROM members")
def d11(spark, sf):
    return H.stratum_members(flags(spark, sf))


@query("d12_outcome_flags", views="blocks", sql="""SELECT encounter_block, max(CASE WHEN discharge_category = 'Hospice' THEN 1 ELSE 0 END) AS hospice,
  max(CASE WHEN discharge_category = 'Expired' THEN 1 ELSE 0 END) AS expired,
  max(CASE WHEN discharge_category IN ('Hospice', 'Expired') THEN 1 ELSE 0 END) AS hospice_or_expired FROM blocks GROUP BY 1""")
def d12(spark, sf):
    return H.outcome_flags(parts(spark, sf)[0])


@query("d13_flow_counts", views="blocks", cte=FLAGS, sql="""SELECT '0_total_hospitalizations' AS count_name, count(*) AS count_value FROM visit
  UNION ALL SELECT '1_adult_hospitalizations', count(*) FROM blocks UNION ALL SELECT '1b_after_stitching', count(*) FROM flags
  UNION ALL SELECT '2_icu', CAST(sum(icu_enc) AS BIGINT) FROM flags UNION ALL SELECT '3_advanced_resp', CAST(sum(high_support_enc) AS BIGINT) FROM flags
  UNION ALL SELECT '3_vaso', CAST(sum(vaso_support_enc) AS BIGINT) FROM flags
  UNION ALL SELECT '4_other_critically_ill', CAST(sum(cohort_enc * other_critically_ill) AS BIGINT) FROM flags
  UNION ALL SELECT '5_all_critically_ill', CAST(sum(cohort_enc) AS BIGINT) FROM flags
  UNION ALL SELECT '6_ward_no_critical_care', CAST(sum(ward_enc * ward_no_critical_care) AS BIGINT) FROM flags
  UNION ALL SELECT 'ward_cohort_total', CAST(sum(ward_enc) AS BIGINT) FROM flags""")
def d13(spark, sf):
    v = V.visit(spark, sf)
    return H.flow_counts(v, v.where("age_at_admission >= 18"), flags(spark, sf), ward_mode=True)


@query("d14_mortality_by_stratum", views="blocks", cte=FLAGS + "," + MEMBERS, sql="""SELECT stratum, count(*) AS n_encounters,
  CAST(sum(death_enc) AS BIGINT) AS n_deaths, round(sum(death_enc) * 100.0::DOUBLE / count(*), 6) AS mortality_pct FROM members GROUP BY 1""")
def d14(spark, sf):
    return H.mortality_by_stratum(flags(spark, sf)).withColumn("mortality_pct", F.round("mortality_pct", 6))


GROUPS = {"ICU": "icu_enc", "Advanced Respiratory Support": "high_support_enc", "Vasoactive": "vaso_support_enc",
          "Other Critically Ill": "other_critically_ill", "All": None}


@query("d14_mortality_rates", views="blocks", cte=FLAGS, sql=" UNION ALL ".join(
    f"SELECT '{g}' AS count_name, count(*) AS n_encounters, round(coalesce(sum(death_enc) * 100.0::DOUBLE / nullif(count(*), 0), 0), 6) AS count_value "
    f"FROM flags WHERE cohort_enc = 1{'' if c is None else f' AND {c} = 1'}" for g, c in GROUPS.items()))
def d14b(spark, sf):
    return H.mortality_by_group(H.critical_illness(flags(spark, sf)), GROUPS).withColumn("count_value", F.round("count_value", 6))


@query("d15_membership_intersections", views="blocks", cte=FLAGS, sql="""SELECT icu_enc, high_support_enc, vaso_support_enc, other_critically_ill,
  count(*) AS n FROM flags WHERE cohort_enc = 1 GROUP BY ALL""")
def d15(spark, sf):
    return H.membership_counts(H.critical_illness(flags(spark, sf)),
                               ["icu_enc", "high_support_enc", "vaso_support_enc", "other_critically_ill"])
