"""Medications (H)."""

from pyspark.sql import functions as F

from bedside.operators import journey as J
from bedside.operators import meds as M
from bedside.plans import views as V
from bedside.plans.on_resp import rnd
from bedside.plans.on_severity import DOSE, preferred
from bedside.plans.registry import query

BLOCK = "encounter_block"
GROUPS = {"Vasoactives": ["norepinephrine", "epinephrine", "vasopressin", "dopamine"], "Sedation": ["propofol", "midazolam"]}
DRUGS = [d for ds in GROUPS.values() for d in ds]
INTER = "(SELECT * REPLACE (med_dose * 3 AS med_dose) FROM meds)"


def intermittent(spark, sf):
    """The same columns as continuous administrations, with other doses."""
    return V.meds(spark, sf).withColumn("med_dose", F.col("med_dose") * 3)


@query("h1_exposure_columns", views="blocks", sql="SELECT encounter_block, " + ", ".join(
    f"max(CASE WHEN med_category = '{d}' THEN 1 ELSE 0 END) AS {d}" for d in DRUGS) + " FROM blocks GROUP BY 1")
def h1(spark, sf):
    return M.exposure_columns(V.blocks(spark, sf), DRUGS)


VASO = ["norepinephrine", "epinephrine"]


@query("h2_dose_columns", views="obs meds", cte=DOSE, sql="SELECT encounter_block, count(*) AS n_doses, " + ", ".join(
    f"round(quantile_cont(d, {q}) FILTER (med_category = '{m}'), 10) AS {m}_{n}" for m in VASO for n, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75)))
    + " FROM st WHERE status = 'success' AND med_category IN ('norepinephrine', 'epinephrine') GROUP BY 1")
def h2(spark, sf):
    d = M.dose_columns(preferred(spark, sf), VASO, dose="dose_converted")
    return rnd(d, [c for c in d.columns if c not in (BLOCK, "n_doses")], 10)


HR = """ic AS (SELECT encounter_block, min(in_dttm) AS i FROM stay WHERE location_category = 'icu' GROUP BY 1),
  mh AS (SELECT m.*, (epoch_us(admin_dttm) - epoch_us(i)) / 3600000000.0::DOUBLE AS h FROM meds m JOIN ic USING (encounter_block)),
  wk AS (SELECT *, CAST(floor(h) AS INTEGER) AS hb FROM mh WHERE floor(h) BETWEEN 0 AND 167)"""


def hourly(spark, sf):
    return M.with_icu_hour(V.meds(spark, sf), J.first_icu_stay(V.stay(spark, sf)))


def n_icu(spark, sf):
    return J.first_icu_stay(V.stay(spark, sf)).agg(F.count(F.lit(1)).alias("n_icu"))


@query("h3_icu_hour", views="stay meds", cte=HR, sql="SELECT event_id, round(h, 6) AS hours_from_icu, CAST(floor(h) AS INTEGER) AS hour_bin FROM mh")
def h3(spark, sf):
    return hourly(spark, sf).select("event_id", F.round("hours_from_icu", 6).alias("hours_from_icu"), "hour_bin")


@query("h4_hourly_exposure", views="stay meds", cte=HR + ", gr AS (SELECT unnest(range(168)) AS hour), dr AS (SELECT unnest([" + ", ".join(f"'{d}'" for d in DRUGS) + "]) AS medication)",
       sql="""SELECT CAST(hour AS INTEGER) AS hour, medication, count(DISTINCT encounter_block) AS n, round(count(DISTINCT encounter_block) * 100.0::DOUBLE / (SELECT count(*) FROM ic), 6) AS pct
  FROM gr CROSS JOIN dr LEFT JOIN wk ON hb = hour AND med_category = medication GROUP BY 1, 2""")
def h4(spark, sf):
    return rnd(M.hourly_exposure(hourly(spark, sf), n_icu(spark, sf), GROUPS), ["pct"])


@query("h5_hourly_dose", views="stay meds", cte=HR, sql="""SELECT hb AS hour_bin, med_category AS med_lower, count(med_dose) AS n, round(quantile_cont(med_dose, 0.5), 6) AS median_dose
  FROM wk WHERE med_category IN ('norepinephrine', 'propofol') GROUP BY 1, 2""")
def h5(spark, sf):
    return rnd(M.hourly_dose(hourly(spark, sf), ["norepinephrine", "propofol"]), ["median_dose"])


@query("h6_drug_summary", views="stay meds", cte=HR + """, uc AS (SELECT med_category, med_dose_unit, count(*) AS c FROM wk WHERE med_dose_unit IS NOT NULL GROUP BY ALL),
  um AS (SELECT med_category, first(med_dose_unit ORDER BY c DESC, med_dose_unit) AS dose_unit FROM uc GROUP BY 1)""",
       sql="""SELECT med_category AS medication, CASE WHEN med_category = 'propofol' THEN 'Sedation' ELSE 'Vasoactives' END AS "group", count(DISTINCT encounter_block) AS n_encounters,
  count(med_dose) AS n_admin, round(count(DISTINCT encounter_block) * 100.0::DOUBLE / (SELECT count(*) FROM ic), 6) AS pct_encounters, round(quantile_cont(med_dose, 0.5), 6) AS median_dose,
  round(quantile_cont(med_dose, 0.25), 6) AS q1_dose, round(quantile_cont(med_dose, 0.75), 6) AS q3_dose, any_value(dose_unit) AS dose_unit FROM wk JOIN um USING (med_category) GROUP BY 1, 2""")
def h6(spark, sf):
    return rnd(M.drug_summary(hourly(spark, sf), n_icu(spark, sf), GROUPS), ["pct_encounters", "median_dose", "q1_dose", "q3_dose"])


def reg(n, continuous, inter, sql, fn):
    """Each table report for the continuous and for the intermittent table."""
    query(f"{continuous}_{n}", views="meds", sql=sql.replace("{t}", "meds"))(lambda spark, sf: fn(V.meds(spark, sf)))
    query(f"{inter}_{n}_intermittent", views="meds", sql=sql.replace("{t}", INTER))(lambda spark, sf: fn(intermittent(spark, sf)))


reg("group_exposure", "h7", "h14", """SELECT med_group, med_category, count(DISTINCT hospitalization_id) AS hospitalizations, count(*) AS administrations,
  CASE WHEN grouping(med_category) = 1 THEN round(count(DISTINCT hospitalization_id) * 100.0::DOUBLE / (SELECT count(DISTINCT hospitalization_id) FROM {t}), 2) END AS pct
  FROM {t} WHERE med_group IS NOT NULL GROUP BY GROUPING SETS ((med_group), (med_group, med_category))""", M.group_exposure)


def _stat(p, c):
    return (f"count({c}) AS {p}_count, round(avg({c}), 5) AS {p}_mean, round(stddev_samp({c}), 5) AS {p}_std, min({c}) AS {p}_min, max({c}) AS {p}_max, "
            f"round(quantile_cont({c}, 0.5), 5) AS {p}_median, round(quantile_cont({c}, 0.25), 5) AS {p}_q25, round(quantile_cont({c}, 0.75), 5) AS {p}_q75")


def _h8(m):
    d = M.dose_distributions(m, 1.0, 120.0)
    return rnd(d, [c for c in d.columns if c.endswith(("_mean", "_std", "_median", "_q25", "_q75"))], 5)


reg("dose_distributions", "h8", "h14", f"""SELECT med_category, med_dose_unit, {_stat('raw', 'med_dose')}, {_stat('clean', 'c')}, count(*) - count(c) AS outlier_count
  FROM (SELECT *, CASE WHEN med_dose BETWEEN 1 AND 120 THEN med_dose END AS c FROM {{t}} WHERE med_dose IS NOT NULL AND med_dose_unit IS NOT NULL) GROUP BY 1, 2""", _h8)

reg("dose_table", "h9", "h14", """SELECT med_category, med_dose_unit, count(*) AS count, round(min(med_dose), 5) AS min, round(max(med_dose), 5) AS max, round(avg(med_dose), 5) AS mean,
  round(stddev_samp(med_dose), 5) AS stddev, round(quantile_cont(med_dose, 0.5), 5) AS median, round(quantile_cont(med_dose, 0.25), 5) AS q1, round(quantile_cont(med_dose, 0.75), 5) AS q3
  FROM {t} WHERE med_dose IS NOT NULL AND med_dose_unit IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 5""", lambda m: M.dose_table(m, digits=5))

reg("dose_histograms", "h10", "h14", """SELECT * FROM (WITH v AS (SELECT * FROM {t} WHERE med_dose_unit IS NOT NULL),
  b AS (SELECT med_category, med_dose_unit, quantile_cont(med_dose, 0.25) AS q1, quantile_cont(med_dose, 0.75) AS q3, min(med_dose) AS mn, max(med_dose) AS mx FROM v GROUP BY 1, 2
    ORDER BY count(*) DESC, med_category, med_dose_unit LIMIT 6),
  r AS (SELECT *, greatest(mn, q1 - 1.5::DOUBLE * (q3 - q1)) AS lo, least(mx, q3 + 1.5::DOUBLE * (q3 - q1)) AS hi FROM b)
  SELECT med_category, med_dose_unit, CAST(least(floor((med_dose - lo) / ((hi - lo) / 50)), 49) AS INTEGER) AS bin, count(*) AS n, min(med_dose) AS bin_min, max(med_dose) AS bin_max
  FROM v JOIN r USING (med_category, med_dose_unit) WHERE med_dose BETWEEN q1 - 1.5::DOUBLE * (q3 - q1) AND q3 + 1.5::DOUBLE * (q3 - q1) GROUP BY 1, 2, 3)""", lambda m: M.dose_histograms(m, 6))

reg("name_mappings", "h11", "h14", """SELECT med_name, med_category, count(*) AS frequency, count(DISTINCT hospitalization_id) AS unique_hospitalizations FROM {t} GROUP BY 1, 2""", M.name_mappings)

reg("group_administrations", "h12", "h14", """SELECT med_group, count(*) AS exposed_hosps, round(count(*) * 100.0::DOUBLE / (SELECT count(DISTINCT hospitalization_id) FROM {t}), 2) AS percentage,
  CAST(round_even(avg(n), 0) AS INTEGER) AS avg_administrations, CAST(round_even(quantile_cont(n, 0.5), 0) AS INTEGER) AS median_administrations, min(n) AS min_administrations, max(n) AS max_administrations
  FROM (SELECT hospitalization_id, med_group, count(*) AS n FROM {t} GROUP BY 1, 2) GROUP BY 1
  UNION ALL SELECT 'TOTAL_HOSPITALIZATIONS', count(DISTINCT hospitalization_id), 100.0::DOUBLE, NULL, NULL, NULL, NULL FROM {t}""", M.group_administrations)

reg("medication_summary", "h13", "h14", """SELECT 'basic' AS section, 'total_records' AS item, count(*) AS value FROM {t} UNION ALL SELECT 'basic', 'unique_hospitalizations', count(DISTINCT hospitalization_id) FROM {t}
  UNION ALL SELECT 'basic', 'unique_categories', count(DISTINCT med_category) FROM {t} UNION ALL SELECT 'basic', 'unique_groups', count(DISTINCT med_group) FROM {t}
  UNION ALL SELECT * FROM (SELECT 'top_groups', med_group, count(DISTINCT hospitalization_id) AS v FROM {t} GROUP BY 2 ORDER BY v DESC, med_group LIMIT 3)
  UNION ALL SELECT * FROM (SELECT 'top_medications', med_category, count(DISTINCT hospitalization_id) AS v FROM {t} GROUP BY 2 ORDER BY v DESC, med_category LIMIT 5)
  UNION ALL SELECT 'multi_unit', 'medications', count(*) FROM (SELECT med_category FROM {t} WHERE med_dose_unit IS NOT NULL GROUP BY 1 HAVING count(DISTINCT med_dose_unit) > 1)""", M.medication_summary)
