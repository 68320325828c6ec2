"""Scores, dose conversion, comorbidity, sepsis (G)."""

from pyspark.sql import functions as F

from bedside.functions.expr import micros
from bedside.operators import clean as C
from bedside.operators import journey as J
from bedside.operators import severity as S
from bedside.plans import views as V
from bedside.plans.on_resp import rnd
from bedside.plans.registry import query
from bedside.operators import resp as R

BLOCK = "encounter_block"

ICU = """icu AS (SELECT encounter_block, min(in_dttm) AS s, min(in_dttm) + INTERVAL 24 HOUR AS e FROM stay WHERE location_category = 'icu' GROUP BY 1)"""


def icu_cohort(spark, sf, hours=24):
    return S.score_cohort(J.first_icu_stay(V.stay(spark, sf)), hours)


@query("g1_score_cohort", views="stay", cte=ICU, sql="SELECT encounter_block, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM icu")
def g1(spark, sf):
    return icu_cohort(spark, sf).select(BLOCK, micros("start_dttm").alias("start_us"), micros("end_dttm").alias("end_us"))


@query("g2_windowed_values", views="obs stay", cte=ICU, sql="""SELECT event_id, category, value FROM obs JOIN icu USING (encounter_block)
  WHERE recorded_dttm BETWEEN s AND e AND category IN ('view', 'click')""")
def g2(spark, sf):
    return S.windowed_values(V.obs(spark, sf), icu_cohort(spark, sf), "recorded_dttm", "category", ["view", "click"]).select(
        "event_id", "category", "value")


@query("g3_value_from_text", sql="""SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN CAST(user_id AS DOUBLE) END AS value FROM events""")
def g3(spark, sf):
    k = F.col("event_id") % 3
    e = V.table(spark, sf, "events").select("event_id", F.when(k == 0, F.col("value")).alias("numerical_value"),
                                            F.when(k == 1, F.concat(F.lit(" "), "user_id")).when(k == 2, "not done").alias("categorical_value"))
    return e.select("event_id", C.value_from_text("numerical_value", "categorical_value").alias("value"))


@query("g4_unit_text", views="meds", sql="""SELECT CASE med_dose_unit WHEN 'MCG / kg / Hour' THEN 'mcg/kg/hr' WHEN 'units/min' THEN 'u/min' ELSE med_dose_unit END AS unit,
  count(*) AS n FROM meds GROUP BY 1""")
def g4(spark, sf):
    return V.meds(spark, sf).groupBy(S.clean_unit("med_dose_unit").alias("unit")).agg(F.count(F.lit(1)).alias("n"))


DOSE = """w AS (SELECT encounter_block, recorded_dttm AS wt, 40 + setting AS weight_kg FROM obs WHERE category = 'click'),
  jm AS (SELECT m.*, weight_kg FROM meds m ASOF LEFT JOIN w ON m.encounter_block = w.encounter_block AND m.admin_dttm >= w.wt),
  cv AS (SELECT *, CASE med_dose_unit WHEN 'mg/hr' THEN med_dose * 1000 / 60 / weight_kg WHEN 'mcg/kg/min' THEN med_dose
    WHEN 'MCG / kg / Hour' THEN med_dose / 60 ELSE med_dose / weight_kg END AS d,
    CASE med_dose_unit WHEN 'MCG / kg / Hour' THEN 'mcg/kg/hr' WHEN 'units/min' THEN 'u/min' ELSE med_dose_unit END AS unit FROM jm),
  st AS (SELECT *, CASE WHEN med_category NOT IN ('norepinephrine', 'epinephrine', 'dopamine') THEN 'not_requested' WHEN unit IS NULL THEN 'missing_unit'
    WHEN unit = 'u/min' THEN 'unrecognized_unit' WHEN unit = 'mg/hr' AND weight_kg IS NULL THEN 'missing_weight' ELSE 'success' END AS status FROM cv)"""


def converted(spark, sf):
    w = V.obs(spark, sf).where("category = 'click'").select(BLOCK, "recorded_dttm", (40 + F.col("setting")).alias("weight_kg"))
    return S.convert_doses(V.meds(spark, sf), w)


def preferred(spark, sf):
    return S.to_preferred_unit(converted(spark, sf), ["norepinephrine", "epinephrine", "dopamine"])


@query("g5_dose_conversion", views="obs meds", cte=DOSE, sql="SELECT event_id, round(d, 10) AS dose_mcg_kg_min FROM cv")
def g5(spark, sf):
    return converted(spark, sf).select("event_id", F.round("dose_mcg_kg_min", 10).alias("dose_mcg_kg_min"))


@query("g6_preferred_unit", views="obs meds", cte=DOSE, sql="SELECT event_id, status AS convert_status, round(CASE WHEN status = 'success' THEN d ELSE med_dose END, 10) AS dose_converted FROM st")
def g6(spark, sf):
    return preferred(spark, sf).select("event_id", "convert_status", F.round("dose_converted", 10).alias("dose_converted"))


@query("g6_conversion_counts", views="obs meds", cte=DOSE, sql="SELECT med_category, unit, status AS convert_status, count(*) AS n FROM st GROUP BY ALL")
def g6c(spark, sf):
    return S.conversion_counts(preferred(spark, sf))


# one long table of score inputs: categories by event type and setting
INPUT = """inp AS (SELECT encounter_block, event_id, recorded_dttm, CASE category WHEN 'view' THEN CASE WHEN setting < 50 THEN 'creatinine' ELSE 'platelet_count' END
    WHEN 'click' THEN CASE WHEN setting < 50 THEN 'bilirubin_total' ELSE 'po2_arterial' END WHEN 'error' THEN CASE WHEN setting < 50 THEN 'map' ELSE 'spo2' END
    WHEN 'purchase' THEN CASE WHEN setting < 50 THEN 'norepinephrine' ELSE 'gcs_total' END ELSE CASE WHEN setting < 50 THEN 'dopamine' ELSE 'dobutamine' END END AS category,
    CASE category WHEN 'view' THEN CASE WHEN setting < 50 THEN value / 20 ELSE value * 2 END WHEN 'click' THEN CASE WHEN setting < 50 THEN value / 10 ELSE value * 3 END
    WHEN 'error' THEN CASE WHEN setting < 50 THEN 50 + value / 4 ELSE 60 + setting / 2 END WHEN 'purchase' THEN CASE WHEN setting < 50 THEN value / 400 ELSE 3 + CAST(setting AS INT) % 13 END
    ELSE value / 10 END AS value FROM obs),
  lim AS (SELECT * REPLACE (CASE WHEN category = 'po2_arterial' AND NOT value BETWEEN 0 AND 700 THEN NULL WHEN category = 'spo2' AND NOT value BETWEEN 50 AND 100
    THEN NULL ELSE value END AS value) FROM inp)"""


def inputs(spark, sf):
    return inputs_of(V.obs(spark, sf))


def inputs_of(o):
    c, s, v, low = F.col("category"), F.col("setting"), F.col("value"), F.col("setting") < 50
    pair = lambda a, b: F.when(low, a).otherwise(b)
    cat = (F.when(c == "view", pair("creatinine", "platelet_count")).when(c == "click", pair("bilirubin_total", "po2_arterial"))
           .when(c == "error", pair("map", "spo2")).when(c == "purchase", pair("norepinephrine", "gcs_total"))
           .otherwise(pair("dopamine", "dobutamine")))
    val = (F.when(c == "view", pair(v / 20, v * 2)).when(c == "click", pair(v / 10, v * 3)).when(c == "error", pair(50 + v / 4, 60 + s / 2))
           .when(c == "purchase", pair(v / 400, (3 + s.cast("int") % 13).cast("double"))).otherwise(v / 10))
    return o.select(BLOCK, "event_id", "recorded_dttm", cat.alias("category"), val.alias("value"))


@query("g7_input_limits", views="obs", cte=INPUT, sql="SELECT category, count(*) AS n, count(value) AS n_valid, round(sum(value), 3) AS total FROM lim GROUP BY 1")
def g7(spark, sf):
    return S.limit_inputs(inputs(spark, sf)).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("n_valid"), F.round(F.sum("value"), 3).alias("total"))


HIGH, LOW = S.WORST_HIGH, S.WORST_LOW
WORST = "encounter_block, event_day, " + ", ".join([f"max(value) FILTER (category = '{c}') AS {c}" for c in HIGH] + [f"min(value) FILTER (category = '{c}') AS {c}" for c in LOW])
WORST_CTE = INPUT + f""", worst AS (SELECT {WORST} FROM (SELECT *, day(recorded_dttm) // 3 AS event_day FROM lim) GROUP BY 1, 2)"""
KEYS = [BLOCK, "event_day"]


def worst(spark, sf):
    d = inputs(spark, sf).withColumn("event_day", F.floor(F.dayofmonth("recorded_dttm") / 3))
    return S.worst_values(S.limit_inputs(d), KEYS)


@query("g8_worst_values", views="obs", cte=WORST_CTE, sql="SELECT encounter_block, event_day, " + ", ".join(f"round({c}, 6) AS {c}" for c in HIGH + LOW) + " FROM worst")
def g8(spark, sf):
    return rnd(worst(spark, sf), HIGH + LOW)


@query("g9_pao2_from_spo2", views="obs", cte="""s AS (SELECT event_id, 50 + setting / 2 AS spo2 FROM obs),
  x AS (SELECT *, 11700.0::DOUBLE / (100.0::DOUBLE / spo2 - 1) AS x FROM s WHERE spo2 < 97)""",
       sql="""SELECT event_id, round(pow(sqrt(x * x + 125000) + x, 1.0::DOUBLE / 3) - pow(sqrt(x * x + 125000) - x, 1.0::DOUBLE / 3), 5) AS pao2 FROM x
  UNION ALL SELECT event_id, NULL FROM s WHERE spo2 >= 97""")
def g9(spark, sf):
    s = V.obs(spark, sf).select("event_id", (50 + F.col("setting") / 2).alias("spo2"))
    return s.select("event_id", F.round(S.pao2_from_spo2("spo2"), 5).alias("pao2"))


PF = """l AS (SELECT encounter_block, event_id, recorded_dttm, value AS po2 FROM obs WHERE category IN ('view', 'error')),
  rf AS (SELECT encounter_block, recorded_dttm AS rt, fio2_set, device_category FROM resp),
  pf AS (SELECT l.*, fio2_set, device_category, po2 / fio2_set AS ratio FROM l ASOF JOIN rf ON l.encounter_block = rf.encounter_block AND l.recorded_dttm >= rf.rt
    WHERE epoch_us(l.recorded_dttm) - epoch_us(rt) <= 14400000000 AND fio2_set > 0),
  pw AS (SELECT *, row_number() OVER (PARTITION BY encounter_block ORDER BY ratio, recorded_dttm, event_id) AS rn, min(po2) OVER (PARTITION BY encounter_block) AS mp,
    max(fio2_set) OVER (PARTITION BY encounter_block) AS mf FROM pf)"""
RANK = "CASE device_category WHEN 'imv' THEN 1 WHEN 'nippv' THEN 2 WHEN 'high flow nc' THEN 4 WHEN 'nasal cannula' THEN 7 ELSE 9 END"


def ratio(spark, sf):
    labs = V.obs(spark, sf).where("category in ('view', 'error')").select(BLOCK, "event_id", "recorded_dttm", F.col("value").alias("po2_arterial"))
    return S.worst_ratio(R.pf_ratio(labs, V.resp(spark, sf), [BLOCK], "recorded_dttm"), "recorded_dttm")


@query("g10_worst_ratio", views="obs resp", cte=PF, sql=f"""SELECT encounter_block, round(ratio, 6) AS p_f, mp AS po2_at_ratio, round(mf, 6) AS fio2_set, device_category,
  {RANK} AS device_rank FROM pw WHERE rn = 1""")
def g10(spark, sf):
    return rnd(ratio(spark, sf), ["p_f", "fio2_set"])


SCORES = """CASE WHEN dopamine > 15 OR epinephrine > 0.1 OR norepinephrine > 0.1 THEN 4 WHEN dopamine > 5 OR epinephrine <= 0.1 OR norepinephrine <= 0.1 THEN 3
    WHEN dopamine <= 5 OR dobutamine > 0 THEN 2 WHEN map < 70 THEN 1 WHEN map >= 70 THEN 0 END AS sofa_cv_97,
  CASE WHEN platelet_count < 20 THEN 4 WHEN platelet_count < 50 THEN 3 WHEN platelet_count < 100 THEN 2 WHEN platelet_count < 150 THEN 1 WHEN platelet_count >= 150 THEN 0 END AS sofa_coag,
  CASE WHEN bilirubin_total >= 12 THEN 4 WHEN bilirubin_total >= 6 THEN 3 WHEN bilirubin_total >= 2 THEN 2 WHEN bilirubin_total >= 1.2 THEN 1 WHEN bilirubin_total < 1.2 THEN 0 END AS sofa_liver,
  CASE WHEN p_f < 100 AND device_category IN ('imv', 'nippv', 'cpap') THEN 4 WHEN p_f >= 100 AND p_f < 200 AND device_category IN ('imv', 'nippv', 'cpap') THEN 3
    WHEN p_f >= 200 AND p_f < 300 THEN 2 WHEN p_f >= 300 AND p_f < 400 THEN 1 WHEN p_f >= 400 THEN 0 END AS sofa_resp,
  CASE WHEN gcs_total < 6 THEN 4 WHEN gcs_total BETWEEN 6 AND 9 THEN 3 WHEN gcs_total BETWEEN 10 AND 12 THEN 2 WHEN gcs_total BETWEEN 13 AND 14 THEN 1 WHEN gcs_total = 15 THEN 0 END AS sofa_cns,
  CASE WHEN creatinine >= 5 THEN 4 WHEN creatinine >= 3.5 THEN 3 WHEN creatinine >= 2 THEN 2 WHEN creatinine >= 1.2 THEN 1 WHEN creatinine < 1.2 THEN 0 END AS sofa_renal"""
SOFA = WORST_CTE + "," + PF + f""", sr AS (SELECT w.*, ratio AS p_f, device_category FROM worst w LEFT JOIN (SELECT encounter_block, ratio, device_category FROM pw WHERE rn = 1) USING (encounter_block)),
  sc AS (SELECT encounter_block, event_day, {SCORES} FROM sr),
  sofa AS (SELECT *, coalesce(sofa_cv_97, 0) + coalesce(sofa_coag, 0) + coalesce(sofa_liver, 0) + coalesce(sofa_resp, 0) + coalesce(sofa_cns, 0) + coalesce(sofa_renal, 0) AS sofa_total FROM sc)"""


def sofa(spark, sf):
    return S.sofa_scores(worst(spark, sf).join(ratio(spark, sf).drop("po2_at_ratio"), BLOCK, "left"))


@query("g11_sofa_scores", views="obs resp", cte=SOFA, sql="SELECT * FROM sofa")
def g11(spark, sf):
    return sofa(spark, sf).select(*KEYS, *S.SUBSCORES, "sofa_total")


FULL = """rows AS (SELECT * FROM lim WHERE category NOT IN ('norepinephrine', 'dopamine', 'dobutamine')),
  coh AS (SELECT encounter_block, min(in_dttm) AS s, min(in_dttm) + INTERVAL 240 HOUR AS e FROM stay WHERE location_category = 'icu' GROUP BY 1),
  doses AS (SELECT cv.encounter_block, med_category AS category, d AS value FROM cv JOIN coh ON cv.encounter_block = coh.encounter_block AND admin_dttm BETWEEN s AND e
    WHERE med_category IN ('norepinephrine', 'epinephrine', 'dopamine')),
  lg AS (SELECT r.encounter_block, category, value FROM rows r JOIN coh ON r.encounter_block = coh.encounter_block AND recorded_dttm BETWEEN s AND e UNION ALL SELECT * FROM doses),
  w2 AS (SELECT encounter_block, """ + ", ".join([f"max(value) FILTER (category = '{c}') AS {c}" for c in HIGH] + [f"min(value) FILTER (category = '{c}') AS {c}" for c in LOW]) + """ FROM lg GROUP BY 1),
  pl AS (SELECT i.* FROM inp i JOIN coh ON i.encounter_block = coh.encounter_block AND recorded_dttm BETWEEN s AND e WHERE category = 'po2_arterial'),
  rr AS (SELECT r.encounter_block, recorded_dttm AS rt, fio2_set, device_category FROM resp r JOIN coh ON r.encounter_block = coh.encounter_block AND recorded_dttm BETWEEN s AND e),
  pr AS (SELECT pl.encounter_block, pl.event_id, pl.recorded_dttm, value / fio2_set AS ratio, device_category FROM pl ASOF JOIN rr ON pl.encounter_block = rr.encounter_block
    AND pl.recorded_dttm >= rt WHERE epoch_us(pl.recorded_dttm) - epoch_us(rt) <= 14400000000 AND fio2_set > 0),
  p1 AS (SELECT encounter_block, ratio AS p_f, device_category FROM (SELECT *, row_number() OVER (PARTITION BY encounter_block ORDER BY ratio, recorded_dttm, event_id) AS rn FROM pr) WHERE rn = 1),
  sr AS (SELECT * FROM w2 LEFT JOIN p1 USING (encounter_block)), sx AS (SELECT encounter_block, """ + SCORES + """ FROM sr)"""


@query("g11_sofa_full", views="obs resp meds stay", cte=INPUT + "," + DOSE + "," + FULL, sql="SELECT encounter_block, " + ", ".join(
    f"coalesce({c}, 0) AS {c}" for c in S.SUBSCORES) + ", " + " + ".join(f"coalesce({c}, 0)" for c in S.SUBSCORES) + " AS sofa_total FROM sx")
def g11f(spark, sf):
    i = inputs(spark, sf)
    labs = i.where(F.col("category").isin("creatinine", "platelet_count", "bilirubin_total", "po2_arterial"))
    vit, gcs = i.where(F.col("category").isin("map", "spo2")), i.where("category = 'gcs_total'")
    w = V.obs(spark, sf).where("category = 'click'").select(BLOCK, "recorded_dttm", (40 + F.col("setting")).alias("weight_kg"))
    return S.sofa(labs, vit, gcs, V.meds(spark, sf), w, V.resp(spark, sf), icu_cohort(spark, sf, 240)).select(BLOCK, *S.SUBSCORES, "sofa_total")


@query("g12_sofa_mortality", views="obs resp", cte=SOFA + """, mo AS (SELECT sofa_total AS sofa_score, count(*) AS n, count(*) FILTER ((encounter_block + event_day) % 4 = 0) AS k FROM sofa GROUP BY 1),
  mm AS (SELECT *, k / n::DOUBLE AS p, 3.8414588206941254::DOUBLE AS z2 FROM mo),
  mg AS (SELECT *, 1.959963984540054::DOUBLE * sqrt((p * (1 - p) + z2 / (4 * n)) / n) / (1 + z2 / n) * 100 AS m FROM mm)""",
       sql="""SELECT sofa_score, CAST((SELECT sum(n) FROM mo) AS BIGINT) AS total_encounters, n AS n_encounters, k AS n_deaths, round_even(p * 100, 2) AS mortality_rate_percent,
  round_even(greatest(p * 100 - m, 0), 2) AS ci_lower_95, round_even(least(p * 100 + m, 100), 2) AS ci_upper_95, round_even(m, 2) AS ci_margin_95 FROM mg""")
def g12(spark, sf):
    d = sofa(spark, sf).withColumn("death_enc", ((F.col(BLOCK) + F.col("event_day")) % 4 == 0).cast("int"))
    return S.sofa_mortality(d)


CCI = """px AS (SELECT * FROM (VALUES """ + ", ".join(f"('{p}', '{n}')" for n, (_, t) in S.CHARLSON.items() for p in t.split()) + """) t(prefix, condition)),
  ten AS (SELECT hospitalization_id, replace(diagnosis_code, '.', '') AS code FROM dx WHERE diagnosis_code_format = 'ICD10CM'),
  hit AS (SELECT DISTINCT hospitalization_id, condition FROM ten JOIN px ON starts_with(code, prefix)),
  c0 AS (SELECT t.hospitalization_id, """ + ", ".join(f"max(CASE WHEN condition = '{n}' THEN 1 ELSE 0 END) AS {n}" for n in S.CHARLSON) + """
    FROM (SELECT DISTINCT hospitalization_id FROM ten) t LEFT JOIN hit USING (hospitalization_id) GROUP BY 1),
  c1 AS (SELECT * REPLACE (diabetes_uncomplicated * (1 - diabetes_with_complications) AS diabetes_uncomplicated,
    mild_liver_disease * (1 - moderate_severe_liver_disease) AS mild_liver_disease, cancer * (1 - metastatic_cancer) AS cancer) FROM c0),
  cci AS (SELECT *, """ + " + ".join(f"{w} * {n}" for n, (w, _) in S.CHARLSON.items()) + """ AS cci_score FROM c1)"""


def cci(spark, sf):
    return S.charlson(V.dx(spark, sf), ["hospitalization_id"])


@query("g13_charlson", views="dx", cte=CCI, sql="SELECT * FROM cci")
def g13(spark, sf):
    return cci(spark, sf)


ENC_CCI = CCI + """, ec AS (SELECT patient_id AS encounter_block, """ + ", ".join(f"max({n}) AS {n}" for n in [*S.CHARLSON, "cci_score"]) + """
  FROM cci JOIN hosp USING (hospitalization_id) GROUP BY 1)"""


def enc_cci(spark, sf):
    m = V.hosp(spark, sf).select("hospitalization_id", F.col("patient_id").alias(BLOCK))
    return S.charlson_per_encounter(cci(spark, sf), m)


@query("g13_charlson_per_encounter", views="dx hosp", cte=ENC_CCI, sql="SELECT * FROM ec")
def g13e(spark, sf):
    return enc_cci(spark, sf)


@query("g14_cci_category", views="dx", cte=CCI, sql="""SELECT CASE WHEN cci_score <= 0 THEN '0 (No comorbidity)' WHEN cci_score <= 2 THEN '1-2 (Mild)'
  WHEN cci_score <= 4 THEN '3-4 (Moderate)' ELSE '5+ (Severe)' END AS cci_category, count(*) AS n FROM cci GROUP BY 1""")
def g14(spark, sf):
    return cci(spark, sf).groupBy(S.cci_category("cci_score").alias("cci_category")).agg(F.count(F.lit(1)).alias("n"))


ASE = """cu AS (SELECT DISTINCT encounter_block, CAST(recorded_dttm AS DATE) AS d FROM obs WHERE category = 'purchase'),
  dd AS (SELECT DISTINCT encounter_block, CAST(recorded_dttm AS DATE) AS d FROM obs WHERE category IN ('view', 'click')),
  df AS (SELECT DISTINCT encounter_block, CAST(recorded_dttm AS DATE) AS d FROM obs WHERE category = 'error' AND value > 60),
  dl AS (SELECT *, lag(d) OVER (PARTITION BY encounter_block ORDER BY d) AS p FROM dd),
  dr AS (SELECT *, sum(CASE WHEN p IS NULL OR date_diff('day', p, d) > 2 THEN 1 ELSE 0 END) OVER (PARTITION BY encounter_block ORDER BY d) AS r FROM dl),
  ru AS (SELECT encounter_block, r, min(d) AS s, max(d) AS e, count(*) AS n FROM dr GROUP BY ALL),
  ase AS (SELECT cu.encounter_block, cu.d, CASE WHEN EXISTS (SELECT 1 FROM ru WHERE ru.encounter_block = cu.encounter_block AND n >= 4 AND abs(date_diff('day', s, cu.d)) <= 2)
    AND EXISTS (SELECT 1 FROM df WHERE df.encounter_block = cu.encounter_block AND abs(date_diff('day', df.d, cu.d)) <= 2) THEN 1 ELSE 0 END AS sepsis FROM cu),
  ase2 AS (SELECT *, CASE WHEN sepsis = 1 THEN sum(sepsis) OVER (PARTITION BY encounter_block ORDER BY d) END AS ep FROM ase)"""


def sepsis(spark, sf):
    day = F.to_date("recorded_dttm")
    o = V.obs(spark, sf).withColumn("hospitalization_id", F.col(BLOCK))
    return S.adult_sepsis_events(
        o.where("category = 'purchase'").withColumn("culture_day", day),
        o.where("category in ('view', 'click')").withColumns({"dose_day": day, "drug": F.col("category")}),
        o.where("category = 'error' and value > 60").withColumn("dysfunction_day", day))


@query("g15_sepsis_events", views="obs", cte=ASE, sql="""SELECT encounter_block AS hospitalization_id, CAST(d AS VARCHAR) AS culture_day, sepsis, CAST(ep AS BIGINT) AS episode_id FROM ase2""")
def g15(spark, sf):
    return sepsis(spark, sf).withColumn("culture_day", F.col("culture_day").cast("string"))


SEP = ASE + """, en AS (SELECT encounter_block, count(*) FILTER (sepsis = 1) AS n FROM ase2 GROUP BY 1), al AS (SELECT u.encounter_block, coalesce(n, 0) AS n
  FROM (SELECT DISTINCT encounter_block FROM obs) u LEFT JOIN en USING (encounter_block))"""


def sep_enc(spark, sf):
    m = V.obs(spark, sf).select(BLOCK, F.col(BLOCK).alias("hospitalization_id")).distinct()
    return S.sepsis_counts(sepsis(spark, sf), m)


@query("g15_sepsis_counts", views="obs", cte=SEP, sql="SELECT encounter_block, n AS sepsis_events_by_sepsis_col, n AS sepsis_events_by_episode_id FROM al")
def g15c(spark, sf):
    return sep_enc(spark, sf)


@query("g15_sepsis_incidence", views="obs", cte=SEP, sql="""SELECT 'all' AS "group", count(*) AS n_encounters, count(*) FILTER (n > 0) AS n_sepsis,
  round_even(count(*) FILTER (n > 0) * 100.0::DOUBLE / count(*), 1) AS incidence_pct FROM al UNION ALL SELECT 'even', count(*), count(*) FILTER (n > 0),
  round_even(count(*) FILTER (n > 0) * 100.0::DOUBLE / count(*), 1) FROM al WHERE encounter_block % 2 = 0""")
def g15i(spark, sf):
    e = sep_enc(spark, sf).withColumn("even", (F.col(BLOCK) % 2 == 0).cast("int"))
    return S.sepsis_incidence(e, {"all": None, "even": "even"})


@query("g16_norepinephrine_equivalent", views="meds", cte="""hn AS (SELECT encounter_block, date_trunc('hour', admin_dttm) AS h, sum(CASE med_category WHEN 'norepinephrine' THEN 1.0::DOUBLE
  WHEN 'epinephrine' THEN 1.0::DOUBLE WHEN 'dopamine' THEN 0.01::DOUBLE WHEN 'vasopressin' THEN 2.5::DOUBLE ELSE 0.0::DOUBLE END * med_dose) AS nee FROM meds GROUP BY ALL)""",
       sql="SELECT encounter_block, round(max(nee), 5) AS nee_peak, round(quantile_cont(nee, 0.5), 5) AS nee_median FROM hn GROUP BY 1")
def g16(spark, sf):
    return rnd(S.norepinephrine_equivalent(V.meds(spark, sf)), ["nee_peak", "nee_median"], 5)


@query("g17_exposure_flags", views="blocks", sql="""SELECT encounter_block, max(CASE WHEN med_category = 'propofol' THEN 1 ELSE 0 END) AS crrt, max(CASE WHEN value > 200 THEN 1 ELSE 0 END) AS ecmo
  FROM blocks GROUP BY 1""")
def g17(spark, sf):
    b = V.blocks(spark, sf)
    return S.exposure_flags(b.select(BLOCK).distinct(), {"crrt": b.where("med_category = 'propofol'"), "ecmo": b.where("value > 200"), "absent": None})


