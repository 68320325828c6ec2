"""Per-table summaries (M)."""

from pyspark.sql import functions as F

from bedside.operators import summary as U
from bedside.plans import views as V
from bedside.plans.on_resp import rnd
from bedside.plans.on_severity import CCI, cci
from bedside.plans.registry import query

H = "hospitalization_id"


def fig(section, src, **items):
    """SQL rows of named figures."""
    return " UNION ALL ".join(f"SELECT '{section}' AS section, '{n}' AS item, ({e})::DOUBLE AS value, NULL::DOUBLE AS pct FROM {src}" for n, e in items.items())


def lev(section, src, col, top=None, by=None):
    n = "count(*)" if by is None else f"count(DISTINCT {by})"
    lim = f" ORDER BY 3 DESC, 2 LIMIT {top}" if top else ""
    return (f"SELECT * FROM (SELECT '{section}' AS section, CAST({col} AS VARCHAR) AS item, {n}::DOUBLE AS value, round({n} * 100.0::DOUBLE / (SELECT {n} FROM {src}), 2) AS pct FROM {src} "
            f"WHERE {col} IS NOT NULL GROUP BY {col}{lim})")


def num(section, src, c, **extra):
    return fig(section, src, count=f"count({c})", mean=f"avg({c})", std=f"stddev_samp({c})", min=f"min({c})", max=f"max({c})", **extra,
               q1=f"quantile_cont({c}, 0.25)", median=f"quantile_cont({c}, 0.5)", q3=f"quantile_cont({c}, 0.75)")


def div(section, src, col):
    return fig(section, f"(SELECT {H}, count(DISTINCT {col}) AS k FROM {src} GROUP BY 1)", single="count(*) FILTER (k = 1)", multiple="count(*) FILTER (k > 1)", most="max(k)")


def hours(src, ts):
    return f"SELECT 'hour', CAST(hour({ts}) AS VARCHAR), count(*)::DOUBLE, NULL FROM {src} WHERE {ts} IS NOT NULL GROUP BY hour({ts})"


def wrap(*parts):
    return "SELECT section, item, round(value, 5) AS value, pct FROM (" + " UNION ALL ".join(parts) + ")"


def tidy(d):
    d = d if "pct" in d.columns else d.withColumn("pct", F.lit(None).cast("double"))
    return rnd(d, ["value"], 5)


LABS = """lb AS (SELECT encounter_block AS hospitalization_id, category AS lab_category, CASE WHEN setting < 40 THEN 'chem' WHEN setting < 80 THEN 'heme' END AS lab_order_category,
    CASE WHEN setting > 10 THEN 'blood' END AS lab_specimen_category, CASE WHEN value < 100 THEN 'x' END AS lab_value, CASE WHEN value < 80 THEN value END AS lab_value_numeric,
    recorded_dttm AS lab_order_dttm, recorded_dttm + to_minutes(CAST(setting AS INTEGER) - 20) AS lab_result_dttm FROM obs),
  ta AS (SELECT (epoch_us(lab_result_dttm) - epoch_us(lab_order_dttm)) / 3600000000.0::DOUBLE AS h FROM lb WHERE lab_result_dttm > lab_order_dttm)"""


@query("m1_labs_summary", views="obs", cte=LABS, sql=wrap(
    fig("basic", "lb", records="count(*)", hospitalizations=f"count(DISTINCT {H})", categories="count(DISTINCT lab_category)", order_categories="count(DISTINCT lab_order_category)"),
    lev("order_category", "lb", "lab_order_category"), lev("top_labs", "lb", "lab_category", 10),
    fig("results", "lb", numeric="count(lab_value_numeric)", text_only="count(*) FILTER (lab_value IS NOT NULL AND lab_value_numeric IS NULL)", missing="count(*) FILTER (lab_value IS NULL)"),
    fig("specimen", "lb", types="count(DISTINCT lab_specimen_category)", **{"with": "count(lab_specimen_category)", "without": "count(*) - count(lab_specimen_category)"}),
    fig("turnaround", "ta", mean_hours="avg(h)", median_hours="quantile_cont(h, 0.5)")))
def m1(spark, sf):
    s, v, t = F.col("setting"), F.col("value"), F.col("recorded_dttm")
    lb = V.obs(spark, sf).select(
        F.col("encounter_block").alias(H), F.col("category").alias("lab_category"), F.when(s < 40, "chem").when(s < 80, "heme").alias("lab_order_category"),
        F.when(s > 10, "blood").alias("lab_specimen_category"), F.when(v < 100, "x").alias("lab_value"), F.when(v < 80, v).alias("lab_value_numeric"), t.alias("lab_order_dttm"),
        F.timestamp_micros(F.unix_micros(t) + (s.cast("long") - 20) * F.lit(60_000_000)).alias("lab_result_dttm"))
    return tidy(U.labs_summary(lb))


VIT = "vt AS (SELECT encounter_block AS hospitalization_id, recorded_dttm, category AS vital_category, CASE WHEN value < 100 THEN value END AS vital_value FROM obs)"


@query("m2_vitals_summary", views="obs", cte=VIT, sql=wrap(
    fig("basic", "vt", records="count(*)", hospitalizations=f"count(DISTINCT {H})", types="count(DISTINCT vital_category)"), lev("top_vitals", "vt", "vital_category", 5),
    fig("recording", "vt", days="count(DISTINCT CAST(recorded_dttm AS DATE))", per_hospitalization=f"count(*)::DOUBLE / count(DISTINCT {H})"),
    fig("missing", "vt", values="count(*) - count(vital_value)", percent="(count(*) - count(vital_value)) * 100.0::DOUBLE / count(*)"), hours("vt", "recorded_dttm")))
def m2(spark, sf):
    v = V.obs(spark, sf).select(F.col("encounter_block").alias(H), "recorded_dttm", F.col("category").alias("vital_category"), F.when(F.col("value") < 100, F.col("value")).alias("vital_value"))
    return tidy(U.vitals_summary(v))


@query("m3_respiratory_summary", views="obs resp", cte="rs AS (SELECT encounter_block AS hospitalization_id, * FROM resp)", sql=wrap(
    fig("basic", "rs", records="count(*)", hospitalizations=f"count(DISTINCT {H})", devices="count(DISTINCT device_category)", modes="count(DISTINCT mode_category)"),
    lev("top_modes", "rs", "mode_category", 5, H), lev("top_devices", "rs", "device_category", 5), div("mode_diversity", "rs", "mode_category"),
    fig("oxygen", "rs", lpm_set_n="count(lpm_set)", lpm_set_mean="avg(lpm_set)", fio2_set_n="count(fio2_set)", fio2_set_mean="avg(fio2_set)")))
def m3(spark, sf):
    return tidy(U.respiratory_summary(V.resp(spark, sf).withColumn(H, F.col("encounter_block"))))


POS = """ps AS (SELECT encounter_block AS hospitalization_id, event_id, recorded_dttm, CASE WHEN category = 'error' THEN 'prone' WHEN category <> 'click' THEN 'not_prone' END AS position_category FROM obs),
  pn AS (SELECT *, (epoch_us(lead(recorded_dttm) OVER (PARTITION BY hospitalization_id ORDER BY recorded_dttm, event_id)) - epoch_us(recorded_dttm)) / 3600000000.0::DOUBLE AS h FROM ps),
  pc AS (SELECT hospitalization_id, count(*) AS k FROM ps GROUP BY 1)"""


@query("m4_position_summary", views="obs", cte=POS, sql=wrap(
    fig("basic", "ps", records="count(*)", hospitalizations=f"count(DISTINCT {H})", positions="count(DISTINCT position_category)"), lev("positions", "ps", "position_category"),
    fig("changes", "pc", mean="avg(k)", most="max(k)", median="quantile_cont(k, 0.5)"), fig("duration", "pn", mean_hours="avg(h)", median_hours="quantile_cont(h, 0.5)"),
    fig("prone", "ps", hospitalizations=f"count(DISTINCT {H}) FILTER (position_category = 'prone')", records="count(*) FILTER (position_category = 'prone')",
        percent=f"count(DISTINCT {H}) FILTER (position_category = 'prone') * 100.0::DOUBLE / count(DISTINCT {H})"),
    fig("missing", "ps", records="count(*) - count(position_category)", percent="(count(*) - count(position_category)) * 100.0::DOUBLE / count(*)"),
    div("diversity", "ps", "position_category"), hours("ps", "recorded_dttm")))
def m4(spark, sf):
    c = F.col("category")
    p = V.obs(spark, sf).select(F.col("encounter_block").alias(H), "event_id", "recorded_dttm", F.when(c == "error", "prone").when(c != "click", "not_prone").alias("position_category"))
    return tidy(U.position_summary(p, "event_id"))


AGE = dict(adults="count(*) FILTER (age_at_admission >= 18)", children="count(*) FILTER (age_at_admission < 18)")


@query("m5_hospitalization_summary", views="hosp", cte="hs AS (SELECT *, (epoch_us(discharge_dttm) - epoch_us(admission_dttm)) / 86400000000.0::DOUBLE AS los FROM hosp)", sql=wrap(
    fig("basic", "hs", hospitalizations=f"count(DISTINCT {H})", patients="count(DISTINCT patient_id)"), num("age", "hs", "age_at_admission", **AGE), num("stay", "hs", "los"),
    lev("discharge", "hs", "discharge_category", 5), lev("admission_type", "hs", "admission_type_category", 3)))
def m5(spark, sf):
    return tidy(U.hospitalization_summary(V.hosp(spark, sf)))


@query("m6_patient_summary", views="hosp patient", cte="""pd AS (SELECT *, CASE WHEN balance < 1000 THEN TIMESTAMP '2000-01-01' END AS death_dttm FROM patient),
  pa AS (SELECT age_at_admission FROM pd LEFT JOIN hosp USING (patient_id))""", sql=wrap(
    fig("basic", "pd", patients="count(DISTINCT patient_id)"), lev("sex", "pd", "sex_category"), lev("race", "pd", "race_category", 3), lev("ethnicity", "pd", "ethnicity_category"),
    num("age", "pa", "age_at_admission", **AGE), fig("deaths", "pd", count="count(death_dttm)", percent="count(death_dttm) * 100.0::DOUBLE / count(*)")))
def m6(spark, sf):
    p = V.patient(spark, sf).withColumn("death_dttm", F.when(F.col("balance") < 1000, F.lit("2000-01-01").cast("timestamp")))
    return tidy(U.patient_summary(p, V.hosp(spark, sf)))


@query("m7_adt_summary", views="stay", cte="""sa AS (SELECT encounter_block * 100 + day(in_dttm) AS hospitalization_id, *, (epoch_us(out_dttm) - epoch_us(in_dttm)) / 3600000000.0::DOUBLE AS h FROM stay),
  p AS (SELECT hospitalization_id, max(CASE WHEN location_category = 'icu' THEN 1 ELSE 0 END) AS i, max(CASE WHEN location_category = 'ed' THEN 1 ELSE 0 END) AS e,
    max(CASE WHEN location_category = 'ward' THEN 1 ELSE 0 END) AS w, max(CASE WHEN location_category NOT IN ('icu', 'ed', 'ward') THEN 1 ELSE 0 END) AS o FROM sa GROUP BY 1)""", sql=wrap(
    fig("encounters", "p", icu_hospitalizations="sum(i)", icu_only_hospitalizations="count(*) FILTER (i = 1 AND e + w + o = 0)", ed_only_hospitalizations="count(*) FILTER (e = 1 AND i + w + o = 0)",
        ward_only_hospitalizations="count(*) FILTER (w = 1 AND i + e + o = 0)", total_hospitalizations="count(*)"),
    num("duration_hours", "(SELECT h FROM sa WHERE h IS NOT NULL)", "h"), lev("location", "sa", "location_category"),
    fig("icu", "(SELECT * FROM sa WHERE location_category = 'icu')", events="count(*)", hospitalizations=f"count(DISTINCT {H})")))
def m7(spark, sf):
    return tidy(U.adt_summary(V.stay(spark, sf).withColumn(H, F.col("encounter_block") * 100 + F.dayofmonth("in_dttm"))))


@query("m8_diagnosis_summary", views="dx", cte=CCI + """, k AS (SELECT hospitalization_id, count(*) AS k FROM dx GROUP BY 1),
  tc AS (SELECT diagnosis_code AS item, count(*) AS r, count(DISTINCT hospitalization_id) AS v FROM dx GROUP BY 1 ORDER BY r DESC, item LIMIT 20),
  bd AS (SELECT CASE WHEN cci_score <= 0 THEN '0 (No comorbidity)' WHEN cci_score <= 2 THEN '1-2 (Mild)' WHEN cci_score <= 4 THEN '3-4 (Moderate)' ELSE '5+ (Severe)' END AS band FROM cci)""", sql=wrap(
    fig("basic", "dx", diagnoses="count(*)", hospitalizations=f"count(DISTINCT {H})", codes="count(DISTINCT diagnosis_code)"), lev("format_rows", "dx", "diagnosis_code_format"),
    lev("format_hospitalizations", "dx", "diagnosis_code_format", None, H), f"SELECT 'top_codes', item, v::DOUBLE, round(v * 100.0::DOUBLE / (SELECT count(DISTINCT {H}) FROM dx), 2) FROM tc",
    fig("per_hospitalization", "k", mean="avg(k)", most="max(k)", median="quantile_cont(k, 0.5)"),
    fig("comorbidity_index", "dx", icd10_rows="count(*) FILTER (diagnosis_code_format = 'ICD10CM')", percent="count(*) FILTER (diagnosis_code_format = 'ICD10CM') * 100.0::DOUBLE / count(*)"),
    lev("comorbidity_band", "bd", "band")))
def m8(spark, sf):
    return tidy(U.diagnosis_summary(V.dx(spark, sf), cci(spark, sf)))
