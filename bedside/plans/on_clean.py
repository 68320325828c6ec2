"""Filters, outliers, units and category grouping (B)."""

from pyspark.sql import functions as F

from bedside.functions.expr import norm, seconds_between
from bedside.operators import clean as C
from bedside.plans import views as V
from bedside.plans.registry import query


@query("b1_normalise_category", sql="""SELECT lower(trim('  ' || upper(event_type) || ' ')) AS category, count(*) AS n FROM events GROUP BY 1""")
def b1(spark, sf):
    e = V.table(spark, sf, "events").withColumn("raw", F.concat(F.lit("  "), F.upper("event_type"), F.lit(" ")))
    return e.groupBy(norm("raw").alias("category")).agg(F.count(F.lit(1)).alias("n"))


@query("b2_adult_filter", views="visit", sql="SELECT hospitalization_id, CAST(age_at_admission AS INTEGER) AS age_at_admission FROM visit WHERE age_at_admission >= 18")
def b2(spark, sf):
    return C.adults(V.visit(spark, sf)).select("hospitalization_id", "age_at_admission")


@query("b3_time_standardisation", sql="""SELECT o_orderkey, CASE WHEN strftime(timezone('US/Central', timezone('US/Central', w)), '%Y-%m-%d %H:%M:%S')
  = strftime(w, '%Y-%m-%d %H:%M:%S') THEN epoch_us(CASE WHEN timezone('US/Central', timezone('US/Central', w) - INTERVAL 1 HOUR) = w THEN timezone('US/Central', w) - INTERVAL 1 HOUR
    ELSE timezone('US/Central', w) END) END AS utc_us FROM
  (SELECT o_orderkey, o_orderdate + to_minutes(CAST(o_orderkey % 1440 AS INTEGER)) AS w FROM orders)""")
def b3(spark, sf):
    o = V.table(spark, sf, "orders").select("o_orderkey", (F.timestamp_micros(
        F.unix_micros("o_orderdate") + (F.col("o_orderkey") % 1440) * F.lit(60_000_000))).cast("timestamp_ntz").alias("wall"))
    d = C.standardize_times(o, "US/Central")
    return d.select("o_orderkey", F.unix_micros(F.col("wall").cast("timestamp")).alias("utc_us"))


@query("b4_elapsed_seconds", views="stay", sql="""SELECT event_id, round((epoch_us(out_dttm) - epoch_us(in_dttm)) / 1000000.0::DOUBLE, 3) AS seconds
  FROM stay WHERE out_dttm IS NOT NULL""")
def b4(spark, sf):
    return V.stay(spark, sf).where("out_dttm is not null").select(
        "event_id", F.round(seconds_between("in_dttm", "out_dttm"), 3).alias("seconds"))


RANGES = {"value": (5.0, 150.0), "setting": (None, 90.0)}
OUT = """SELECT 'value' AS "column", count(value) AS valid_count, count(*) FILTER (value < 5 OR value > 150) AS outlier_count,
    5.0::DOUBLE AS min_threshold, 150.0::DOUBLE AS max_threshold,
    round(count(*) FILTER (value < 5 OR value > 150) * 100.0::DOUBLE / count(value), 2) AS outlier_pct FROM obs
  UNION ALL SELECT 'setting', count(setting), count(*) FILTER (setting > 90), NULL, 90.0::DOUBLE,
    round(count(*) FILTER (setting > 90) * 100.0::DOUBLE / count(setting), 2) FROM obs"""


@query("b5_outlier_to_null", views="obs", sql="""SELECT event_id, CASE WHEN value BETWEEN 5 AND 150 THEN value END AS value,
  CASE WHEN setting <= 90 THEN setting END AS setting FROM obs""")
def b5(spark, sf):
    return C.null_outliers(V.obs(spark, sf), RANGES).select("event_id", "value", "setting")


@query("b5_outlier_statistics", views="obs", sql=OUT)
def b5s(spark, sf):
    return C.outlier_statistics(V.obs(spark, sf), RANGES)


@query("b6_outlier_by_category_unit", views="obs", sql="""SELECT event_id, CASE WHEN category = 'view' AND setting >= 50 AND NOT value BETWEEN 10 AND 60 THEN NULL
  WHEN category = 'error' AND NOT value BETWEEN 0 AND 80 THEN NULL ELSE value END AS value FROM obs""")
def b6(spark, sf):
    rules = C.range_table(spark, [("view", "mg/dl", 10.0, 60.0), ("error", None, 0.0, 80.0)])
    o = V.obs(spark, sf).withColumn("unit", F.when(F.col("setting") >= 50, " MG/dL").otherwise("mmol"))
    return C.null_outliers_by_category(o, rules, "value", "category", "unit").select("event_id", "value")


@query("b7_outlier_info", views="obs", sql=OUT.split("UNION ALL")[0])
def b7(spark, sf):
    return C.outlier_statistics(V.obs(spark, sf), {"value": RANGES["value"], "no_such_column": (0, 1)})


@query("b8_outlier_removal", views="obs", sql="""SELECT category, count(*) AS original, count(*) FILTER (NOT value BETWEEN 5 AND 150) AS removed,
  count(*) FILTER (value BETWEEN 5 AND 150) AS remaining FROM obs GROUP BY 1""")
def b8(spark, sf):
    return C.removal_counts(V.obs(spark, sf), "value", 5, 150, ["category"])


@query("b9_unit_predicate", sql="""SELECT count(*) AS n, round(sum(value), 3) AS total FROM events WHERE event_type IN ('view', 'click') OR event_type = 'error'""")
def b9(spark, sf):
    e = V.table(spark, sf, "events").withColumn("unit", F.when(F.col("event_type") == "view", "  ").when(
        F.col("event_type") == "click", F.lit(None)).when(F.col("event_type") == "error", " MG/dL ").otherwise("mmol/l"))
    return e.where(C.unit_is("unit", ["(no units)", "mg/dl"])).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 3).alias("total"))


@query("b10_simple_location", views="visit", sql="""SELECT CASE location_category WHEN 'icu' THEN 'ICU' WHEN 'ward' THEN 'Ward' WHEN 'ed' THEN 'ED'
  WHEN 'procedural' THEN 'Procedural' ELSE 'Other' END AS location, count(*) AS n FROM visit GROUP BY 1""")
def b10(spark, sf):
    return V.visit(spark, sf).withColumn("location_category", F.upper("location_category")).groupBy(
        C.simple_location("location_category").alias("location")).agg(F.count(F.lit(1)).alias("n"))


@query("b11_mode_group", views="obs resp", sql="""SELECT CASE mode_category WHEN 'assist control-volume control' THEN 'Assist Control-Volume Control'
  WHEN 'pressure support/cpap' THEN 'Pressure Support/CPAP' WHEN 'pressure control' THEN 'Pressure Control' ELSE 'Other' END AS mode_group,
  count(*) AS n FROM resp GROUP BY 1""")
def b11(spark, sf):
    return V.resp(spark, sf).groupBy(C.mode_group("mode_category").alias("mode_group")).agg(F.count(F.lit(1)).alias("n"))


@query("b12_admission_year", views="hosp", sql="SELECT patient_id, CAST(year(min(admission_dttm)) AS INTEGER) AS admission_year FROM hosp GROUP BY 1")
def b12(spark, sf):
    return C.admission_years(V.hosp(spark, sf), ["patient_id"])


@query("b13_drop_small_years", views="hosp", cte="ym AS (SELECT *, year(admission_dttm) * 1000 + dayofyear(admission_dttm) AS y FROM hosp), big AS (SELECT y FROM ym GROUP BY 1 HAVING count(DISTINCT hospitalization_id) >= 10)",
       sql="SELECT hospitalization_id, y AS admission_year FROM ym WHERE y IN (SELECT y FROM big)")
def b13(spark, sf):
    # the period here is the day, so that small periods occur
    h = V.hosp(spark, sf).withColumn("admission_year", (F.year("admission_dttm") * 1000 + F.dayofyear("admission_dttm")).cast("long"))
    return C.drop_small_years(h, "admission_year", "hospitalization_id").select("hospitalization_id", "admission_year")


@query("b14_first_row_per_encounter", views="blocks", sql="""SELECT encounter_block, hospitalization_id, value FROM (SELECT *, row_number() OVER
  (PARTITION BY encounter_block ORDER BY admission_dttm, hospitalization_id) AS rn FROM blocks) WHERE rn = 1""")
def b14(spark, sf):
    return C.first_row(V.blocks(spark, sf), ["encounter_block"], ["admission_dttm", "hospitalization_id"]).select(
        "encounter_block", "hospitalization_id", "value")


@query("b15_first_row_per_patient", views="hosp patient", sql="""SELECT patient_id, hospitalization_id, race_category, sex_category FROM
  (SELECT *, row_number() OVER (PARTITION BY h.patient_id ORDER BY admission_dttm, hospitalization_id) AS rn
   FROM hosp h JOIN patient p USING (patient_id)) WHERE rn = 1""")
def b15(spark, sf):
    d = V.hosp(spark, sf).join(V.patient(spark, sf), "patient_id")
    return C.first_row(d, ["patient_id"], ["admission_dttm", "hospitalization_id"]).select(
        "patient_id", "hospitalization_id", "race_category", "sex_category")


@query("b16_duplicate_count", views="hosp", sql="""SELECT CAST(sum(n) AS BIGINT) AS n_rows, CAST(sum(n - 1) AS BIGINT) AS duplicates FROM
  (SELECT count(*) AS n FROM hosp GROUP BY patient_id, year(admission_dttm))""")
def b16(spark, sf):
    return C.duplicate_count(V.hosp(spark, sf).withColumn("y", F.year("admission_dttm")), ["patient_id", "y"])


