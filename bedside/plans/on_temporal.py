"""Stitching, joins in time and windows (C)."""

from pyspark.sql import functions as F

from bedside.functions.expr import hours_between, micros
from bedside.operators import temporal as T
from bedside.plans import views as V
from bedside.plans.registry import query

US = micros


@query("c1_encounter_stitching", views="blocks",
       sql="SELECT hospitalization_id, encounter_block FROM blocks")
def c1(spark, sf):
    return V.blocks(spark, sf).select("hospitalization_id", "encounter_block")


HB = """hm AS (SELECT *, max(discharge_dttm) OVER (PARTITION BY patient_id ORDER BY admission_dttm, hospitalization_id
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM hosp),
  hn AS (SELECT *, sum(CASE WHEN pe IS NULL OR epoch_us(admission_dttm) - epoch_us(pe) > 2592000000000 THEN 1 ELSE 0 END)
    OVER (PARTITION BY patient_id ORDER BY admission_dttm, hospitalization_id) AS bn FROM hm),
  per AS (SELECT patient_id, bn, count(*) AS n FROM hn GROUP BY ALL)"""


@query("c2_stitching_statistics", views="hosp", cte=HB, sql="""SELECT CAST(sum(n) AS BIGINT) AS before, count(*) AS after,
  CAST(sum(n) - count(*) AS BIGINT) AS linked, count(*) FILTER (n > 1) AS multi_blocks, max(n) AS max_per_block FROM per""")
def c2(spark, sf):
    return T.stitch_statistics(T.stitch_encounters(V.hosp(spark, sf), 30 * 24))


@query("c3_equi_joins", views="hosp patient", sql="""SELECT race_category, count(*) AS n_rows, count(hospitalization_id) AS n_stays,
  count(DISTINCT patient_id) AS n_patients FROM (SELECT p.race_category, h.hospitalization_id,
  coalesce(p.patient_id, h.patient_id) AS patient_id FROM hosp h FULL JOIN patient p ON h.patient_id = p.patient_id) GROUP BY 1""")
def c3(spark, sf):
    j = T.join_on(V.hosp(spark, sf), V.patient(spark, sf), ["patient_id"], "full_outer")
    return j.groupBy("race_category").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count("hospitalization_id").alias("n_stays"),
        F.countDistinct("patient_id").alias("n_patients"))


@query("c4_id_difference", views="hosp visit", sql="""SELECT DISTINCT patient_id, 'left' AS only_in FROM hosp WHERE patient_id NOT IN
  (SELECT patient_id FROM visit) UNION ALL SELECT DISTINCT patient_id, 'right' FROM visit WHERE patient_id NOT IN (SELECT patient_id FROM hosp)""")
def c4(spark, sf):
    return T.id_difference(V.hosp(spark, sf), V.visit(spark, sf), "patient_id")


def _asof(spark, sf, tol):
    o = V.obs(spark, sf)
    left = o.where("category = 'purchase'").select("encounter_block", "event_id", "recorded_dttm", "value")
    right = o.where("category = 'error'").select("encounter_block", F.col("recorded_dttm").alias("ts"),
                                                 F.col("value").alias("fio2_set"))
    j = T.asof_join(left, right, ["encounter_block"], "recorded_dttm", "ts", ["fio2_set"], tol)
    return j.select("event_id", US("matched_ts").alias("matched_us"), "fio2_set")


ASOF = """l AS (SELECT * FROM obs WHERE category = 'purchase'), r AS (SELECT * FROM obs WHERE category = 'error'),
  j AS (SELECT l.event_id, epoch_us(l.recorded_dttm) AS t, epoch_us(r.recorded_dttm) AS m, r.value AS v
        FROM l ASOF LEFT JOIN r ON l.encounter_block = r.encounter_block AND l.recorded_dttm >= r.recorded_dttm)"""


@query("c5_asof_tolerance", views="obs", cte=ASOF, sql="""SELECT event_id, CASE WHEN t - m <= 14400000000 THEN m END AS matched_us,
  CASE WHEN t - m <= 14400000000 THEN v END AS fio2_set FROM j""")
def c5(spark, sf):
    return _asof(spark, sf, 240)


@query("c6_asof_latest", views="obs", cte=ASOF, sql="SELECT event_id, m AS matched_us, v AS fio2_set FROM j")
def c6(spark, sf):
    return _asof(spark, sf, None)


def _in_windows(spark, sf):
    return T.interval_join(V.obs(spark, sf), V.win(spark, sf), ["encounter_block"], "recorded_dttm",
                           "start_dttm", "end_dttm")


@query("c7_interval_join", views="obs win", sql="""SELECT category, count(*) AS n, round(sum(value), 4) AS total,
  count(DISTINCT encounter_block) AS n_encounters FROM obs JOIN win USING (encounter_block)
  WHERE recorded_dttm BETWEEN start_dttm AND end_dttm GROUP BY 1""")
def c7(spark, sf):
    return _in_windows(spark, sf).groupBy("category").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"),
        F.countDistinct("encounter_block").alias("n_encounters"))


# three windows a user that overlap: the whole one, its second half, and one hour at its end
OVER = """mid AS (SELECT *, make_timestamp((epoch_us(start_dttm) + epoch_us(end_dttm)) // 2) AS m FROM win),
  ow AS (SELECT encounter_block, start_dttm AS s, end_dttm AS e FROM win UNION ALL SELECT encounter_block, m, end_dttm FROM mid
    UNION ALL SELECT encounter_block, end_dttm - INTERVAL 1 HOUR, end_dttm FROM win WHERE end_dttm - INTERVAL 1 HOUR >= start_dttm)"""


def overlapping_windows(spark, sf):
    w = V.win(spark, sf)
    hour = F.expr("end_dttm - INTERVAL 1 HOUR")
    middle = F.timestamp_micros(F.floor((F.unix_micros("start_dttm") + F.unix_micros("end_dttm")) / 2))
    starts = F.array_compact(F.array(F.col("start_dttm"), middle, F.when(hour >= F.col("start_dttm"), hour)))
    return w.select("encounter_block", F.explode(starts).alias("s"), F.col("end_dttm").alias("e"))


@query("c7_window_depth", views="obs win", cte=OVER, sql="""SELECT event_id, count(w.s) AS n_windows FROM obs o LEFT JOIN ow w
  ON o.encounter_block = w.encounter_block AND o.recorded_dttm BETWEEN w.s AND w.e GROUP BY 1""")
def c7_depth(spark, sf):
    return T.window_depth(V.obs(spark, sf), overlapping_windows(spark, sf), ["encounter_block"], "recorded_dttm", "s", "e").select("event_id", "n_windows")


@query("c7_covered_events", views="obs win", cte=OVER, sql="""SELECT event_id FROM obs o WHERE EXISTS (SELECT 1 FROM ow w
  WHERE o.encounter_block = w.encounter_block AND o.recorded_dttm >= w.s AND o.recorded_dttm < w.e)""")
def c7_covered(spark, sf):
    """Half-open windows, each event once."""
    return T.covered_events(V.obs(spark, sf).select("encounter_block", "event_id", "recorded_dttm"), overlapping_windows(spark, sf),
                            ["encounter_block"], "recorded_dttm", "s", "e", closed="left").select("event_id")


SHORT_STAY = """st AS (SELECT encounter_block, event_id AS stay_id, in_dttm, least(out_dttm, in_dttm + INTERVAL 2 HOUR) AS out_dttm,
  location_category FROM stay WHERE out_dttm IS NOT NULL)"""


def _short_stays(spark, sf):
    return V.stay(spark, sf).where("out_dttm is not null").select(
        "encounter_block", F.col("event_id").alias("stay_id"), "in_dttm",
        F.least("out_dttm", F.expr("in_dttm + INTERVAL 2 HOURS")).alias("out_dttm"), "location_category")


@query("c8_interval_assignment", views="obs stay", cte=SHORT_STAY + """, j AS (SELECT o.event_id, o.recorded_dttm, s.out_dttm, s.location_category
  FROM obs o ASOF LEFT JOIN st s ON o.encounter_block = s.encounter_block AND o.recorded_dttm >= s.in_dttm)""",
       sql="""SELECT event_id, CASE WHEN recorded_dttm < out_dttm THEN location_category ELSE '__no_adt_match__' END AS location_category FROM j""")
def c8(spark, sf):
    ev = V.obs(spark, sf).select("encounter_block", "event_id", "recorded_dttm")
    return T.assign_location(ev, _short_stays(spark, sf), ["encounter_block"], "recorded_dttm").select(
        "event_id", "location_category")


@query("c9_first_event_in_window", views="blocks", cte="""f AS (SELECT encounter_block, min(admission_dttm) AS t FROM blocks
  WHERE med_category IN ('norepinephrine', 'epinephrine') GROUP BY 1), e AS (SELECT encounter_block, admission_dttm AS i, discharge_dttm AS o
  FROM blocks WHERE location_category = 'ed')""", sql="""SELECT encounter_block, epoch_us(t) AS first_us, epoch_us(min(i)) AS in_us
  FROM f JOIN e USING (encounter_block) WHERE t >= i AND t < o GROUP BY 1, 2""")
def c9(spark, sf):
    b = V.blocks(spark, sf)
    meds = b.where(F.col("med_category").isin("norepinephrine", "epinephrine"))
    ed = b.where("location_category = 'ed'").select("encounter_block", F.col("admission_dttm").alias("in_dttm"),
                                                    F.col("discharge_dttm").alias("out_dttm"))
    return T.first_event_in_window(meds, ed, ["encounter_block"], "admission_dttm", "in_dttm", "out_dttm").select(
        "encounter_block", US("admission_dttm").alias("first_us"), US("in_dttm").alias("in_us"))


@query("c10_nearest_join", views="obs", cte="""l AS (SELECT * FROM obs WHERE category = 'purchase'),
  r AS (SELECT encounter_block, event_id AS rid, recorded_dttm AS rt FROM obs WHERE category = 'view'),
  p AS (SELECT l.event_id, epoch_us(l.recorded_dttm) AS t, epoch_us(rt) AS pt, rid AS pid FROM l ASOF LEFT JOIN r
    ON l.encounter_block = r.encounter_block AND l.recorded_dttm >= r.rt),
  n AS (SELECT l.event_id, epoch_us(rt) AS nt, rid AS nid FROM l ASOF LEFT JOIN r
    ON l.encounter_block = r.encounter_block AND l.recorded_dttm <= r.rt),
  b AS (SELECT event_id, t, CASE WHEN nt IS NULL OR t - pt <= nt - t THEN pt ELSE nt END AS m,
    CASE WHEN nt IS NULL OR t - pt <= nt - t THEN pid ELSE nid END AS mid FROM p JOIN n USING (event_id))""",
       sql="""SELECT event_id, CASE WHEN abs(t - m) <= 14400000000 THEN m END AS matched_us,
  CASE WHEN abs(t - m) <= 14400000000 THEN mid END AS nearest_id FROM b""")
def c10(spark, sf):
    o = V.obs(spark, sf)
    left = o.where("category = 'purchase'").select("encounter_block", "event_id", "recorded_dttm")
    right = o.where("category = 'view'").select("encounter_block", F.col("recorded_dttm").alias("ts"),
                                                F.col("event_id").alias("nearest_id"))
    return T.nearest_join(left, right, ["encounter_block"], "recorded_dttm", "ts", ["nearest_id"], 4).select(
        "event_id", US("matched_ts").alias("matched_us"), "nearest_id")


@query("c11_event_windows", views="blocks", sql="""SELECT encounter_block, epoch_us(s) AS start_us, epoch_us(e) AS end_us FROM
  (SELECT encounter_block, min(admission_dttm) FILTER (device_category = 'nippv' OR (device_category = 'high flow nc' AND value >= 30)) AS s,
   max(discharge_dttm) AS e FROM blocks GROUP BY 1) WHERE s < e""")
def c11(spark, sf):
    b = V.blocks(spark, sf)
    rule = (F.col("device_category") != "high flow nc") | (F.col("value") >= 30)
    return T.event_windows(b, b, ["encounter_block"], "admission_dttm", "device_category",
                           ["nippv", "high flow nc"], "discharge_dttm", rule).select(
        "encounter_block", US("start_dttm").alias("start_us"), US("end_dttm").alias("end_us"))


@query("c12_icu_windows", views="stay", sql="""SELECT encounter_block, epoch_us(in_dttm) AS start_us, epoch_us(out_dttm) AS end_us
  FROM stay WHERE location_category = 'icu' AND out_dttm IS NOT NULL""")
def c12(spark, sf):
    return T.icu_windows(V.stay(spark, sf), ["encounter_block"]).select(
        "encounter_block", US("start_dttm").alias("start_us"), US("end_dttm").alias("end_us"))


@query("c13_stratum_windows", views="blocks", cte="""m AS (SELECT 'icu' AS stratum, encounter_block FROM blocks WHERE location_category = 'icu'
  UNION SELECT 'vaso', encounter_block FROM blocks WHERE med_category = 'norepinephrine'),
  w AS (SELECT 'icu' AS stratum, encounter_block, admission_dttm AS s, discharge_dttm AS e FROM blocks WHERE location_category = 'icu'
  UNION ALL SELECT 'vaso', encounter_block, min(admission_dttm) FILTER (med_category = 'norepinephrine') AS s, max(discharge_dttm) AS e
  FROM blocks GROUP BY 2 HAVING s < e)""", sql="""SELECT stratum, count(*) AS n_windows, count(DISTINCT encounter_block) AS n_encounters,
  round(sum((epoch_us(e) - epoch_us(s)) / 3600000000.0::DOUBLE), 4) AS window_hours FROM m JOIN w USING (stratum, encounter_block) GROUP BY 1""")
def c13(spark, sf):
    b = V.blocks(spark, sf)
    members = (b.where("location_category = 'icu'").select(F.lit("icu").alias("stratum"), "encounter_block")
               .union(b.where("med_category = 'norepinephrine'").select(F.lit("vaso"), "encounter_block")).distinct())
    fam = {"icu": T.icu_windows(b, ["encounter_block"], start="admission_dttm", end="discharge_dttm"),
           "vaso": T.event_windows(b, b, ["encounter_block"], "admission_dttm", "med_category", ["norepinephrine"])}
    return T.stratum_windows(members, fam, ["encounter_block"]).groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_windows"), F.countDistinct("encounter_block").alias("n_encounters"),
        F.round(F.sum(hours_between("start_dttm", "end_dttm")), 4).alias("window_hours"))


@query("c14_side_by_side", views="visit", sql="""SELECT coalesce(a.location_category, b.location_category) AS variable,
  coalesce(CAST(a.n AS VARCHAR), '') AS with_icu, coalesce(CAST(b.n AS VARCHAR), '') AS without_icu FROM
  (SELECT location_category, count(*) AS n FROM visit WHERE setting >= 50 AND location_category <> 'ed' GROUP BY 1) a FULL JOIN
  (SELECT location_category, count(*) AS n FROM visit WHERE setting < 50 AND location_category <> 'icu' GROUP BY 1) b
  ON a.location_category = b.location_category""")
def c14(spark, sf):
    v = V.visit(spark, sf)
    half = lambda cond, name: (v.where(cond).groupBy(F.col("location_category").alias("variable"))
                               .agg(F.count(F.lit(1)).alias(name)).withColumn("pos", F.col("variable")))
    return T.side_by_side(half("setting >= 50 and location_category <> 'ed'", "with_icu"),
                          half("setting < 50 and location_category <> 'icu'", "without_icu"),
                          "variable", "pos").drop("pos")


@query("c15_event_union", views="obs resp", sql="""SELECT source, count(*) AS n, round(sum(lab_value), 4) AS lab_total,
  round(sum(fio2_set), 4) AS fio2_total FROM (SELECT 'labs' AS source, value AS lab_value, NULL AS fio2_set FROM obs WHERE category = 'view'
  UNION ALL SELECT 'resp', NULL, fio2_set FROM resp) GROUP BY 1""")
def c15(spark, sf):
    labs = V.obs(spark, sf).where("category = 'view'").select("encounter_block", F.col("value").alias("lab_value"))
    r = V.resp(spark, sf).select("encounter_block", "fio2_set")
    return T.event_union({"labs": labs, "resp": r}).groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("lab_value"), 4).alias("lab_total"),
        F.round(F.sum("fio2_set"), 4).alias("fio2_total"))
