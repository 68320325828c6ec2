"""Respiratory support, ventilation and oxygenation (F)."""

from pyspark.sql import functions as F

from bedside.functions.expr import micros
from bedside.operators import resp as R
from bedside.plans import views as V
from bedside.plans.registry import query

ORDER = ["recorded_dttm", "event_id"]
BLOCK = "encounter_block"


def rnd(df, cols, d=6):
    return df.withColumns({c: F.round(c, d) for c in cols})


def us(df, cols):
    """Timestamps as microseconds."""
    return df.withColumns({c: micros(c) for c in cols})


@query("f1_device_inference", views="obs resp", sql="""SELECT event_id, CASE WHEN device_category IS NULL AND mode_category IN
  ('assist control-volume control', 'pressure control') THEN 'imv' ELSE device_category END AS device_category,
  round(CASE WHEN fio2_set IS NULL AND device_category = 'nasal cannula' THEN CASE WHEN round_even(lpm_set, 0) BETWEEN 1 AND 10
  THEN 0.20::DOUBLE + 0.04::DOUBLE * round_even(lpm_set, 0) END ELSE fio2_set END, 6) AS fio2_set FROM resp""")
def f1(spark, sf):
    return R.infer_device(V.resp(spark, sf)).select("event_id", "device_category", F.round("fio2_set", 6).alias("fio2_set"))


INF = """inf AS (SELECT *, CASE WHEN device_category IS NULL AND mode_category IN ('assist control-volume control', 'pressure control')
    THEN 'imv' ELSE device_category END AS d0, CASE WHEN fio2_set IS NULL AND device_category = 'nasal cannula' THEN
    CASE WHEN round_even(lpm_set, 0) BETWEEN 1 AND 10 THEN 0.20::DOUBLE + 0.04::DOUBLE * round_even(lpm_set, 0) END ELSE fio2_set END AS f0 FROM {src}),
  ff AS (SELECT *, last_value(d0 IGNORE NULLS) OVER w AS dev, last_value(mode_category IGNORE NULLS) OVER w AS mode FROM inf
    WINDOW w AS (PARTITION BY {key} ORDER BY recorded_dttm, event_id ROWS UNBOUNDED PRECEDING)),
  lg AS (SELECT *, row_number() OVER w AS rn, lag(dev) OVER w AS pd, lag(mode) OVER w AS pm FROM ff
    WINDOW w AS (PARTITION BY {key} ORDER BY recorded_dttm, event_id)),
  ch AS (SELECT *, sum(CASE WHEN rn = 1 OR dev <> pd THEN 1 ELSE 0 END) OVER w AS device_cat_id,
    sum(CASE WHEN rn = 1 OR dev <> pd OR mode <> pm THEN 1 ELSE 0 END) OVER w AS mode_cat_id FROM lg
    WINDOW w AS (PARTITION BY {key} ORDER BY recorded_dttm, event_id ROWS UNBOUNDED PRECEDING)),
  wf AS (SELECT *, last_value(f0 IGNORE NULLS) OVER (PARTITION BY {key}, mode_cat_id ORDER BY recorded_dttm, event_id ROWS UNBOUNDED PRECEDING) AS fio2
    FROM ch)"""
WF = INF.format(src="resp", key="encounter_block")


@query("f2_fill_and_number", views="obs resp", cte=WF, sql="""SELECT event_id, dev AS device_category, mode AS mode_category,
  CAST(device_cat_id AS BIGINT) AS device_cat_id, CAST(mode_cat_id AS BIGINT) AS mode_cat_id FROM ch""")
def f2(spark, sf):
    r = R.fill_and_number(R.infer_device(V.resp(spark, sf)), ORDER)
    return r.select("event_id", "device_category", "mode_category", "device_cat_id", "mode_cat_id")


@query("f3_windowed_fio2", views="obs resp", cte="""wn AS (SELECT encounter_block, min(recorded_dttm) + INTERVAL 72 HOUR AS s,
    min(recorded_dttm) + INTERVAL 240 HOUR AS e FROM obs GROUP BY 1),
  src AS (SELECT r.*, s FROM resp r JOIN wn USING (encounter_block) WHERE recorded_dttm BETWEEN s - INTERVAL 24 HOUR AND e), """
       + INF.format(src="src", key="encounter_block"), sql="""SELECT event_id, dev AS device_category, round(fio2, 6) AS fio2_set FROM wf WHERE recorded_dttm >= s""")
def f3(spark, sf):
    w = V.obs(spark, sf).groupBy(BLOCK).agg(F.min("recorded_dttm").alias("a")).select(
        BLOCK, F.expr("a + INTERVAL 72 HOURS").alias("start_dttm"), F.expr("a + INTERVAL 240 HOURS").alias("end_dttm"))
    return R.windowed_fio2(V.resp(spark, sf), w, ORDER).select("event_id", "device_category", F.round("fio2_set", 6).alias("fio2_set"))


@query("f4_waterfall", views="obs resp", cte=WF, sql="SELECT event_id, dev AS device_category, mode AS mode_category, round(fio2, 6) AS fio2_set FROM wf")
def f4(spark, sf):
    return R.waterfall(V.resp(spark, sf), ORDER, ["fio2_set"]).select(
        "event_id", "device_category", "mode_category", F.round("fio2_set", 6).alias("fio2_set"))


@query("f5_qualifying_encounters", views="blocks", sql="""SELECT DISTINCT encounter_block FROM blocks
  WHERE device_category IN ('imv', 'nippv', 'high flow nc') OR CAST(setting AS INT) % 4 = 2""")
def f5(spark, sf):
    b = V.blocks(spark, sf).withColumn("mode_category", F.when(F.col("setting").cast("int") % 4 == 2, "Pressure Control"))
    return R.qualifying_encounters(b)


@query("f6_device_rank", views="obs resp", sql="""SELECT CASE device_category WHEN 'imv' THEN 1 WHEN 'nippv' THEN 2 WHEN 'high flow nc' THEN 4
  WHEN 'nasal cannula' THEN 7 ELSE 9 END AS device_rank, count(*) AS n FROM resp GROUP BY 1""")
def f6(spark, sf):
    return V.resp(spark, sf).groupBy(R.device_rank("device_category").alias("device_rank")).agg(F.count(F.lit(1)).alias("n"))


VR = """vr AS (SELECT * REPLACE (CASE WHEN day(recorded_dttm) > 2 + encounter_block % 28 THEN 'room air' ELSE device_category END AS device_category) FROM resp),
  ve0 AS (SELECT encounter_block, min(recorded_dttm) FILTER (device_category = 'imv') AS vent_start_time,
    max(recorded_dttm) FILTER (device_category = 'imv') AS vent_end_time,
    min(recorded_dttm) FILTER (device_category = 'nippv' OR (device_category = 'high flow nc' AND lpm_set >= 30)) AS ni_start,
    min(recorded_dttm) AS admission_dttm, max(recorded_dttm) + INTERVAL 24 HOUR AS discharge_dttm FROM vr GROUP BY 1),
  ve AS (SELECT *, CASE WHEN vent_start_time IS NULL THEN 0 ELSE 1 END AS on_vent, CASE WHEN encounter_block % 5 = 0 THEN 1 ELSE 0 END AS death_enc,
    CASE WHEN encounter_block % 10 = 0 THEN admission_dttm + to_days(CAST(encounter_block % 40 AS INTEGER)) END AS death_dttm FROM ve0)"""


def vresp(spark, sf):
    return V.resp(spark, sf).withColumn("device_category", F.when(
        F.dayofmonth("recorded_dttm") > 2 + F.col(BLOCK) % 28, "room air").otherwise(F.col("device_category")))


def venc(spark, sf):
    r = vresp(spark, sf)
    dates = r.groupBy(BLOCK).agg(F.min("recorded_dttm").alias("admission_dttm"),
                                 F.expr("max(recorded_dttm) + INTERVAL 24 HOURS").alias("discharge_dttm"))
    k = F.col(BLOCK)
    return R.vent_span(r).join(dates, BLOCK).withColumns({
        "vent_start_dttm": F.col("vent_start_time"), "nippv_hfnc_enc": F.col("ni_device_start_dttm").isNotNull().cast("int"),
        "death_enc": (k % 5 == 0).cast("int"),
        "death_dttm": F.when(k % 10 == 0, F.timestamp_micros(F.unix_micros("admission_dttm") + (k % 40) * F.lit(86_400_000_000)))})


@query("f7_vent_span", views="obs resp", cte=VR, sql="""SELECT encounter_block, epoch_us(vent_start_time) AS vent_start_time, epoch_us(vent_end_time) AS vent_end_time,
  on_vent, epoch_us(ni_start) AS ni_device_start_dttm FROM ve""")
def f7(spark, sf):
    return us(R.vent_span(vresp(spark, sf)), ["vent_start_time", "vent_end_time", "ni_device_start_dttm"])


@query("f8_imv_hours", views="obs resp", cte=VR + """, nx AS (SELECT *, lead(recorded_dttm) OVER (PARTITION BY encounter_block ORDER BY recorded_dttm, event_id) AS n FROM vr)""",
       sql="""SELECT encounter_block, round(coalesce(sum((epoch_us(n) - epoch_us(recorded_dttm)) / 3600000000.0::DOUBLE), 0), 6) AS vent_duration_hours
  FROM nx WHERE device_category = 'imv' GROUP BY 1""")
def f8(spark, sf):
    return rnd(R.imv_hours(vresp(spark, sf), ORDER), ["vent_duration_hours"])


@query("f9_initial_mode", views="obs resp", cte=VR, sql="""SELECT r.encounter_block, coalesce(first(mode_category ORDER BY recorded_dttm, event_id)
  FILTER (mode_category IS NOT NULL), 'Missing') AS initial_mode_category FROM vr r JOIN ve USING (encounter_block)
  WHERE recorded_dttm >= vent_start_time GROUP BY 1""")
def f9(spark, sf):
    return R.initial_mode(vresp(spark, sf), ORDER)


PS = VR + """, ps AS (SELECT r.*, (epoch_us(recorded_dttm) - epoch_us(vent_start_time)) / 3600000000.0::DOUBLE AS h FROM vr r JOIN ve USING (encounter_block)
  WHERE device_category = 'imv')"""


@query("f10_after_vent_start", views="obs resp", cte=PS, sql="SELECT event_id, round(h, 6) AS hours_from_vent_start FROM ps WHERE h >= 0")
def f10(spark, sf):
    return R.after_vent_start(vresp(spark, sf)).select("event_id", F.round("hours_from_vent_start", 6).alias("hours_from_vent_start"))


# dense ventilation: IMV holds for a run of rows, so that patterns and pairs occur
TUBE = """td AS (SELECT encounter_block, event_id, recorded_dttm, CASE WHEN floor((epoch_us(recorded_dttm) / 3600000000 + encounter_block * 17) / 40) % 3 = 1
    AND setting > 4 THEN 'imv' ELSE 'room air' END AS device_category FROM obs),
  tl AS (SELECT *, lag(device_category, 2) OVER w AS b2, lag(device_category) OVER w AS b1, lead(device_category) OVER w AS a1,
    lead(device_category, 2) OVER w AS a2, lead(recorded_dttm) OVER w AS nx, row_number() OVER w AS rn FROM td
    WINDOW w AS (PARTITION BY encounter_block ORDER BY recorded_dttm, event_id)),
  up AS (SELECT encounter_block, recorded_dttm AS s, event_id FROM tl WHERE device_category = 'imv' AND b2 <> 'imv' AND b1 <> 'imv' AND a1 = 'imv' AND a2 = 'imv'),
  dn AS (SELECT encounter_block, nx AS e, event_id FROM tl WHERE device_category = 'imv' AND b2 = 'imv' AND b1 = 'imv' AND a1 <> 'imv' AND a2 <> 'imv'),
  fr AS (SELECT encounter_block, recorded_dttm AS f, device_category = 'imv' AS fi, event_id FROM tl WHERE rn = 1 AND encounter_block IN
    (SELECT encounter_block FROM td WHERE device_category = 'imv')),
  sy AS (SELECT encounter_block, f AS s, event_id FROM fr LEFT JOIN (SELECT encounter_block, min(s) AS fu FROM up GROUP BY 1) USING (encounter_block)
    LEFT JOIN (SELECT encounter_block, min(e) AS fd FROM dn GROUP BY 1) USING (encounter_block) WHERE fi AND (fu IS NULL OR fd <= fu)),
  st AS (SELECT *, row_number() OVER (PARTITION BY encounter_block ORDER BY s, event_id) AS n FROM
    (SELECT encounter_block, s, event_id, false AS syn FROM up UNION ALL SELECT encounter_block, s, event_id, true FROM sy)),
  en AS (SELECT *, row_number() OVER (PARTITION BY encounter_block ORDER BY e, event_id) AS n FROM dn),
  ep0 AS (SELECT st.encounter_block, st.n, s, e, syn, (epoch_us(e) - epoch_us(s)) / 3600000000.0::DOUBLE AS dur FROM st LEFT JOIN en
    ON st.encounter_block = en.encounter_block AND st.n = en.n),
  ep1 AS (SELECT *, coalesce(dur * 60 < 1500, false) AS failed FROM ep0),
  ep AS (SELECT *, CASE WHEN failed THEN 0 ELSE count(*) FILTER (NOT failed) OVER (PARTITION BY encounter_block ORDER BY s, n ROWS UNBOUNDED PRECEDING) END AS k FROM ep1)"""


def tube(spark, sf):
    on = (F.floor((F.floor(F.unix_micros("recorded_dttm") / 3_600_000_000) + F.col(BLOCK) * 17) / 40) % 3 == 1) & (F.col("setting") > 4)
    return V.obs(spark, sf).select(BLOCK, "event_id", "recorded_dttm", F.when(on, "imv").otherwise("room air").alias("device_category"))


TUBE = TUBE.replace("epoch_us(recorded_dttm) / 3600000000 +", "epoch_us(recorded_dttm) // 3600000000 +")


@query("f11_intubation_extubation", views="obs", cte=TUBE, sql="""SELECT encounter_block, 'intubation' AS kind, epoch_us(s) AS at_us FROM up
  UNION ALL SELECT encounter_block, 'extubation', epoch_us(e) FROM dn""")
def f11(spark, sf):
    up, down, _ = R.tube_events(tube(spark, sf), ORDER)
    return (up.select(BLOCK, F.lit("intubation").alias("kind"), micros("intubation_start_dttm").alias("at_us"))
            .union(down.select(BLOCK, F.lit("extubation"), micros("extubation_end_dttm"))))


@query("f12_preadmission_imv", views="obs", cte=TUBE, sql="SELECT encounter_block, epoch_us(f) AS first_us, CAST(fi AS INTEGER) AS first_is_imv FROM fr")
def f12(spark, sf):
    return R.tube_events(tube(spark, sf), ORDER)[2].select(BLOCK, micros("first_dttm").alias("first_us"), "first_is_imv")


@query("f13_imv_episodes", views="obs", cte=TUBE, sql="""SELECT encounter_block, epoch_us(s) AS start_us, epoch_us(e) AS end_us, round(dur, 6) AS hours,
  CAST(syn AS INTEGER) AS synthetic, CAST(failed AS INTEGER) AS failed, k AS episode_n FROM ep""")
def f13(spark, sf):
    e = R.imv_episodes(tube(spark, sf), ORDER, failed_minutes=1500)
    return e.select(BLOCK, micros("intubation_start_dttm").alias("start_us"), micros("extubation_end_dttm").alias("end_us"),
                    F.round("episode_duration_hours", 6).alias("hours"), F.col("is_synthetic").cast("int").alias("synthetic"),
                    F.col("is_failed_attempt").cast("int").alias("failed"), "episode_n")


# each start with the first end after it, unless another start comes first
NEXT_AFTER = TUBE.split("  ep0 AS")[0].rstrip().rstrip(",") + """, na AS (SELECT s.encounter_block, s.s, s.n, s.syn, min(d.e) AS e FROM st s LEFT JOIN dn d
    ON s.encounter_block = d.encounter_block AND d.e > s.s AND NOT EXISTS (SELECT 1 FROM st z WHERE z.encounter_block = s.encounter_block
      AND z.n > s.n AND z.s < d.e) GROUP BY ALL),
  nd AS (SELECT *, (epoch_us(e) - epoch_us(s)) / 3600000000.0::DOUBLE AS dur FROM na), nf AS (SELECT *, coalesce(dur * 60 < 1500, false) AS failed FROM nd)"""


@query("f13_next_after_pairs", views="obs", cte=NEXT_AFTER, sql="""SELECT encounter_block, epoch_us(s) AS start_us, epoch_us(e) AS end_us, round(dur, 6) AS hours,
  CAST(syn AS INTEGER) AS synthetic, CAST(failed AS INTEGER) AS failed,
  CASE WHEN failed THEN 0 ELSE count(*) FILTER (NOT failed) OVER (PARTITION BY encounter_block ORDER BY s, n ROWS UNBOUNDED PRECEDING) END AS episode_n FROM nf""")
def f13_next(spark, sf):
    e = R.imv_episodes(tube(spark, sf), ORDER, failed_minutes=1500, pairing="next_after")
    return e.select(BLOCK, micros("intubation_start_dttm").alias("start_us"), micros("extubation_end_dttm").alias("end_us"),
                    F.round("episode_duration_hours", 6).alias("hours"), F.col("is_synthetic").cast("int").alias("synthetic"),
                    F.col("is_failed_attempt").cast("int").alias("failed"), "episode_n")


@query("f14_extubation_summary", views="obs", cte=TUBE + """, inf AS (SELECT encounter_block, min(recorded_dttm) AS adm,
    CASE WHEN encounter_block % 3 > 0 THEN max(recorded_dttm) END AS dis, CASE WHEN encounter_block % 5 = 0 THEN 1 ELSE 0 END AS death FROM obs GROUP BY 1),
  pe AS (SELECT encounter_block, max(s) FILTER (k = 1) AS s1, max(e) FILTER (k = 1) AS e1, max(s) FILTER (k = 2) AS s2,
    count(*) FILTER (k > 0) AS n, max(CAST(failed AS INTEGER)) AS fl FROM ep GROUP BY 1),
  z AS (SELECT fr.encounter_block, fi, s1, e1, s2, coalesce(n, 0) AS n, fl, adm, dis, death, (epoch_us(e1) - epoch_us(s1)) / 3600000000.0::DOUBLE AS te,
    (epoch_us(s2) - epoch_us(e1)) / 3600000000.0::DOUBLE AS tr, (epoch_us(s1) - epoch_us(adm)) / 3600000000.0::DOUBLE AS ta
    FROM fr LEFT JOIN pe USING (encounter_block) LEFT JOIN inf USING (encounter_block))""",
       sql="""SELECT encounter_block, epoch_us(s1) AS start_us, epoch_us(e1) AS end_us, round(CASE WHEN NOT fi THEN te END, 6) AS time_to_extubation_hours,
  round(tr, 6) AS time_to_reintubation_hours, CASE WHEN e1 IS NOT NULL THEN CASE WHEN tr <= 48 THEN 1 ELSE 0 END END AS extubation_failure_48hr,
  n AS imv_episodes_n, CAST(fi AS INTEGER) AS pre_admission_imv, CASE WHEN NOT fi AND ta <= 24 AND ta >= -1 THEN 1 ELSE 0 END AS intubated_within_24hr_admit,
  CASE WHEN n = 0 AND fl = 1 THEN 'failed_attempt' WHEN e1 IS NOT NULL THEN 'extubated' WHEN death = 1 THEN 'death_on_imv'
    WHEN dis IS NOT NULL THEN 'discharged_on_imv' ELSE 'unknown' END AS extubation_status FROM z""")
def f14(spark, sf):
    t = tube(spark, sf)
    enc = V.obs(spark, sf).groupBy(BLOCK).agg(F.min("recorded_dttm").alias("admission_dttm"), F.max("recorded_dttm").alias("d")).select(
        BLOCK, "admission_dttm", F.when(F.col(BLOCK) % 3 > 0, F.col("d")).alias("discharge_dttm"), (F.col(BLOCK) % 5 == 0).cast("int").alias("death_enc"))
    s = R.extubation_summary(t, enc, ORDER, failed_minutes=1500)
    return rnd(s.select(BLOCK, micros("intubation_start_dttm").alias("start_us"), micros("extubation_end_dttm").alias("end_us"),
                        "time_to_extubation_hours", "time_to_reintubation_hours", "extubation_failure_48hr", "imv_episodes_n", "pre_admission_imv",
                        "intubated_within_24hr_admit", "extubation_status"), ["time_to_extubation_hours", "time_to_reintubation_hours"])


FREE = VR + """, fo AS (SELECT *, {on} AS o FROM vr), fn AS (SELECT *, lead(o) OVER w AS no, lead(recorded_dttm) OVER w AS nx FROM fo
    WINDOW w AS (PARTITION BY encounter_block ORDER BY recorded_dttm, event_id)),
  fe AS (SELECT *, {start} + INTERVAL 27 DAY AS we FROM ve WHERE {start} IS NOT NULL),
  fl AS (SELECT encounter_block, max(least(coalesce(nx, discharge_dttm, recorded_dttm), we)) AS l FROM fn JOIN fe USING (encounter_block)
    WHERE o AND NOT coalesce(no, false) AND recorded_dttm <= we GROUP BY 1)"""
FREE_SQL = """SELECT encounter_block, CASE WHEN coalesce(death_dttm, CASE WHEN death_enc = 1 THEN discharge_dttm END) <= we THEN 0
  WHEN l IS NULL THEN 28 WHEN l >= we THEN 0 ELSE date_diff('day', CAST(l AS DATE), CAST(we AS DATE)) END AS {out} FROM fe LEFT JOIN fl USING (encounter_block)"""


@query("f15_ventilator_free_days", views="obs resp", cte=FREE.format(on="coalesce(device_category = 'imv', false)", start="vent_start_time"),
       sql=FREE_SQL.format(out="vfd_28"))
def f15(spark, sf):
    return R.ventilator_free_days(vresp(spark, sf), venc(spark, sf), ORDER)


@query("f16_noninvasive_free_days", views="obs resp", cte=FREE.format(
    on="coalesce(device_category = 'nippv' OR (device_category = 'high flow nc' AND lpm_set >= 30), false)", start="ni_start"), sql=FREE_SQL.format(out="nidfd_28"))
def f16(spark, sf):
    return R.noninvasive_free_days(vresp(spark, sf), venc(spark, sf), ORDER)


# every device row holds until the next row, clipped to the window; islands of overlapping pieces
COVER = FREE + """, cv AS (SELECT encounter_block, greatest(recorded_dttm, {start}) AS a,
    least(greatest(recorded_dttm, coalesce(nx, discharge_dttm, recorded_dttm)), we) AS b FROM fn JOIN fe USING (encounter_block) WHERE o AND recorded_dttm <= we),
  cw AS (SELECT *, a > max(b) OVER (PARTITION BY encounter_block ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gap FROM cv),
  ci AS (SELECT *, count(*) FILTER (gap) OVER (PARTITION BY encounter_block ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS island FROM cw),
  cu AS (SELECT encounter_block, island, min(a) AS a, max(b) AS b FROM ci GROUP BY ALL),
  cl AS (SELECT encounter_block, max(b) AS l FROM cu GROUP BY 1)"""
VENT, NONINVASIVE = "coalesce(device_category = 'imv', false)", "coalesce(device_category = 'nippv' OR (device_category = 'high flow nc' AND lpm_set >= 30), false)"


@query("f15_interval_free_days", views="obs resp", cte=COVER.format(on=VENT, start="vent_start_time"),
       sql=FREE_SQL.format(out="vfd_28").replace("LEFT JOIN fl", "LEFT JOIN cl"))
def f15_interval(spark, sf):
    return R.ventilator_free_days(vresp(spark, sf), venc(spark, sf), ORDER, interval_mode=True)


@query("f16_interval_free_days", views="obs resp", cte=COVER.format(on=NONINVASIVE, start="ni_start"),
       sql=FREE_SQL.format(out="nidfd_28").replace("LEFT JOIN fl", "LEFT JOIN cl"))
def f16_interval(spark, sf):
    return R.noninvasive_free_days(vresp(spark, sf), venc(spark, sf), ORDER, interval_mode=True)


@query("f15_device_cover", views="obs resp", cte=COVER.format(on=VENT, start="vent_start_time"), sql="""SELECT encounter_block, count(*) AS device_runs,
  round(sum((epoch_us(b) - epoch_us(a)) / 3600000000.0::DOUBLE), 6) AS device_hours, epoch_us(max(b)) AS last_device_end FROM cu GROUP BY 1""")
def f15_cover(spark, sf):
    c = R.device_cover(vresp(spark, sf), venc(spark, sf), R.is_imv(), "vent_start_dttm", ORDER)
    return us(rnd(c, ["device_hours"]), ["last_device_end"])


@query("f17_kaplan_meier", views="obs stay", cte="""sb0 AS (SELECT location_category AS stratum, round((epoch_us(out_dttm) - epoch_us(in_dttm)) / 3600000000.0::DOUBLE, 1) AS t0,
    CASE WHEN value < 30 THEN 1 ELSE 0 END AS e0 FROM stay WHERE out_dttm IS NOT NULL),
  sb AS (SELECT stratum, least(t0, 24) AS t, CASE WHEN t0 > 24 THEN 0 ELSE e0 END AS e FROM sb0),
  a AS (SELECT stratum, t, sum(e) AS d, sum(x) AS x FROM (SELECT stratum, t, e, 1 AS x FROM sb UNION ALL SELECT DISTINCT stratum, 0.0::DOUBLE, 0, 0 FROM sb) GROUP BY ALL),
  n AS (SELECT *, sum(x) OVER (PARTITION BY stratum ORDER BY t DESC ROWS UNBOUNDED PRECEDING) AS n FROM a),
  k AS (SELECT *, sum(CASE WHEN d < n THEN ln(1 - d / n::DOUBLE) ELSE 0 END) OVER w AS ls, sum(CASE WHEN d < n THEN d / (n * (n - d))::DOUBLE ELSE 0 END) OVER w AS v,
    sum(CASE WHEN d >= n AND d > 0 THEN 1 ELSE 0 END) OVER w AS z FROM n WINDOW w AS (PARTITION BY stratum ORDER BY t ROWS UNBOUNDED PRECEDING))""",
       sql="""SELECT stratum, round(t, 4) AS timeline, round(CASE WHEN z > 0 THEN 0 ELSE exp(ls) END, 6) AS survival_prob,
  round(CASE WHEN z > 0 THEN 0 WHEN ls = 0 THEN 1 ELSE exp(-exp(ln(CASE WHEN ls < 0 THEN -ls END) - 1.959963984540054::DOUBLE * sqrt(v) / nullif(ls, 0))) END, 6) AS ci_lower,
  round(CASE WHEN z > 0 THEN 0 WHEN ls = 0 THEN 1 ELSE exp(-exp(ln(CASE WHEN ls < 0 THEN -ls END) + 1.959963984540054::DOUBLE * sqrt(v) / nullif(ls, 0))) END, 6) AS ci_upper,
  CAST(n AS BIGINT) AS at_risk, CAST(d AS BIGINT) AS observed_events FROM k""")
def f17(spark, sf):
    s = V.stay(spark, sf).where("out_dttm is not null").select(
        F.col("location_category").alias("stratum"), F.round((micros("out_dttm") - micros("in_dttm")) / 3.6e9, 1).alias("duration"),
        (F.col("value") < 30).cast("int").alias("event"))
    k = R.kaplan_meier(s, limit=24)
    return rnd(rnd(k, ["survival_prob", "ci_lower", "ci_upper"]), ["timeline"], 4)


RATIO = """l AS (SELECT encounter_block, event_id, recorded_dttm, value AS po2 FROM obs WHERE category IN ('view', 'error')),
  v AS (SELECT encounter_block, event_id, recorded_dttm, 50 + setting AS spo2 FROM obs WHERE category IN ('click', 'error') AND 50 + setting <= 97),
  rf AS (SELECT encounter_block, recorded_dttm AS rt, fio2_set, device_category FROM resp),
  pf AS (SELECT l.*, fio2_set, device_category, po2 / fio2_set AS ratio FROM l ASOF JOIN rf ON l.encounter_block = rf.encounter_block AND l.recorded_dttm >= rf.rt
    WHERE epoch_us(l.recorded_dttm) - epoch_us(rt) <= 14400000000 AND fio2_set > 0),
  sfr AS (SELECT v.*, fio2_set, device_category, spo2 / fio2_set AS ratio FROM v ASOF JOIN rf ON v.encounter_block = rf.encounter_block AND v.recorded_dttm >= rf.rt
    WHERE epoch_us(v.recorded_dttm) - epoch_us(rt) <= 14400000000 AND fio2_set BETWEEN 0.21::DOUBLE AND 1.0::DOUBLE)"""


def labs(spark, sf):
    return V.obs(spark, sf).where("category in ('view', 'error')").select(BLOCK, "event_id", "recorded_dttm", F.col("value").alias("po2_arterial"))


def vitals(spark, sf):
    return V.obs(spark, sf).where("category in ('click', 'error')").select(BLOCK, "event_id", "recorded_dttm", (50 + F.col("setting")).alias("spo2"))


@query("f18_pf_ratio", views="obs resp", cte=RATIO, sql="SELECT event_id, round(ratio, 6) AS concurrent_pf, device_category FROM pf")
def f18(spark, sf):
    return R.pf_ratio(labs(spark, sf), V.resp(spark, sf), [BLOCK], "recorded_dttm").select(
        "event_id", F.round("concurrent_pf", 6).alias("concurrent_pf"), "device_category")


@query("f19_sf_ratio", views="obs resp", cte=RATIO, sql="SELECT event_id, round(ratio, 6) AS concurrent_sf, device_category FROM sfr")
def f19(spark, sf):
    return R.sf_ratio(vitals(spark, sf), V.resp(spark, sf), [BLOCK], "recorded_dttm").select(
        "event_id", F.round("concurrent_sf", 6).alias("concurrent_sf"), "device_category")


ONSET = """q AS (SELECT *, row_number() OVER (PARTITION BY encounter_block ORDER BY recorded_dttm, event_id) AS rn FROM resp
    WHERE device_category IN ('imv', 'nippv') OR (device_category = 'high flow nc' AND lpm_set >= 30)),
  onset AS (SELECT encounter_block, event_id, recorded_dttm AS onset_dttm, device_category AS onset_device FROM q WHERE rn = 1)"""


@query("f20_failure_onset", views="obs resp", cte=ONSET, sql="SELECT encounter_block, epoch_us(onset_dttm) AS onset_us, onset_device, event_id AS hospitalization_id FROM onset")
def f20(spark, sf):
    return R.failure_onset(V.resp(spark, sf), V.obs(spark, sf), carry=["event_id"]).select(
        BLOCK, micros("onset_dttm").alias("onset_us"), "onset_device", F.col("event_id").alias("hospitalization_id"))


OXY = RATIO + "," + ONSET + """, p AS (SELECT pf.*, (epoch_us(recorded_dttm) - epoch_us(onset_dttm)) / 3600000000.0::DOUBLE AS h FROM pf JOIN onset USING (encounter_block)
    WHERE ratio < 600), p1 AS (SELECT * FROM p WHERE h BETWEEN 0 AND 240),
  s1 AS (SELECT * FROM (SELECT sfr.*, (epoch_us(recorded_dttm) - epoch_us(onset_dttm)) / 3600000000.0::DOUBLE AS h FROM sfr JOIN onset USING (encounter_block)) WHERE h BETWEEN 0 AND 240),
  pa AS (SELECT encounter_block, min(ratio) AS pmin, avg(ratio) AS pmean, quantile_cont(ratio, 0.5) AS pmed, count(*) AS np FROM p1 GROUP BY 1),
  pw AS (SELECT encounter_block, device_category AS pdev, h AS ph, recorded_dttm AS pt FROM (SELECT *, row_number() OVER (PARTITION BY encounter_block
    ORDER BY ratio, recorded_dttm, event_id) AS rn FROM p1) WHERE rn = 1),
  sa AS (SELECT encounter_block, min(ratio) AS smin, avg(ratio) AS smean, quantile_cont(ratio, 0.5) AS smed, count(*) AS ns FROM s1 GROUP BY 1),
  sw AS (SELECT encounter_block, device_category AS sdev, h AS sh FROM (SELECT *, row_number() OVER (PARTITION BY encounter_block
    ORDER BY ratio, recorded_dttm, event_id) AS rn FROM s1) WHERE rn = 1),
  sc AS (SELECT encounter_block, ratio AS cr FROM (SELECT s1.*, row_number() OVER (PARTITION BY encounter_block ORDER BY
    abs(epoch_us(recorded_dttm) - epoch_us(pt)), recorded_dttm, event_id) AS rn FROM s1 JOIN pw USING (encounter_block)
    WHERE abs(epoch_us(recorded_dttm) - epoch_us(pt)) <= 14400000000) WHERE rn = 1),
  oxy AS (SELECT encounter_block, onset_device, pmin AS pf_24_min, pmean AS pf_24_mean, pmed AS pf_24_median, np AS n_pf_measurements, pdev AS device_at_worst_pf,
    ph AS hours_to_worst_pf, smin AS sf_24_min, smean AS sf_24_mean, smed AS sf_24_median, ns AS n_sf_measurements, sdev AS device_at_worst_sf, sh AS hours_to_worst_sf,
    cr AS sf_contemporary_to_pf, CASE WHEN pmin IS NOT NULL AND smin IS NOT NULL THEN 'sf_pf' WHEN pmin IS NOT NULL THEN 'pf_only' WHEN smin IS NOT NULL THEN 'sf_only'
    ELSE 'undefined_oxygenation' END AS exposure_group FROM onset LEFT JOIN pa USING (encounter_block) LEFT JOIN pw USING (encounter_block)
    LEFT JOIN sa USING (encounter_block) LEFT JOIN sw USING (encounter_block) LEFT JOIN sc USING (encounter_block))"""


def oxygenation(spark, sf):
    r = V.resp(spark, sf)
    return R.oxygenation_summary(R.failure_onset(r), R.pf_ratio(labs(spark, sf), r, [BLOCK], "recorded_dttm"),
                                 R.sf_ratio(vitals(spark, sf), r, [BLOCK], "recorded_dttm"), "recorded_dttm", "recorded_dttm", hours=240)


NUM = ["pf_24_min", "pf_24_mean", "pf_24_median", "hours_to_worst_pf", "sf_24_min", "sf_24_mean", "sf_24_median", "hours_to_worst_sf", "sf_contemporary_to_pf"]
TXT = ["encounter_block", "onset_device", "n_pf_measurements", "device_at_worst_pf", "n_sf_measurements", "device_at_worst_sf", "exposure_group"]


@query("f21_oxygenation_summary", views="obs resp", cte=OXY, sql=f"SELECT {', '.join(TXT)}, {', '.join(f'round({c}, 5) AS {c}' for c in NUM)} FROM oxy")
def f21(spark, sf):
    return rnd(oxygenation(spark, sf).select(*TXT, *NUM), NUM, 5)


@query("f22_oxygenation_statistics", views="obs resp", cte=OXY + ", u AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS variable, {s} AS stratum, {m} AS v FROM oxy WHERE {m} IS NOT NULL" for m in NUM for s in ("'Overall'", "'device:' || onset_device")) + ")",
       sql="""SELECT variable, stratum, count(*) AS n, round(avg(v), 5) AS mean, round(stddev_samp(v), 5) AS sd, round(quantile_cont(v, 0.5), 5) AS median,
  round(quantile_cont(v, 0.25), 5) AS q25, round(quantile_cont(v, 0.75), 5) AS q75 FROM u GROUP BY ALL
  UNION ALL SELECT 'exposure_group_count', exposure_group, count(*), NULL, NULL, NULL, NULL, NULL FROM oxy GROUP BY 2""")
def f22(spark, sf):
    return rnd(R.oxygenation_statistics(oxygenation(spark, sf)), ["mean", "sd", "median", "q25", "q75"], 5)


@query("f23_daily_minimum", views="obs resp", cte=RATIO + """, sp AS (SELECT encounter_block, min(recorded_dttm) FILTER (device_category = 'imv') AS s FROM resp GROUP BY 1),
  d AS (SELECT encounter_block, floor((epoch_us(recorded_dttm) - epoch_us(s)) / 86400000000.0::DOUBLE) AS day, min(least(ratio, 600)) AS v FROM pf JOIN sp USING (encounter_block) GROUP BY ALL)""",
       sql="""SELECT CAST(day AS INTEGER) AS day, count(*) AS n, round(quantile_cont(v, 0.5), 5) AS median, round(quantile_cont(v, 0.25), 5) AS q1,
  round(quantile_cont(v, 0.75), 5) AS q3 FROM d WHERE day >= 0 AND day < 28 GROUP BY 1""")
def f23(spark, sf):
    r = V.resp(spark, sf)
    pf = R.pf_ratio(labs(spark, sf), r, [BLOCK], "recorded_dttm")
    return rnd(R.daily_minimum(pf, R.vent_span(r), [BLOCK], "concurrent_pf", "recorded_dttm", "vent_start_time", cap=600), ["median", "q1", "q3"], 5)


SET = ["tidal_volume_set", "peep_set", "fio2_set"]


def _stat_sql(s):
    return (f"round(avg({s}), 5) AS {s}_mean, round(stddev_samp({s}), 5) AS {s}_sd, count({s}) AS {s}_n, round(quantile_cont({s}, 0.5), 5) AS {s}_median, "
            f"round(quantile_cont({s}, 0.25), 5) AS {s}_q1, round(quantile_cont({s}, 0.75), 5) AS {s}_q3")


STAT = ", ".join(_stat_sql(s) for s in SET)


@query("f24_settings_per_encounter", views="obs resp", sql=f"SELECT encounter_block, {STAT} FROM resp GROUP BY 1")
def f24(spark, sf):
    s = R.setting_statistics(V.resp(spark, sf), SET + ["no_such_setting"], [BLOCK])
    return rnd(s, [c for c in s.columns if c != BLOCK and not c.endswith("_n")], 5)


@query("f25_settings_by_device_mode", views="obs resp", sql=f"""SELECT device_category, mode_category, {STAT} FROM resp
  WHERE device_category IS NOT NULL AND mode_category IS NOT NULL GROUP BY 1, 2""")
def f25(spark, sf):
    s = R.setting_statistics(V.resp(spark, sf), SET, ["device_category", "mode_category"])
    return rnd(s, [c for c in s.columns if not c.endswith(("_category", "_n"))], 5)


@query("f26_observation_share", views="obs resp", cte="""vv AS (SELECT * FROM resp WHERE device_category IS NOT NULL AND mode_category IS NOT NULL)""",
       sql=" UNION ALL ".join(f"""SELECT device_category, mode_category, '{s}' AS setting, count({s}) AS n, (SELECT count(*) FROM vv) AS total,
  round(count({s}) * 100.0::DOUBLE / (SELECT count(*) FROM vv), 6) AS pct FROM vv GROUP BY 1, 2""" for s in SET))
def f26(spark, sf):
    return rnd(R.observation_share(V.resp(spark, sf), SET), ["pct"])


def _hourly(spark, sf, setting, modes):
    h = R.hourly_setting(R.after_vent_start(vresp(spark, sf)), setting, modes, minimum=3)
    return rnd(h, ["mean", "std", "median", "q25", "q75"], 5)


HSQL = """SELECT CAST(round_even(h, 0) AS INTEGER) AS hour_bin, round(avg({s}), 5) AS mean, round(stddev_samp({s}), 5) AS std, count({s}) AS count,
  round(quantile_cont({s}, 0.5), 5) AS median, round(quantile_cont({s}, 0.25), 5) AS q25, round(quantile_cont({s}, 0.75), 5) AS q75
  FROM ps WHERE mode_category = '{m}' AND h >= 0 AND round_even(h, 0) <= 168 GROUP BY 1 HAVING count({s}) >= 3"""


@query("f27_tidal_volume_by_hour", views="obs resp", cte=PS, sql=HSQL.format(s="tidal_volume_set", m="assist control-volume control"))
def f27(spark, sf):
    return _hourly(spark, sf, "tidal_volume_set", R.VOLUME_MODES)


@query("f28_pressure_by_hour", views="obs resp", cte=PS, sql=HSQL.format(s="peep_set", m="pressure control"))
def f28(spark, sf):
    return _hourly(spark, sf, "peep_set", ["pressure control"])


@query("f29_mode_proportions", views="obs resp", cte=PS, sql="""SELECT CASE mode_category WHEN 'assist control-volume control' THEN 'Assist Control-Volume Control'
  WHEN 'pressure support/cpap' THEN 'Pressure Support/CPAP' WHEN 'pressure control' THEN 'Pressure Control' ELSE 'Other' END AS mode_group, count(*) AS count,
  round(count(*) / (SELECT count(*) FROM ps WHERE h BETWEEN 0 AND 24)::DOUBLE, 6) AS proportion FROM ps WHERE h BETWEEN 0 AND 24 GROUP BY 1""")
def f29(spark, sf):
    return rnd(R.mode_proportions(R.after_vent_start(vresp(spark, sf))), ["proportion"])


@query("f30_device_stay", views="obs resp", cte=VR + "," + ONSET + """, d AS (SELECT ve.encounter_block % 3 AS g, onset_dttm,
  (epoch_us(onset_dttm) - epoch_us(admission_dttm)) / 86400000000.0::DOUBLE AS pre, (epoch_us(discharge_dttm) - epoch_us(onset_dttm)) / 86400000000.0::DOUBLE AS post
  FROM ve LEFT JOIN onset USING (encounter_block))""", sql="SELECT g AS year_group, count(*) AS n_total, count(onset_dttm) AS n_onset, " + ", ".join(
    f"round(quantile_cont({c}, {q}), 6) AS {c}_{n}" for c in ("pre", "post") for n, q in (("median", 0.5), ("q1", 0.25), ("q3", 0.75))) + " FROM d GROUP BY 1")
def f30(spark, sf):
    enc = venc(spark, sf).withColumn("year_group", F.col(BLOCK) % 3)
    s = R.device_stay(enc, R.failure_onset(V.resp(spark, sf)), ["year_group"])
    return rnd(s, [c for c in s.columns if c.startswith(("pre_", "post_"))])


TT = """t AS (SELECT encounter_block, min(admission_dttm) FILTER (med_category = 'norepinephrine') AS p, min(admission_dttm) FILTER (location_category = 'icu') AS i
  FROM blocks GROUP BY 1), h AS (SELECT encounter_block, (epoch_us(i) - epoch_us(p)) / 3600000000.0::DOUBLE AS h FROM t WHERE p IS NOT NULL AND i IS NOT NULL)"""


def _tti(spark, sf):
    b = V.blocks(spark, sf)
    at = lambda c: F.min(F.when(c, F.col("admission_dttm")))
    d = b.groupBy(BLOCK).agg(at(F.col("med_category") == "norepinephrine").alias("first_pressor_admin_dttm"),
                             at(F.col("location_category") == "icu").alias("first_icu_in_dttm"))
    return R.time_to_target(d.withColumn("vaso_ed_icu_enc", F.lit(1)))


@query("f31_time_to_icu", views="blocks", cte=TT, sql="SELECT encounter_block, round(h, 6) AS time_to_icu_hours FROM h")
def f31(spark, sf):
    return rnd(_tti(spark, sf), ["time_to_icu_hours"])


@query("f31_time_to_icu_summary", views="blocks", cte=TT, sql="""SELECT count(*) AS n, count(*) FILTER (h < 0) AS n_negative, round(avg(h), 6) AS mean,
  round(stddev_samp(h), 6) AS sd, round(quantile_cont(h, 0.5), 6) AS median, round(quantile_cont(h, 0.25), 6) AS q1, round(quantile_cont(h, 0.75), 6) AS q3 FROM h""")
def f31s(spark, sf):
    return rnd(R.summarize_hours(_tti(spark, sf)), ["mean", "sd", "median", "q1", "q3"])


