"""Locations, length of stay, journeys (E)."""

from pyspark.sql import functions as F

from bedside.functions.expr import micros
from bedside.operators import cohort as H
from bedside.operators import journey as J
from bedside.plans import views as V
from bedside.plans.on_cohort import parts
from bedside.plans.registry import query

ORDER = ["in_dttm", "event_id"]
R6 = lambda c: F.round(c, 6).alias(c)


@query("e1_hospital_stay", views="stay", sql="""SELECT encounter_block, epoch_us(min(in_dttm)) AS first_us,
  round((epoch_us(max(out_dttm)) - epoch_us(min(in_dttm))) / 86400000000.0::DOUBLE, 6) AS hospital_los_days,
  arg_min(location_category, in_dttm) AS first_location FROM stay GROUP BY 1""")
def e1(spark, sf):
    return J.hospital_stay(V.stay(spark, sf), tie="event_id").select(
        "encounter_block", micros("first_in_dttm").alias("first_us"), R6("hospital_los_days"), "first_location")


@query("e2_first_icu_stay", views="stay", sql="""SELECT encounter_block, epoch_us(in_dttm) AS first_us,
  round((epoch_us(out_dttm) - epoch_us(in_dttm)) / 86400000000.0::DOUBLE, 6) AS first_icu_los_days FROM
  (SELECT *, row_number() OVER (PARTITION BY encounter_block ORDER BY in_dttm, out_dttm) AS rn FROM stay WHERE location_category = 'icu') WHERE rn = 1""")
def e2(spark, sf):
    return J.first_icu_stay(V.stay(spark, sf)).select(
        "encounter_block", micros("first_icu_in_dttm").alias("first_us"), R6("first_icu_los_days"))


@query("e3_icu_episodes", views="stay", cte="""t AS (SELECT *, sum(CASE WHEN location_category IN ('ward', 'other') THEN 1 ELSE 0 END) OVER
  (PARTITION BY encounter_block ORDER BY in_dttm, event_id) AS cs FROM stay), i AS (SELECT *, lag(cs) OVER (PARTITION BY encounter_block
  ORDER BY in_dttm, event_id) AS pc FROM t WHERE location_category = 'icu')""",
       sql="SELECT encounter_block, count(*) FILTER (pc IS NULL OR cs > pc) AS icu_episodes FROM i GROUP BY 1")
def e3(spark, sf):
    return J.icu_episodes(V.stay(spark, sf), ORDER)


STEPS = """a AS (SELECT *, CASE location_category WHEN 'icu' THEN 'ICU' WHEN 'ward' THEN 'Ward' WHEN 'ed' THEN 'ED' WHEN 'procedural' THEN 'Procedural'
    ELSE 'Other' END AS location FROM stay),
  b AS (SELECT *, lag(location) OVER (PARTITION BY encounter_block ORDER BY in_dttm, event_id) AS prev FROM a),
  c AS (SELECT encounter_block, location, row_number() OVER (PARTITION BY encounter_block ORDER BY in_dttm, event_id) AS step FROM b
    WHERE NOT (location = 'ED' AND coalesce(prev IN ('ICU', 'Ward', 'Procedural'), false))),
  steps AS (SELECT * FROM c WHERE step <= 7)"""


def _steps(spark, sf):
    return J.journey_steps(V.stay(spark, sf), ORDER)


@query("e4_journey_steps", views="stay", cte=STEPS, sql="SELECT encounter_block, step, location FROM steps")
def e4(spark, sf):
    return _steps(spark, sf)


# short encounters, so that outcomes fill the later steps
BSTEPS = """sb AS (SELECT encounter_block, hospitalization_id, admission_dttm, CASE location_category WHEN 'icu' THEN 'ICU' WHEN 'ward' THEN 'Ward'
    WHEN 'ed' THEN 'ED' WHEN 'procedural' THEN 'Procedural' ELSE 'Other' END AS location FROM blocks),
  b1 AS (SELECT *, lag(location) OVER (PARTITION BY encounter_block ORDER BY admission_dttm, hospitalization_id) AS prev FROM sb),
  c AS (SELECT encounter_block, location, row_number() OVER (PARTITION BY encounter_block ORDER BY admission_dttm, hospitalization_id) AS step FROM b1
    WHERE NOT (location = 'ED' AND coalesce(prev IN ('ICU', 'Ward', 'Procedural'), false))),
  dd AS (SELECT encounter_block, max(CASE WHEN discharge_category IN ('Expired', 'Hospice') THEN 1 ELSE 0 END) AS death_enc FROM blocks GROUP BY 1),
  w AS (SELECT encounter_block, """ + ", ".join(f"max(location) FILTER (step = {i}) AS p{i}" for i in range(1, 8)) + """ FROM c WHERE step <= 7 GROUP BY 1),
  wide AS (SELECT w.encounter_block, death_enc, """ + ", ".join(
    f"coalesce(p{i}, CASE WHEN death_enc = 1 THEN 'Died' ELSE 'Discharged' END) AS loc_{i}" for i in range(1, 8)) + """ FROM w JOIN dd USING (encounter_block))"""


def _wide(spark, sf):
    adt = parts(spark, sf)[0]
    steps = J.journey_steps(adt, ["in_dttm", "hospitalization_id"])
    return J.propagate_death(J.journey_wide(steps, H.location_flags(adt)))


@query("e5_journey_outcomes", views="blocks", cte=BSTEPS, sql="SELECT * FROM wide")
def e5(spark, sf):
    return _wide(spark, sf)


@query("e6_flow_table", views="blocks", cte=BSTEPS, sql="SELECT step, source, target, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS step, loc_{i} AS source, loc_{i + 1} AS target FROM wide" for i in range(1, 7)) + ") GROUP BY ALL")
def e6(spark, sf):
    return J.flow_table(_wide(spark, sf))


@query("e6_node_sizes", views="blocks", cte=BSTEPS, sql="SELECT step, location, count(*) AS n FROM (" + " UNION ALL ".join(
    f"SELECT {i} AS step, loc_{i} AS location FROM wide" for i in range(1, 8)) + ") GROUP BY ALL")
def e6n(spark, sf):
    return J.node_sizes(_wide(spark, sf))


@query("e7_restricted_journeys", views="stay", cte=STEPS, sql="""SELECT step, location, count(*) AS n FROM steps WHERE encounter_block IN
  (SELECT encounter_block FROM steps WHERE step = 1 AND location IN ('Procedural', 'Other')) AND encounter_block IN
  (SELECT encounter_block FROM stay WHERE location_category = 'icu' AND value > 150) GROUP BY ALL""")
def e7(spark, sf):
    ids = V.stay(spark, sf).where("location_category = 'icu' and value > 150")
    s = J.restrict_journey(_steps(spark, sf), ids, ["Procedural", "Other"])
    return s.groupBy("step", "location").agg(F.count(F.lit(1)).alias("n"))


DW = """s AS (SELECT *, (epoch_us(out_dttm) - epoch_us(in_dttm)) / 3600000000.0::DOUBLE AS h FROM stay WHERE out_dttm > in_dttm),
  k AS (SELECT *, row_number() OVER (PARTITION BY location_category ORDER BY h) - 1 AS r, count(*) OVER (PARTITION BY location_category) AS n FROM s),
  q AS (SELECT location_category, max(h) FILTER (r = round_even(0.25::DOUBLE * (n - 1), 0)) AS q1, max(h) FILTER (r = round_even(0.75::DOUBLE * (n - 1), 0)) AS q3
    FROM k GROUP BY 1)"""


@query("e8_dwell_summary", views="stay", cte=DW, sql="""SELECT s.location_category, round(sum(h), 4) AS total_hours, round(sum(h) / 24, 4) AS total_days,
  round(quantile_cont(h, 0.5), 6) AS median_stay_hours, round(any_value(q1), 6) AS q1_stay_hours, round(any_value(q3), 6) AS q3_stay_hours,
  count(DISTINCT encounter_block) AS distinct_encounters, count(*) AS n_stays FROM s JOIN q USING (location_category) GROUP BY 1""")
def e8(spark, sf):
    d = J.dwell_summary(V.stay(spark, sf))
    return d.select("location_category", F.round("total_hours", 4).alias("total_hours"), F.round("total_days", 4).alias("total_days"),
                    R6("median_stay_hours"), R6("q1_stay_hours"), R6("q3_stay_hours"), "distinct_encounters", "n_stays")


ST = """st AS (SELECT encounter_block, in_dttm, least(out_dttm, in_dttm + INTERVAL 2 HOUR) AS out_dttm, location_category FROM stay
    WHERE out_dttm > in_dttm),
  j AS (SELECT CASE WHEN o.recorded_dttm < s.out_dttm THEN s.location_category ELSE '__no_adt_match__' END AS location_category
    FROM obs o ASOF LEFT JOIN st s ON o.encounter_block = s.encounter_block AND o.recorded_dttm >= s.in_dttm),
  hh AS (SELECT location_category, sum((epoch_us(out_dttm) - epoch_us(in_dttm)) / 3600000000.0::DOUBLE) AS th FROM st GROUP BY 1)"""


@query("e9_capture_by_location", views="obs stay", cte=ST, sql="""SELECT location_category, 'labs' AS "table", count(*) AS n_events,
  round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM j), 6) AS pct_events, round(count(*) / any_value(th), 6) AS events_per_hour
  FROM j LEFT JOIN hh USING (location_category) GROUP BY 1""")
def e9(spark, sf):
    st = V.stay(spark, sf).where("out_dttm is not null").withColumn(
        "out_dttm", F.least("out_dttm", F.expr("in_dttm + INTERVAL 2 HOURS"))).drop("event_id", "value")
    c = J.capture_by_location(V.obs(spark, sf), st, ["encounter_block"], "recorded_dttm", "labs")
    return c.select("location_category", "table", "n_events", R6("pct_events"), R6("events_per_hour"))


@query("e10_stay_box", views="stay", cte=DW, sql="""SELECT location_category, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3,
  round(quantile_cont(h, 0.5), 6) AS median, round(greatest(min(h), any_value(q1) - 1.5::DOUBLE * (any_value(q3) - any_value(q1))), 6) AS lower_fence,
  round(least(max(h), any_value(q3) + 1.5::DOUBLE * (any_value(q3) - any_value(q1))), 6) AS upper_fence, count(*) AS n
  FROM s JOIN q USING (location_category) GROUP BY 1""")
def e10(spark, sf):
    b = J.stay_box(V.stay(spark, sf))
    return b.select("location_category", R6("q1"), R6("q3"), R6("median"), R6("lower_fence"), R6("upper_fence"), "n")


@query("e11_encounter_categories", views="blocks", cte="""p AS (SELECT encounter_block, max(CASE WHEN location_category = 'icu' THEN 1 ELSE 0 END) AS i,
  max(CASE WHEN location_category = 'ed' THEN 1 ELSE 0 END) AS e, max(CASE WHEN location_category = 'ward' THEN 1 ELSE 0 END) AS w,
  max(CASE WHEN location_category NOT IN ('icu', 'ed', 'ward') THEN 1 ELSE 0 END) AS o FROM blocks GROUP BY 1)""",
       sql="""SELECT CAST(sum(i) AS BIGINT) AS icu_hospitalizations, count(*) FILTER (i = 1 AND e + w + o = 0) AS icu_only_hospitalizations,
  count(*) FILTER (e = 1 AND i + w + o = 0) AS ed_only_hospitalizations, count(*) FILTER (w = 1 AND i + e + o = 0) AS ward_only_hospitalizations,
  count(*) AS total_hospitalizations FROM p""")
def e11(spark, sf):
    return J.encounter_categories(parts(spark, sf)[0], "encounter_block")


@query("e12_duration_statistics", views="stay", cte="s AS (SELECT (epoch_us(out_dttm) - epoch_us(in_dttm)) / 3600000000.0::DOUBLE AS h FROM stay WHERE out_dttm IS NOT NULL)",
       sql="""SELECT count(*) AS count, round(avg(h), 6) AS mean_hours, round(stddev_samp(h), 6) AS std_hours, round(min(h), 6) AS min_hours,
  round(max(h), 6) AS max_hours, round(quantile_cont(h, 0.25), 6) AS q1_hours, round(quantile_cont(h, 0.5), 6) AS median_hours,
  round(quantile_cont(h, 0.75), 6) AS q3_hours FROM s""")
def e12(spark, sf):
    d = J.duration_statistics(V.stay(spark, sf))
    return d.select("count", *[R6(c) for c in d.columns if c != "count"])


@query("e12_icu_stay_counts", views="stay", cte="s AS (SELECT *, CASE WHEN event_id % 3 = 0 THEN 'micu' ELSE 'sicu' END AS location_type FROM stay)",
       sql="""SELECT location_type, count(*) AS icu_events, count(DISTINCT encounter_block) AS icu_hospitalizations FROM s
  WHERE location_category = 'icu' GROUP BY GROUPING SETS ((), (location_type))""")
def e12b(spark, sf):
    s = V.stay(spark, sf).withColumn("location_type", F.when(F.col("event_id") % 3 == 0, "micu").otherwise("sicu"))
    return J.icu_stay_counts(s, "encounter_block")
