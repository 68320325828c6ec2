"""Clinical-shaped views over the driver's tables, in DataFrame and in SQL form.

``visit``    every event is a hospital stay of its user, chained into encounters
             by the 6 h gap rule: many short encounters with mixed locations.
``obs``      the events of a user as one irregular time series.
``resp``     the same series read as respiratory support rows.
``stay``     the same series read as consecutive location stays.
``hosp``     orders read as hospitalizations of a customer.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.functions.expr import lookup
from bedside.functions.ordered import Ordered
from bedside.operators import temporal
from bedside.sources.tables import materialise, prepare

LOCATION = {"error": "icu", "view": "ward", "purchase": "ed", "signup": "procedural", "click": "other"}
DEVICE = {"error": "imv", "signup": "nippv", "purchase": "high flow nc", "view": "nasal cannula"}
MED = {"purchase": "norepinephrine", "error": "epinephrine", "view": "vasopressin",
       "click": "propofol", "signup": "dopamine"}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A driver table; wall times are read as UTC."""
    prepare(spark)
    df = spark.read.parquet(f"{sf.rstrip('/')}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if t.startswith("timestamp") else F.col(c)
                       for c, t in df.dtypes])


def obs(spark, sf):
    return table(spark, sf, "events").select(
        F.col("user_id").alias("encounter_block"), F.col("event_id"), F.col("ts").alias("recorded_dttm"),
        F.col("event_type").alias("category"), "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("double").alias("setting"))


def stay(spark, sf):
    return stay_of(obs(spark, sf))


def stay_of(o):
    nxt = Ordered(o, ["encounter_block"], ["recorded_dttm", "event_id"]).lead(
        "out_dttm", "recorded_dttm").apply()
    return nxt.select("encounter_block", "event_id", F.col("recorded_dttm").alias("in_dttm"), "out_dttm",
                      lookup("category", LOCATION).alias("location_category"), "value")


def resp(spark, sf):
    return resp_of(obs(spark, sf))


def resp_of(o):
    s = F.col("setting").cast("int")
    return o.select(
        "encounter_block", "event_id", "recorded_dttm",
        lookup("category", DEVICE).alias("device_category"),
        F.when(s % 4 == 0, "assist control-volume control").when(s % 4 == 1, "pressure support/cpap")
        .when(s % 4 == 2, "pressure control").alias("mode_category"),
        F.when(s % 3 != 0, F.lit(0.21) + (s % 80) / F.lit(100.0)).alias("fio2_set"),
        F.col("value").alias("lpm_set"), F.col("setting").alias("peep_set"),
        F.col("value").alias("tidal_volume_set"))


def visit(spark, sf):
    """Events as hospitalizations with the columns the cohort rules need."""
    o = obs(spark, sf)
    e = F.col("event_id")
    return o.select(
        e.alias("hospitalization_id"), F.col("encounter_block").alias("patient_id"),
        F.col("recorded_dttm").alias("admission_dttm"),
        F.timestamp_micros(F.unix_micros("recorded_dttm") + (e % 5) * F.lit(3_600_000_000)).alias("discharge_dttm"),
        (e % 90).cast("int").alias("age_at_admission"),
        F.when(e % 17 == 0, "Expired").when(e % 17 == 1, "Hospice").otherwise("Home").alias("discharge_category"),
        lookup("category", LOCATION).alias("location_category"),
        lookup("category", DEVICE).alias("device_category"),
        lookup("category", MED).alias("med_category"), "value", "setting")


def blocks(spark, sf):
    """``visit`` of adults with the encounter block, stitched anew for every query."""
    v = visit(spark, sf).where("age_at_admission >= 18")
    return materialise(temporal.stitch_encounters(v, 6), "encounters")


def meds(spark, sf):
    """The events as continuous drug administrations."""
    return meds_of(obs(spark, sf), lookup("category", MED))


def meds_of(o, med):
    s = F.col("setting").cast("int")
    return o.select(
        "encounter_block", "event_id", (F.col("encounter_block") * 10 + F.dayofmonth("recorded_dttm") % 10).alias("hospitalization_id"),
        F.col("recorded_dttm").alias("admin_dttm"), med.alias("med_category"),
        F.when(med == "propofol", "sedation").otherwise("vasoactives").alias("med_group"),
        F.concat(med, F.lit(" "), (s % 3).cast("string")).alias("med_name"), F.col("value").alias("med_dose"),
        F.when(s % 5 == 0, "mg/hr").when(s % 5 == 1, "mcg/kg/min").when(s % 5 == 2, "MCG / kg / Hour")
        .when(s % 5 == 3, "units/min").alias("med_dose_unit"))


def hosp(spark, sf):
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("hospitalization_id"), F.col("o_custkey").alias("patient_id"),
        F.col("o_orderdate").alias("admission_dttm"),
        F.timestamp_micros(F.unix_micros("o_orderdate") + (k % 40) * F.lit(86_400_000_000)).alias("discharge_dttm"),
        (k % 90).cast("int").alias("age_at_admission"),
        F.when(F.col("o_orderstatus") == "F", "Expired").when(F.col("o_orderstatus") == "P", "Hospice")
        .otherwise("Home").alias("discharge_category"),
        F.col("o_orderpriority").alias("admission_type_category"), F.col("o_totalprice").alias("charge"))


def patient(spark, sf):
    c, n, r = (table(spark, sf, t) for t in ("customer", "nation", "region"))
    return (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("race_category"),
                    F.col("r_name").alias("ethnicity_category"),
                    F.when(F.col("c_nationkey") % 3 == 0, "Female").when(F.col("c_nationkey") % 3 == 1, "Male")
                    .otherwise("Unknown").alias("sex_category"), F.col("r_name").alias("site"),
                    F.col("c_acctbal").alias("balance")))


def win(spark, sf):
    """Per user: first purchase to last event."""
    return obs(spark, sf).groupBy("encounter_block").agg(
        F.min(F.when(F.col("category") == "purchase", F.col("recorded_dttm"))).alias("start_dttm"),
        F.max("recorded_dttm").alias("end_dttm")).where("start_dttm is not null")


def dx(spark, sf):
    li, p = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(p, li.l_partkey == p.p_partkey).select(
        F.col("l_orderkey").alias("hospitalization_id"), F.col("p_type").alias("diagnosis_type"),
        F.col("p_size").alias("p_size"), F.col("l_linenumber").alias("line"),
        F.concat(F.substring(F.lit("ICEGKBFJM"), (F.col("l_partkey") % 9 + 1).cast("int"), F.lit(1)),
                 F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("."),
                 F.col("l_linenumber").cast("string")).alias("diagnosis_code"),
        F.when(F.col("l_returnflag") == "A", "ICD9CM").otherwise("ICD10CM").alias("diagnosis_code_format"),
        (F.col("l_linenumber") == 1).cast("int").alias("diagnosis_primary"))


CTE = {
    "obs": """obs AS (SELECT user_id AS encounter_block, event_id, ts AS recorded_dttm, event_type AS category,
      value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS setting FROM events)""",
    "stay": """stay AS (SELECT user_id AS encounter_block, event_id, ts AS in_dttm,
      lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS out_dttm,
      CASE event_type WHEN 'error' THEN 'icu' WHEN 'view' THEN 'ward' WHEN 'purchase' THEN 'ed'
        WHEN 'signup' THEN 'procedural' ELSE 'other' END AS location_category, value FROM events)""",
    "resp": """resp AS (SELECT encounter_block, event_id, recorded_dttm,
      CASE category WHEN 'error' THEN 'imv' WHEN 'signup' THEN 'nippv' WHEN 'purchase' THEN 'high flow nc'
        WHEN 'view' THEN 'nasal cannula' END AS device_category,
      CASE CAST(setting AS INT) % 4 WHEN 0 THEN 'assist control-volume control' WHEN 1 THEN 'pressure support/cpap'
        WHEN 2 THEN 'pressure control' END AS mode_category,
      CASE WHEN CAST(setting AS INT) % 3 <> 0 THEN 0.21::DOUBLE + (CAST(setting AS INT) % 80) / 100.0::DOUBLE END AS fio2_set,
      value AS lpm_set, setting AS peep_set, value AS tidal_volume_set FROM obs)""",
    "visit": """visit AS (SELECT event_id AS hospitalization_id, encounter_block AS patient_id,
      recorded_dttm AS admission_dttm, recorded_dttm + to_hours(event_id % 5) AS discharge_dttm,
      event_id % 90 AS age_at_admission,
      CASE WHEN event_id % 17 = 0 THEN 'Expired' WHEN event_id % 17 = 1 THEN 'Hospice' ELSE 'Home' END AS discharge_category,
      CASE category WHEN 'error' THEN 'icu' WHEN 'view' THEN 'ward' WHEN 'purchase' THEN 'ed'
        WHEN 'signup' THEN 'procedural' ELSE 'other' END AS location_category,
      CASE category WHEN 'error' THEN 'imv' WHEN 'signup' THEN 'nippv' WHEN 'purchase' THEN 'high flow nc'
        WHEN 'view' THEN 'nasal cannula' END AS device_category,
      CASE category WHEN 'purchase' THEN 'norepinephrine' WHEN 'error' THEN 'epinephrine' WHEN 'view' THEN 'vasopressin'
        WHEN 'click' THEN 'propofol' ELSE 'dopamine' END AS med_category, value, setting FROM obs)""",
    "blocks": """vm AS (SELECT *, max(discharge_dttm) OVER (PARTITION BY patient_id ORDER BY admission_dttm, hospitalization_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM visit WHERE age_at_admission >= 18),
      vb AS (SELECT *, sum(CASE WHEN pe IS NULL OR epoch_us(admission_dttm) - epoch_us(pe) > 21600000000 THEN 1 ELSE 0 END)
        OVER (PARTITION BY patient_id ORDER BY admission_dttm, hospitalization_id) AS bn FROM vm),
      blocks AS (SELECT *, first_value(hospitalization_id) OVER (PARTITION BY patient_id, bn
        ORDER BY admission_dttm, hospitalization_id) AS encounter_block FROM vb)""",
    "meds": """meds AS (SELECT encounter_block, event_id, encounter_block * 10 + day(recorded_dttm) % 10 AS hospitalization_id,
      recorded_dttm AS admin_dttm, m AS med_category, CASE WHEN m = 'propofol' THEN 'sedation' ELSE 'vasoactives' END AS med_group,
      m || ' ' || CAST(CAST(setting AS INT) % 3 AS VARCHAR) AS med_name, value AS med_dose,
      CASE CAST(setting AS INT) % 5 WHEN 0 THEN 'mg/hr' WHEN 1 THEN 'mcg/kg/min' WHEN 2 THEN 'MCG / kg / Hour' WHEN 3 THEN 'units/min' END AS med_dose_unit
      FROM (SELECT *, CASE category WHEN 'purchase' THEN 'norepinephrine' WHEN 'error' THEN 'epinephrine' WHEN 'view' THEN 'vasopressin'
        WHEN 'click' THEN 'propofol' ELSE 'dopamine' END AS m FROM obs))""",
    "hosp": """hosp AS (SELECT o_orderkey AS hospitalization_id, o_custkey AS patient_id, o_orderdate AS admission_dttm,
      o_orderdate + to_days(CAST(o_orderkey % 40 AS INTEGER)) AS discharge_dttm, o_orderkey % 90 AS age_at_admission,
      CASE o_orderstatus WHEN 'F' THEN 'Expired' WHEN 'P' THEN 'Hospice' ELSE 'Home' END AS discharge_category,
      o_orderpriority AS admission_type_category, o_totalprice AS charge FROM orders)""",
    "patient": """patient AS (SELECT c_custkey AS patient_id, c_mktsegment AS race_category, r_name AS ethnicity_category,
      CASE c_nationkey % 3 WHEN 0 THEN 'Female' WHEN 1 THEN 'Male' ELSE 'Unknown' END AS sex_category, r_name AS site,
      c_acctbal AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey
      JOIN region ON n_regionkey = r_regionkey)""",
    "win": """win AS (SELECT encounter_block, min(recorded_dttm) FILTER (category = 'purchase') AS start_dttm,
      max(recorded_dttm) AS end_dttm FROM obs GROUP BY 1 HAVING min(recorded_dttm) FILTER (category = 'purchase') IS NOT NULL)""",
    "dx": """dx AS (SELECT l_orderkey AS hospitalization_id, p_type AS diagnosis_type, p_size, l_linenumber AS line,
      substr('ICEGKBFJM', CAST(l_partkey % 9 + 1 AS INTEGER), 1) || lpad(CAST(p_size AS VARCHAR), 2, '0') || '.' || CAST(l_linenumber AS VARCHAR) AS diagnosis_code,
      CASE WHEN l_returnflag = 'A' THEN 'ICD9CM' ELSE 'ICD10CM' END AS diagnosis_code_format,
      CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END AS diagnosis_primary
      FROM lineitem JOIN part ON l_partkey = p_partkey)""",
}
NEEDS = {"resp": ["obs"], "meds": ["obs"], "visit": ["obs"], "blocks": ["visit"], "win": ["obs"]}


def with_views(names: str, extra: str, body: str) -> str:
    """SQL text with the named views (and what they need) in front."""
    order: list[str] = []

    def add(n):
        for m in NEEDS.get(n, []):
            add(m)
        if n not in order:
            order.append(n)

    for n in names.split():
        add(n)
    parts = [CTE[n] for n in order] + ([extra.strip().rstrip(",")] if extra.strip() else [])
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
