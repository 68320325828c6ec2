"""Table One, stratified summaries (I) and disclosure control (J)."""

from pyspark.sql import functions as F

from bedside.operators import cohort as H
from bedside.operators import disclosure as X
from bedside.operators import meds as M
from bedside.operators import report as T
from bedside.operators import resp as R
from bedside.operators import rollup as U
from bedside.operators import severity as S
from bedside.plans import cases as C
from bedside.plans import views as V
from bedside.plans.on_cohort import FLAGS, flags, parts
from bedside.plans.on_meds import GROUPS as DRUG_GROUPS
from bedside.plans.on_resp import rnd
from bedside.plans.on_severity import ENC_CCI, enc_cci
from bedside.plans.registry import query
from bedside.sources.tables import materialise

BLOCK = "encounter_block"

def rows_sql(src: str, rows, keys: str) -> str:
    """SQL of the numeric table over ``src``."""
    out = []
    for i, r in enumerate(rows):
        w = f" FILTER ({r.within} = 1)" if r.within else ""
        head, lab = f"SELECT {keys}, {i} AS pos, ", r.label.replace("'", "''")
        null6 = "NULL::DOUBLE AS median, NULL::DOUBLE AS q1, NULL::DOUBLE AS q3"
        if r.kind == "header":
            out.append(head + f"'{lab}' AS label, 'header' AS kind, NULL::DOUBLE AS n, NULL::DOUBLE AS denom, {null6} FROM {src} GROUP BY {keys}")
        elif r.kind in ("count", "distinct"):
            n = "count(*)" if r.kind == "count" else f"count(DISTINCT {r.column})"
            out.append(head + f"'{lab}' AS label, 'count' AS kind, {n}::DOUBLE AS n, NULL::DOUBLE AS denom, {null6} FROM {src} GROUP BY {keys}")
        elif r.kind == "flag":
            cond = f"{r.column} = 1" + (f" AND {r.within} = 1" if r.within else "")
            out.append(head + f"'{lab}' AS label, 'flag' AS kind, (count(*) FILTER ({cond}))::DOUBLE AS n, (count(*){w})::DOUBLE AS denom, {null6} FROM {src} GROUP BY {keys}")
        elif r.kind == "sum":
            out.append(head + f"'{lab}' AS label, 'sum' AS kind, sum({r.column})::DOUBLE AS n, NULL::DOUBLE AS denom, {null6} FROM {src} GROUP BY {keys}")
        elif r.kind == "levels":
            base = f"(SELECT DISTINCT {keys}, patient_id, {r.column} FROM {src})" if r.patient else src
            cond = f" WHERE {r.within} = 1" if r.within else ""
            out.append(head + f"'{lab}: ' || coalesce({r.column}, 'Missing') AS label, 'flag' AS kind, count(*)::DOUBLE AS n, sum(count(*)) OVER (PARTITION BY {keys})::DOUBLE AS denom, {null6} "
                       f"FROM {base}{cond} GROUP BY {keys}, {r.column}")
        elif r.kind == "median":
            out.append(head + f"'{lab}' AS label, 'median' AS kind, count({r.column}){w}::DOUBLE AS n, NULL::DOUBLE AS denom, quantile_cont({r.column}, 0.5){w} AS median, "
                       f"quantile_cont({r.column}, 0.25){w} AS q1, quantile_cont({r.column}, 0.75){w} AS q3 FROM {src} GROUP BY {keys} HAVING count({r.column}){w} > 0")
    return " UNION ALL ".join(out)


def final_sql(inner, keys):
    return (f"SELECT {keys}, pos, label, kind, round(n, 4) AS n, denom, round(median, 9) AS median, round(q1, 9) AS q1, round(q3, 9) AS q3, "
            f"round(CASE WHEN denom <> 0 THEN n * 100 / denom END, 6) AS pct FROM ({inner})")


def tidy(numbers):
    return rnd(rnd(rnd(numbers, ["pct"]), ["n"], 4), ["median", "q1", "q3"], 9)


ROWS, WARD = T.table_one_rows(), T.table_one_rows(ward=True)


def case_query(name, cte="", sql=""):
    """Registers a query over the case features."""
    return query(name, sql=C.sql(cte, sql))


@case_query("i1_features", sql="SELECT encounter_block, " + ", ".join(
    f"round({c}, {C.DECIMAL[c]}) AS {c}" if c in C.DECIMAL else c for c in C.COLUMNS) + " FROM encs")
def i1f(spark, sf):
    return C.features(spark, sf).select(BLOCK, *C.COLUMNS).withColumns({c: F.round(c, n) for c, n in C.DECIMAL.items()})


@case_query("i1_table_one", "src AS (SELECT *, 'critical illness' AS cohort FROM encs WHERE cohort_enc = 1)", final_sql(rows_sql("src", ROWS, "cohort"), "cohort"))
def i1(spark, sf):
    return tidy(U.table_one(C.encounters(spark, sf), ROWS, {"critical illness": "cohort_enc"}).drop("col").withColumnRenamed("stratum", "cohort"))


@case_query("i1_table_one_ward", "src AS (SELECT *, 'ward' AS cohort FROM encs WHERE ward_enc = 1)", final_sql(rows_sql("src", WARD, "cohort"), "cohort"))
def i1w(spark, sf):
    return tidy(U.table_one(C.encounters(spark, sf), WARD, {"ward": "ward_enc"}).drop("col").withColumnRenamed("stratum", "cohort"))


YEAR = "src AS (SELECT *, unnest(['Overall', CAST(admission_year AS VARCHAR)]) AS col FROM encs WHERE cohort_enc = 1)"


def by_year(spark, sf):
    return U.table_one(C.encounters(spark, sf), ROWS, {"cohort": "cohort_enc"}, "admission_year").drop("stratum")


@case_query("i2_table_one_by_year", YEAR, final_sql(rows_sql("src", ROWS, "col"), "col"))
def i2(spark, sf):
    return tidy(by_year(spark, sf))


STRATA = "ms AS (" + " UNION ALL ".join(f"SELECT '{s}' AS stratum, * FROM encs WHERE {c} = 1" for s, c in H.STRATA.items()) + ")"
#: Years are shown for the strata that are no part of another.
TOP = {s: c for s, c in H.STRATA.items() if "/" not in s}
YEARS = "unnest(CASE WHEN contains(stratum, '/') THEN ['Overall'] ELSE ['Overall', CAST(admission_year AS VARCHAR)] END) AS col"


def stratified(spark, sf):
    """Numbers of all strata, and of the top-level ones by year."""
    return U.table_one(C.encounters(spark, sf), ROWS, H.STRATA, "admission_year").where(~F.col("stratum").contains("/") | (F.col("col") == "Overall"))


@case_query("i3_table_one_by_stratum", STRATA + f", src AS (SELECT *, {YEARS} FROM ms)", final_sql(rows_sql("src", ROWS, "stratum, col"), "stratum, col"))
def i3(spark, sf):
    return tidy(stratified(spark, sf))


# after the last line of the table that the extra ones follow
ANCHOR = "Hospital length of stay (days), median [Q1, Q3]"


@case_query("i4_stratum_extra_rows", STRATA, final_sql(rows_sql("ms", T.EXTRA_ROWS, "stratum"), "stratum"))
def i4(spark, sf):
    return tidy(U.table_one(C.encounters(spark, sf), T.EXTRA_ROWS, H.STRATA).drop("col"))


@case_query("i4_rows_after_anchor", STRATA + f", a AS ({rows_sql('ms', ROWS, 'stratum')}), x AS ({rows_sql('ms', T.EXTRA_ROWS, 'stratum')}), k AS (SELECT max(pos) AS p FROM a WHERE label = '{ANCHOR}')",
            "SELECT stratum, CAST(pos AS DOUBLE) AS pos, label, round(n, 4) AS n FROM a UNION ALL SELECT stratum, round(p + (pos + 1) / 1000.0::DOUBLE, 6), label, round(n, 4) FROM x, k")
def i4a(spark, sf):
    e = C.encounters(spark, sf)
    d = T.insert_after(U.table_one(e, ROWS, H.STRATA), U.table_one(e, T.EXTRA_ROWS, H.STRATA), ANCHOR)
    return d.select("stratum", F.round("pos", 6).alias("pos"), "label", F.round("n", 4).alias("n"))


def cell_sql() -> str:
    """Text of a numeric line."""
    one = lambda c: f"printf('%.1f', round_even({c}, 1))"
    return (f"CASE kind WHEN 'median' THEN {one('median')} || ' [' || {one('q1')} || ', ' || {one('q3')} || ']' WHEN 'flag' THEN "
            f"format('{{:,}}', CAST(n AS BIGINT)) || CASE WHEN denom > 0 THEN ' (' || printf('%.1f', round_even(n * 100 / denom, 1)) || '%)' ELSE '' END WHEN 'header' THEN '' ELSE format('{{:,}}', CAST(n AS BIGINT)) END")


PAIR_VALUES = "pr AS (SELECT * FROM (VALUES " + ", ".join(f"('{a} | {b}', '{a}', '{b}')" for a, b in T.PAIRS) + ") t(pair, l, r))"


@case_query("i5_substratum_pairs", STRATA + f", num AS ({rows_sql('ms', ROWS, 'stratum')}), tx AS (SELECT stratum, label, {cell_sql()} AS cell FROM num)",
            """SELECT coalesce(a.label, b.label) AS label, coalesce(a.cell, '') AS icu, coalesce(b.cell, '') AS no_icu
  FROM (SELECT * FROM tx WHERE stratum = 'vaso/icu') a FULL JOIN (SELECT * FROM tx WHERE stratum = 'vaso/no_icu') b USING (label)""")
def i5(spark, sf):
    pair = {s: H.STRATA[s] for s in ("vaso/icu", "vaso/no_icu")}
    return T.pair_substrata(U.table_one(C.encounters(spark, sf), ROWS, pair), *pair).select("label", "icu", "no_icu")


@case_query("i5_all_pairs", STRATA + f", num AS ({rows_sql('ms', ROWS, 'stratum')}), {PAIR_VALUES}, tx AS (SELECT pair, label, stratum = l AS on_left, {cell_sql()} AS cell FROM num JOIN pr ON stratum = l OR stratum = r)",
            """SELECT pair, label, coalesce(max(cell) FILTER (on_left), '') AS "left", coalesce(max(cell) FILTER (NOT on_left), '') AS "right" FROM tx GROUP BY 1, 2""")
def i5a(spark, sf):
    pairs = {s: H.STRATA[s] for p in T.PAIRS for s in p}
    return T.all_pairs(U.table_one(C.encounters(spark, sf), ROWS, pairs)).select("pair", "label", "left", "right")


@query("i6_level_counts", views="hosp patient", sql="""SELECT ethnicity_category, coalesce(race_category, 'Missing') AS level, count(*) AS n, round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY ethnicity_category), 6) AS pct
  FROM patient GROUP BY 1, 2""")
def i6(spark, sf):
    return rnd(T.level_counts(V.patient(spark, sf), ["ethnicity_category"], "race_category"), ["pct"])


@query("i7_median_rows", views="hosp", sql="""SELECT admission_type_category, 'charge' AS metric, count(*) AS n, round(quantile_cont(charge, 0.5), 6) AS median, round(quantile_cont(charge, 0.25), 6) AS q1,
  round(quantile_cont(charge, 0.75), 6) AS q3 FROM hosp GROUP BY 1 UNION ALL SELECT admission_type_category, 'age_at_admission', count(*), quantile_cont(age_at_admission, 0.5), quantile_cont(age_at_admission, 0.25),
  quantile_cont(age_at_admission, 0.75) FROM hosp GROUP BY 1""")
def i7(spark, sf):
    return rnd(T.median_rows(V.hosp(spark, sf), ["admission_type_category"], ["charge", "age_at_admission"]), ["median", "q1", "q3"])


@query("i8_median_of_triples", views="obs resp", cte="s AS (SELECT encounter_block, encounter_block % 4 AS g, quantile_cont(peep_set, 0.5) AS m, quantile_cont(peep_set, 0.25) AS a, quantile_cont(peep_set, 0.75) AS b FROM resp GROUP BY ALL)",
       sql="SELECT g AS site, count(*) AS n, round(quantile_cont(m, 0.5), 6) AS m_peep_set_median, round(quantile_cont(a, 0.5), 6) AS m_peep_set_q1, round(quantile_cont(b, 0.5), 6) AS m_peep_set_q3 FROM s GROUP BY 1")
def i8(spark, sf):
    s = R.setting_statistics(V.resp(spark, sf), ["peep_set"], [BLOCK]).withColumn("site", F.col(BLOCK) % 4)
    return rnd(T.median_of_triples(s, ["site"], ["peep_set"]), ["m_peep_set_median", "m_peep_set_q1", "m_peep_set_q3"])


@query("i9_condition_rows", views="dx hosp", cte=ENC_CCI, sql="SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{c}' AS condition, CAST(sum({c}) AS BIGINT) AS n, round(sum({c}) * 100.0::DOUBLE / count(*), 6) AS pct FROM ec" for c in S.CHARLSON) + ") WHERE n > 0")
def i9(spark, sf):
    return rnd(T.condition_rows(enc_cci(spark, sf), []), ["pct"])


RACES, ETHS, SEXES = ["BUILDING", "MACHINERY", "HOUSEHOLD", "Unseen"], ["ASIA", "EUROPE", "AFRICA", "AMERICA"], ["Female", "Male"]
NIH = """ct AS (SELECT race_category AS r, ethnicity_category AS e, sex_category AS s, count(*) AS n FROM patient GROUP BY ALL),
  gr AS (SELECT unnest(['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'Unseen']) AS r), ge AS (SELECT unnest(['ASIA', 'EUROPE', 'AFRICA', 'AMERICA']) AS e), gs AS (SELECT unnest(['Female', 'Male']) AS s),
  bd AS (SELECT r, e, s, coalesce(n, 0) AS n FROM gr CROSS JOIN ge CROSS JOIN gs LEFT JOIN ct USING (r, e, s)), hd AS (SELECT * FROM bd WHERE n BETWEEN 1 AND 19),
  sg AS (SELECT * FROM ct UNION ALL SELECT r, e, s, -n FROM hd)"""


@query("i10_demographic_crosstab", views="patient", cte=NIH, sql="""SELECT r AS race_category, e AS ethnicity_category, s AS sex_category, CASE WHEN n BETWEEN 1 AND 19 THEN NULL ELSE n END AS n,
    CASE WHEN n BETWEEN 1 AND 19 THEN '<20' ELSE CAST(n AS VARCHAR) END AS text FROM bd
  UNION ALL SELECT r, 'Total', '', coalesce(CAST(sum(n) AS BIGINT), 0), CAST(coalesce(sum(n), 0) AS VARCHAR) FROM gr LEFT JOIN sg USING (r) GROUP BY 1
  UNION ALL SELECT 'Total', e, s, coalesce(CAST(sum(n) AS BIGINT), 0), CAST(coalesce(sum(n), 0) AS VARCHAR) FROM ge CROSS JOIN gs LEFT JOIN sg USING (e, s) GROUP BY 2, 3
  UNION ALL SELECT 'Total', 'Total', '', CAST(sum(n) AS BIGINT), CAST(sum(n) AS VARCHAR) FROM sg""")
def i10(spark, sf):
    return T.demographic_crosstab(V.patient(spark, sf), None, RACES, ETHS, SEXES, 20)


@query("i11_latest_code_status", views="obs", sql="""SELECT encounter_block AS patient_id, arg_max(CASE WHEN category = 'click' THEN NULL ELSE category END, recorded_dttm) FILTER (category <> 'click') AS last_code_status_category FROM obs GROUP BY 1""")
def i11(spark, sf):
    return T.latest_code_status(codes(spark, sf), "event_id")


def codes(spark, sf):
    return V.obs(spark, sf).select(F.col(BLOCK).alias("patient_id"), "event_id", F.col("recorded_dttm").alias("start_dttm"),
                                   F.when(F.col("category") != "click", F.col("category")).alias("code_status_category"))


TYPES = {"ICU": "icu_enc", "Respiratory": "high_support_enc", "Vasoactive": "vaso_support_enc"}


@query("i12_code_status_by_type", views="blocks", cte=FLAGS + """, st AS (SELECT *, CASE encounter_block % 4 WHEN 0 THEN 'Full' WHEN 1 THEN 'DNR' WHEN 2 THEN 'DNR/DNI' END AS cs FROM flags),
  cg AS (""" + " UNION ALL ".join(f"SELECT '{t}' AS t, coalesce(cs, 'Missing') AS s, count(*) AS n FROM st WHERE {c} = 1 GROUP BY 2" for t, c in TYPES.items()) + """),
  bt AS (SELECT * FROM cg UNION ALL SELECT 'Total', s, CAST(sum(n) AS BIGINT) FROM cg GROUP BY 2), tt AS (SELECT t, CAST(sum(n) AS BIGINT) AS tn, coalesce(sum(n) FILTER (s = 'Missing'), 0) AS m FROM bt GROUP BY 1)""",
       sql="""SELECT t AS encounter_type, s AS code_status, n, round_even(n * 100.0::DOUBLE / tn, 2) AS pct, CASE WHEN s <> 'Missing' THEN round_even(n * 100.0::DOUBLE / (tn - m), 4) END AS pct_known, NULL::DOUBLE AS pct_missing
  FROM bt JOIN tt USING (t) UNION ALL SELECT t, 'Total', tn, 100.0::DOUBLE, NULL, round_even(m * 100.0::DOUBLE / tn, 2) FROM tt""")
def i12(spark, sf):
    k = F.col(BLOCK) % 4
    e = flags(spark, sf).withColumn("last_code_status_category", F.when(k == 0, "Full").when(k == 1, "DNR").when(k == 2, "DNR/DNI"))
    return T.code_status_by_type(e, TYPES)


@query("i13_comorbidity_prevalence", views="dx hosp", cte=ENC_CCI, sql=" UNION ALL ".join(f"""SELECT '{c}' AS comorbidity, CAST(sum({c}) AS BIGINT) AS n_patients, round_even(sum({c}) * 100.0::DOUBLE / count(*), 2) AS prevalence_percent,
  round_even(sum({c}) * 1000.0::DOUBLE / count(*), 1) AS per_1000_hospitalizations FROM ec""" for c in S.CHARLSON))
def i13(spark, sf):
    return T.comorbidity_prevalence(enc_cci(spark, sf))


@query("i13_comorbidity_headline", views="dx hosp", cte=ENC_CCI + ", pv AS (" + " UNION ALL ".join(f"SELECT '{c}' AS c, sum({c}) AS n, count(*) AS t FROM ec" for c in S.CHARLSON) + ")",
       sql="""SELECT CAST(sum(n) AS BIGINT) AS total_comorbidities, arg_max(c, n) AS most_common, round_even(max(n * 1000.0::DOUBLE / t), 1) AS most_common_per_1000, any_value(t) AS n_total,
  round_even(sum(n)::DOUBLE / any_value(t), 2) AS avg_per_hospitalization FROM pv""")
def i13h(spark, sf):
    e = materialise(enc_cci(spark, sf), "cci")
    return T.comorbidity_headline(T.comorbidity_prevalence(e), e.agg(F.count(F.lit(1)).alias("n_total")))


Z = "1.959963984540054::DOUBLE"
EOL = f"""(h / o::DOUBLE + {Z} * {Z} / (2 * o)) / (1 + {Z} * {Z} / o) {{s}} {Z} * sqrt((h / o::DOUBLE * (1 - h / o::DOUBLE) + {Z} * {Z} / (4 * o)) / o) / (1 + {Z} * {Z} / o)"""
LO, HI = f"greatest({EOL.format(s='-')}, 0) * 100", f"least({EOL.format(s='+')}, 1) * 100"


@case_query("i14_hospice_trends", "y AS (SELECT admission_year, count(*) AS n, CAST(sum(hospice_outcome) AS BIGINT) AS h, CAST(sum(expired_outcome) AS BIGINT) AS x, CAST(sum(hospice_or_expired) AS BIGINT) AS o FROM encs GROUP BY 1)",
            f"""SELECT admission_year, n AS total_encounters, h AS hospice, x AS expired, o AS hospice_or_expired, round(h * 100.0::DOUBLE / n, 6) AS hospice_pct, round(x * 100.0::DOUBLE / n, 6) AS mortality_pct,
  round(h * 100.0::DOUBLE / o, 6) AS hospice_among_eol_pct, round({LO}, 6) AS ci_lower, round({HI}, 6) AS ci_upper FROM y""")
def i14(spark, sf):
    return rnd(T.hospice_trends(C.encounters(spark, sf)), ["hospice_pct", "mortality_pct", "hospice_among_eol_pct", "ci_lower", "ci_upper"])


@case_query("i15_comorbidity_outcomes", """g5 AS (SELECT * FROM encs WHERE cci_score IS NOT NULL), y0 AS (SELECT admission_year, CASE WHEN cci_score <= 0 THEN '0 (No comorbidity)' WHEN cci_score <= 2 THEN '1-2 (Mild)' WHEN cci_score <= 4 THEN '3-4 (Moderate)' ELSE '5+ (Severe)' END AS cci_category,
    count(*) AS n, CAST(sum(hospice_outcome) AS BIGINT) AS h, CAST(sum(expired_outcome) AS BIGINT) AS x, CAST(sum(hospice_or_expired) AS BIGINT) AS o FROM g5 GROUP BY 1, 2),
    y AS (SELECT admission_year, cci_category, coalesce(n, 0) AS n, coalesce(h, 0) AS h, coalesce(x, 0) AS x, coalesce(o, 0) AS o FROM (SELECT DISTINCT admission_year FROM encs)
      CROSS JOIN (SELECT unnest(['0 (No comorbidity)', '1-2 (Mild)', '3-4 (Moderate)', '5+ (Severe)']) AS cci_category) LEFT JOIN y0 USING (admission_year, cci_category))""",
            f"""SELECT admission_year, cci_category, n AS total_encounters, h AS hospice, x AS expired, o AS hospice_or_expired, round(h * 100.0::DOUBLE / nullif(n, 0), 6) AS hospice_pct, round(x * 100.0::DOUBLE / nullif(n, 0), 6) AS mortality_pct,
  round(h * 100.0::DOUBLE / nullif(o, 0), 6) AS hospice_among_eol_pct, CASE WHEN o > 0 THEN round({LO}, 6) END AS ci_lower, CASE WHEN o > 0 THEN round({HI}, 6) END AS ci_upper,
  round(o * 100.0::DOUBLE / nullif(n, 0), 6) AS combined_eol_pct,
  round(h * 100.0::DOUBLE / nullif(x, 0), 6) AS hospice_capture_rate FROM y""")
def i15(spark, sf):
    return rnd(T.comorbidity_outcomes(C.encounters(spark, sf)), ["hospice_pct", "mortality_pct", "hospice_among_eol_pct", "ci_lower", "ci_upper", "combined_eol_pct", "hospice_capture_rate"])


def case_members(spark, sf):
    e = C.encounters(spark, sf)
    return H.stratum_members(e, keep=e.columns)


MEM = FLAGS + ", mb AS (" + " UNION ALL ".join(f"SELECT '{s}' AS stratum, encounter_block FROM flags WHERE {c} = 1" for s, c in H.STRATA.items()) + ")"


def members(spark, sf):
    return H.stratum_members(flags(spark, sf))


@query("i16_settings_by_stratum", views="blocks", cte=MEM, sql="""SELECT stratum, device_category, count(setting) AS peep_set_n, round(avg(setting), 6) AS peep_set_mean, round(stddev_samp(setting), 6) AS peep_set_sd,
  round(quantile_cont(setting, 0.5), 6) AS peep_set_median, round(quantile_cont(setting, 0.25), 6) AS peep_set_q1, round(quantile_cont(setting, 0.75), 6) AS peep_set_q3
  FROM mb JOIN blocks USING (encounter_block) WHERE device_category IS NOT NULL GROUP BY 1, 2""")
def i16(spark, sf):
    r = V.blocks(spark, sf).select(BLOCK, "device_category", F.col("setting").alias("peep_set"))
    s = R.setting_statistics(members(spark, sf).join(r, BLOCK), ["peep_set"], ["stratum", "device_category"])
    return rnd(s, ["peep_set_mean", "peep_set_sd", "peep_set_median", "peep_set_q1", "peep_set_q3"])


@query("i16_drugs_by_stratum", views="blocks", cte=MEM + """, ic AS (SELECT encounter_block, min(admission_dttm) AS i FROM blocks WHERE location_category = 'icu' GROUP BY 1),
  tn AS (SELECT stratum, count(*) AS t FROM mb JOIN ic USING (encounter_block) GROUP BY 1),
  wk AS (SELECT mb.stratum, b.* FROM mb JOIN blocks b USING (encounter_block) JOIN ic USING (encounter_block) WHERE floor((epoch_us(admission_dttm) - epoch_us(i)) / 3600000000.0::DOUBLE) BETWEEN 0 AND 167)""",
       sql="""SELECT stratum, med_category AS medication, count(DISTINCT encounter_block) AS n_encounters, count(value) AS n_admin, round(count(DISTINCT encounter_block) * 100.0::DOUBLE / any_value(t), 6) AS pct_encounters,
  round(quantile_cont(value, 0.5), 6) AS median_dose FROM wk JOIN tn USING (stratum) GROUP BY 1, 2""")
def i16d(spark, sf):
    b = V.blocks(spark, sf)
    icu = b.where("location_category = 'icu'").groupBy(BLOCK).agg(F.min("admission_dttm").alias("first_icu_in_dttm"))
    m = b.select(BLOCK, "med_category", F.col("admission_dttm").alias("admin_dttm"), F.col("value").alias("med_dose"), F.lit("mcg").alias("med_dose_unit"))
    mem = members(spark, sf)
    total = mem.join(icu, BLOCK).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_icu"))
    d = M.drug_summary(mem.join(M.with_icu_hour(m, icu), BLOCK), total, DRUG_GROUPS, ["stratum"])
    return rnd(d.select("stratum", "medication", "n_encounters", "n_admin", "pct_encounters", "median_dose"), ["pct_encounters", "median_dose"])


@case_query("i16_conditions_by_stratum", STRATA, " UNION ALL ".join(f"""SELECT stratum, '{c}' AS comorbidity, CAST(coalesce(sum({c}), 0) AS BIGINT) AS n_patients,
  round_even(coalesce(sum({c}), 0) * 100.0::DOUBLE / count(*), 2) AS prevalence_percent, round_even(coalesce(sum({c}), 0) * 1000.0::DOUBLE / count(*), 1) AS per_1000_hospitalizations
  FROM ms GROUP BY 1""" for c in S.CHARLSON))
def i16c(spark, sf):
    return T.comorbidity_prevalence(case_members(spark, sf), ["stratum"])


HOURS = """, ic AS (SELECT encounter_block, min(admission_dttm) AS i FROM blocks WHERE location_category = 'icu' GROUP BY 1), tn AS (SELECT stratum, count(*) AS t FROM mb JOIN ic USING (encounter_block) GROUP BY 1),
  wk AS (SELECT mb.stratum, b.encounter_block, med_category, CAST(floor((epoch_us(admission_dttm) - epoch_us(i)) / 3600000000.0::DOUBLE) AS INTEGER) AS hb
    FROM mb JOIN blocks b USING (encounter_block) JOIN ic USING (encounter_block)),
  sn AS (SELECT stratum, hb, med_category, count(DISTINCT encounter_block) AS n FROM wk GROUP BY ALL)"""


@query("i16_hourly_exposure_by_stratum", views="blocks", cte=MEM + HOURS, sql=f"""SELECT tn.stratum, CAST(hour AS INTEGER) AS hour, medication, coalesce(n, 0) AS n, round(coalesce(n, 0) * 100.0::DOUBLE / t, 6) AS pct
  FROM tn CROSS JOIN (SELECT unnest(range(168)) AS hour) CROSS JOIN (SELECT unnest([{', '.join(repr(d) for ds in DRUG_GROUPS.values() for d in ds)}]) AS medication)
  LEFT JOIN sn ON sn.stratum = tn.stratum AND hb = hour AND med_category = medication""")
def i16h(spark, sf):
    b = V.blocks(spark, sf)
    icu = b.where("location_category = 'icu'").groupBy(BLOCK).agg(F.min("admission_dttm").alias("first_icu_in_dttm"))
    mem = materialise(members(spark, sf), "members")
    total = mem.join(icu, BLOCK).groupBy("stratum").agg(F.count(F.lit(1)).alias("n_icu"))
    m = M.with_icu_hour(b.select(BLOCK, "med_category", F.col("admission_dttm").alias("admin_dttm")), icu).join(mem, BLOCK)
    return rnd(M.hourly_exposure(m, total, DRUG_GROUPS, ["stratum"]), ["pct"])


@case_query("i16_sofa_mortality_by_stratum", STRATA + """, mo AS (SELECT stratum, sofa_total AS s, count(*) AS n, sum(death_enc) AS k FROM ms WHERE sofa_total IS NOT NULL GROUP BY 1, 2)""",
            """SELECT stratum, s AS sofa_score, CAST(sum(n) OVER (PARTITION BY stratum) AS BIGINT) AS total_encounters, n AS n_encounters, CAST(k AS BIGINT) AS n_deaths FROM mo""")
def i16s(spark, sf):
    return S.sofa_mortality(case_members(spark, sf), ["stratum"]).select("stratum", "sofa_score", "total_encounters", "n_encounters", "n_deaths")


@case_query("i16_crosstab_by_stratum", STRATA + """, pt AS (SELECT DISTINCT stratum, patient_id, race_category AS r, ethnicity_category AS e, sex_category AS s FROM ms), ct AS (SELECT stratum, r, e, s, count(*) AS n FROM pt GROUP BY ALL),
  sts AS (SELECT DISTINCT stratum FROM ct), gr AS (SELECT unnest(['BUILDING', 'MACHINERY', 'HOUSEHOLD', 'Unseen']) AS r), ge AS (SELECT unnest(['ASIA', 'EUROPE', 'AFRICA', 'AMERICA']) AS e), gs AS (SELECT unnest(['Female', 'Male']) AS s),
  bd AS (SELECT stratum, r, e, s, coalesce(n, 0) AS n FROM sts CROSS JOIN gr CROSS JOIN ge CROSS JOIN gs LEFT JOIN ct USING (stratum, r, e, s)), sg AS (SELECT * FROM ct UNION ALL SELECT stratum, r, e, s, -n FROM bd WHERE n BETWEEN 1 AND 1)""",
            """SELECT stratum, r AS race_category, e AS ethnicity_category, s AS sex_category, CASE WHEN n = 1 THEN NULL ELSE n END AS n FROM bd
  UNION ALL SELECT stratum, r, 'Total', '', coalesce(CAST(sum(n) AS BIGINT), 0) FROM sts CROSS JOIN gr LEFT JOIN sg USING (stratum, r) GROUP BY 1, 2
  UNION ALL SELECT stratum, 'Total', e, s, coalesce(CAST(sum(n) AS BIGINT), 0) FROM sts CROSS JOIN ge CROSS JOIN gs LEFT JOIN sg USING (stratum, e, s) GROUP BY 1, 3, 4
  UNION ALL SELECT stratum, 'Total', 'Total', '', CAST(sum(n) AS BIGINT) FROM sg GROUP BY 1""")
def i16x(spark, sf):
    p = case_members(spark, sf).select("stratum", "patient_id", "race_category", "ethnicity_category", "sex_category").distinct()
    return T.demographic_crosstab(p, ["stratum"], RACES, ETHS, SEXES, 2).drop("text")


@query("i17_outcome_inconsistencies", views="blocks", cte=FLAGS + """, rw AS (SELECT b.hospitalization_id, encounter_block, death_enc, CASE WHEN discharge_category = 'Expired' THEN 1 ELSE 0 END AS x,
  CASE WHEN discharge_category = 'Hospice' THEN 1 ELSE 0 END AS h FROM blocks b JOIN flags USING (encounter_block))""",
       sql="SELECT hospitalization_id, encounter_block FROM rw WHERE death_enc = 1 AND encounter_block IN (SELECT encounter_block FROM rw WHERE death_enc = 1 AND x = 0 AND h = 0)")
def i17(spark, sf):
    adt = parts(spark, sf)[0]
    d = adt.join(H.location_flags(adt).select(BLOCK, "death_enc"), BLOCK).withColumns({
        "expired_outcome": (F.col("discharge_category") == "Expired").cast("int"), "hospice_outcome": (F.col("discharge_category") == "Hospice").cast("int")})
    return T.outcome_inconsistencies(d).select("hospitalization_id", BLOCK)


@query("i18_summary_by_group", views="obs resp", sql=" UNION ALL ".join(f"""SELECT device_category, '{c}' AS variable, count({c}) AS "N", count(*) - count({c}) AS missing, round(min({c}), 6) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS median, round(quantile_cont({c}, 0.75), 6) AS q75, round(avg({c}), 6) AS mean, round(max({c}), 6) AS max FROM resp GROUP BY 1""" for c in ("fio2_set", "peep_set")))
def i18(spark, sf):
    return rnd(T.summary_by_group(V.resp(spark, sf), ["fio2_set", "peep_set"], ["device_category"]), ["min", "q25", "median", "q75", "mean", "max"])


def display(spark, sf):
    return T.display_table(by_year(spark, sf), [], "col", ["Overall", "2024", "2025", "2026"])


SOFA_POS = next(i for i, r in enumerate(ROWS) if r.label == "SOFA Scores")


@case_query("i19_demographics_slice", YEAR + f", num AS ({rows_sql('src', ROWS, 'col')}), tx AS (SELECT pos, label, col, {cell_sql()} AS cell FROM num WHERE pos < {SOFA_POS})",
            "SELECT label, " + ", ".join(f"coalesce(max(cell) FILTER (col = '{c}'), '') AS \"{c}\"" for c in ("Overall", "2024", "2025", "2026")) + " FROM tx GROUP BY pos, label")
def i19(spark, sf):
    return T.demographics_slice(display(spark, sf)).drop("line")


HEAD = "src AS (SELECT *, 'Overall' AS col FROM encs WHERE cohort_enc = 1)"


@case_query("i20_headline", HEAD + f", num AS ({rows_sql('src', ROWS, 'col')}), tx AS (SELECT label, {cell_sql()} AS cell FROM num), nm AS (SELECT * FROM (VALUES "
            + ", ".join(f"('{k}', '{v}')" for k, v in T.HEADLINES.items()) + ") t(label, name))",
            """SELECT 'flow' AS section, '5_all_critically_ill' AS name, CAST(count(*) AS VARCHAR) AS value FROM src
  UNION ALL SELECT 'mortality', 'All', printf('%.6f', sum(death_enc) * 100.0::DOUBLE / count(*)) FROM src UNION ALL SELECT 'kpi', name, cell FROM tx JOIN nm ON trim(tx.label) = nm.label""")
def i20(spark, sf):
    e = C.encounters(spark, sf).where("cohort_enc = 1")
    flow = e.agg(F.lit("5_all_critically_ill").alias("count_name"), F.count(F.lit(1)).alias("count_value"))
    lines = T.display_table(U.table_one(e, ROWS, {"Overall": "cohort_enc"}), [], "col", ["Overall"])
    rate = H.mortality_by_group(e, {"All": None}).withColumn("count_value", F.format_string("%.6f", "count_value"))
    return T.headline(flow, rate, lines)


# Result cells with many small counts: parts per size (row) and brand (column).
CELLS = """cn AS (SELECT p_brand AS c, p_size AS s, count(*) AS n FROM part GROUP BY ALL), ct AS (SELECT c, sum(n) AS t FROM cn GROUP BY 1),
  cells AS (SELECT 'parts' AS "table", s AS pos, CASE WHEN s % 10 = 0 THEN 'N: ' || s WHEN s % 10 = 1 THEN 'plain ' || s ELSE 'Size' || (s // 10) || ': ' || s END AS label, c AS col, n,
    CAST((n * 1000) // t AS BIGINT) AS p10, CASE WHEN s % 7 = 0 THEN '' WHEN s % 5 = 0 THEN CAST(n AS VARCHAR) ELSE n || ' (' || ((n * 1000) // t)::BIGINT // 10 || '.' || ((n * 1000) // t)::BIGINT % 10 || '%)' END AS cell
    FROM cn JOIN ct USING (c)),
  pz AS (SELECT *, CASE WHEN contains(label, ': ') THEN split_part(label, ': ', 1) ELSE '' END AS variable, CASE WHEN contains(label, ': ') THEN split_part(label, ': ', 2) ELSE label END AS value,
    CASE WHEN cell <> '' THEN n END AS cn, CASE WHEN cell LIKE '%(%' THEN p10 / 10.0::DOUBLE END AS cp FROM cells)"""


def cells(spark, sf):
    p = V.table(spark, sf, "part").groupBy("p_brand", "p_size").agg(F.count(F.lit(1)).alias("n"))
    t = p.groupBy("p_brand").agg(F.sum("n").alias("t"))
    s, p10 = F.col("p_size"), F.floor(F.col("n") * 1000 / F.col("t"))
    label = (F.when(s % 10 == 0, F.concat(F.lit("N: "), s)).when(s % 10 == 1, F.concat(F.lit("plain "), s))
             .otherwise(F.concat(F.lit("Size"), F.floor(s / 10).cast("string"), F.lit(": "), s)))
    cell = (F.when(s % 7 == 0, "").when(s % 5 == 0, F.col("n").cast("string")).otherwise(F.concat(
        F.col("n").cast("string"), F.lit(" ("), F.floor(p10 / 10).cast("string"), F.lit("."), (p10 % 10).cast("string"), F.lit("%)"))))
    return p.join(t, "p_brand").select(F.lit("parts").alias("table"), s.alias("pos"), label.alias("label"), F.col("p_brand").alias("column"), cell.alias("cell"))


@query("j1_parse_cells", cte=CELLS, sql="""SELECT col AS "column", pos, variable, value, cn AS n, cp AS pct FROM pz""")
def j1(spark, sf):
    return X.parsed(cells(spark, sf)).select("column", "pos", "variable", "value", "n", "pct")


MERGE = CELLS + """, ru AS (SELECT * FROM (VALUES ('Size1', 'Other', '12'), ('Size1', 'Other', '13'), ('Size1', 'Other', '14'), ('Size1', 'Other', '15'), ('Size2', 'Rest', '22'), ('Size2', 'Rest', '23')) t(variable, ml, value)),
  mj AS (SELECT pz.*, ml FROM pz LEFT JOIN ru USING (variable, value)),
  mg AS (SELECT col, variable, ml, sum(cn) AS n, first(cn ORDER BY pos) FILTER (cp IS NOT NULL) AS sn, first(cp ORDER BY pos) FILTER (cp IS NOT NULL) AS sp FROM mj WHERE ml IS NOT NULL GROUP BY ALL),
  mp AS (SELECT variable, ml, min(pos) AS pos FROM mj WHERE ml IS NOT NULL GROUP BY ALL),
  md AS (SELECT col, pos, label, cell, cn AS n, cp AS pct, variable, value FROM mj WHERE ml IS NULL UNION ALL SELECT col, pos, variable || ': ' || ml, NULL, CAST(n AS BIGINT), CASE WHEN sp > 0 THEN n / (sn / sp * 100) * 100 END, variable, ml
    FROM mg JOIN mp USING (variable, ml))"""


def rules(spark):
    return spark.createDataFrame([("Size1", "Other", x) for x in ("12", "13", "14", "15")] + [("Size2", "Rest", x) for x in ("22", "23")],
                                 "variable string, merged_label string, source_value string")


@query("j2_merge_levels", cte=MERGE, sql="""SELECT col AS "column", pos, label, n, round(pct, 6) AS pct FROM md""")
def j2(spark, sf):
    return rnd(X.merge_levels(cells(spark, sf), rules(spark)).select("column", "pos", "label", "n", "pct"), ["pct"])


PLAN = """, gp AS (SELECT col, variable, sum(n) AS t, count(*) FILTER (n > 0 AND n < {th}) AS k, arg_min(pos, n * 1000000 + pos) FILTER (NOT (n > 0 AND n < {th})) AS sib FROM {src} WHERE n IS NOT NULL GROUP BY ALL),
  pl AS (SELECT s.*, CASE WHEN variable = 'N' OR n IS NULL OR coalesce(k, 0) = 0 THEN NULL WHEN t > 0 AND t < {th} THEN 'group' WHEN n > 0 AND n < {th} THEN 'small'
    WHEN {comp} AND k = 1 AND pos = sib THEN 'complementary' END AS reason, CASE WHEN {comp} AND k = 1 THEN sib END AS sib FROM {src} s LEFT JOIN gp USING (col, variable))"""
SZ = CELLS + ", sz AS (SELECT *, cn AS m FROM pz), sy AS (SELECT col, pos, label, cell, variable, value, cn AS n FROM pz)"


@query("j3_suppress_cells", cte=SZ + PLAN.format(src="sy", th=4, comp="false"), sql="""SELECT col AS "column", pos, label, CASE WHEN reason IS NOT NULL THEN '<4' ELSE cell END AS cell FROM pl""")
def j3(spark, sf):
    return X.suppress(cells(spark, sf), 4, "<4").drop("table")


@query("j3_complementary", cte=SZ + PLAN.format(src="sy", th=2, comp="true"), sql="""SELECT col AS "column", pos, label, reason FROM pl""")
def j3c(spark, sf):
    return X.suppression_plan(cells(spark, sf), 2, True).select("column", "pos", "label", "reason")


@query("j4_merge_and_suppress", cte=MERGE + PLAN.format(src="md", th=4, comp="false"), sql="""SELECT col AS "column", pos, label, CASE WHEN reason IS NOT NULL THEN 1 ELSE 0 END AS hidden FROM pl""")
def j4(spark, sf):
    s = X.merge_and_suppress(cells(spark, sf), rules(spark), 4, "<4")
    return s.select("column", "pos", "label", (F.col("cell") == "<4").cast("int").alias("hidden"))


@query("j5_small_cells", cte=MERGE + PLAN.format(src="md", th=4, comp="true"), sql="""SELECT pl.col AS "column", pl.variable, pl.value AS "row", coalesce(r.n, pl.n) AS raw_n, CASE WHEN r.n IS NOT NULL THEN pl.n END AS merged_n,
  CASE WHEN r.n IS NULL THEN pl.label END AS merged_label, CASE WHEN reason = 'group' THEN 'group_suppressed' ELSE 'still_small' END AS status, x.label AS complementary_target
  FROM pl LEFT JOIN (SELECT col, variable, value, max(cn) AS n FROM pz WHERE cn IS NOT NULL GROUP BY ALL) r USING (col, variable, value)
  LEFT JOIN (SELECT DISTINCT pos, label FROM md) x ON reason = 'small' AND pl.sib = x.pos WHERE reason IN ('small', 'group') AND pl.n > 0 AND pl.n < 4""")
def j5(spark, sf):
    return X.small_cells(cells(spark, sf), rules(spark), 4, True).drop("table")


@query("j6_suppress_all_tables", cte=SZ + PLAN.format(src="sy", th=4, comp="false"), sql="""SELECT t AS "table", count(*) AS n_cells, count(*) FILTER (reason IS NOT NULL) AS hidden FROM pl CROSS JOIN (SELECT unnest(['a', 'b']) AS t) GROUP BY 1""")
def j6(spark, sf):
    two = cells(spark, sf).withColumn("table", F.explode(F.array(F.lit("a"), F.lit("b"))))
    none = spark.createDataFrame([], "variable string, merged_label string, source_value string")
    s = X.suppress_all(two, none, threshold=4, token="<4")
    return s.groupBy("table").agg(F.count(F.lit(1)).alias("n_cells"), F.sum((F.col("cell") == "<4").cast("int")).alias("hidden"))


