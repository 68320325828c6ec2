"""Pooling over sites (N): every region of the customers is a site."""

from pyspark.sql import functions as F

from bedside.functions.quantiles import with_quantiles
from bedside.operators import pool as P
from bedside.operators import report as T
from bedside.plans import views as V
from bedside.plans.on_resp import rnd
from bedside.plans.registry import query
from bedside.sources.tables import materialise, scratch

MET = {"n": "count(*)", "charge_mean": "avg(charge)", "median_charge": "quantile_cont(charge, 0.5)", "charge_q1": "quantile_cont(charge, 0.25)", "charge_q3": "quantile_cont(charge, 0.75)",
       "min_charge": "min(charge)", "max_charge": "max(charge)", "sd": "stddev_samp(charge)", "late_n": "count(*) FILTER (l)", "late_pct": "count(*) FILTER (l) * 100.0::DOUBLE / count(*)",
       "visits": "count(*) * 2", "note": "NULL"}
STATS = """hp AS (SELECT h.*, site, admission_type_category AS k, month(admission_dttm) > 9 AS l FROM hosp h JOIN patient USING (patient_id)),
  sw AS (SELECT site, k, """ + ", ".join(f"({e})::DOUBLE AS {m}" for m, e in MET.items() if m != "note") + """ FROM hp GROUP BY 1, 2),
  lg AS (""" + " UNION ALL ".join(f"SELECT site, k, '{m}' AS metric, {m} AS v FROM sw" for m in MET if m != "note") + ")"
RULES = {"n": "SUM", "charge_mean": "MEANW", "median_charge": "MEDIAN", "charge_q1": "QLOW", "charge_q3": "QHIGH", "min_charge": "MIN", "max_charge": "MAX", "sd": "SDW", "late_n": "SUM",
         "late_pct": "MEANW", "visits": "SUM"}


def site_stats(spark, sf):
    """Site tables in long text form, as result files would hold them."""
    h = V.hosp(spark, sf).join(V.patient(spark, sf), "patient_id").withColumns({"k": F.col("admission_type_category"), "l": (F.month("admission_dttm") > 9).cast("int")})
    s = with_quantiles(h, ["site", "k"], [F.count(F.lit(1)).cast("double").alias("n"), F.avg("charge").alias("charge_mean"), F.min("charge").alias("min_charge"), F.max("charge").alias("max_charge"),
                                          F.stddev_samp("charge").alias("sd"), F.sum("l").cast("double").alias("late_n"), (F.sum("l") * 100.0 / F.count(F.lit(1))).alias("late_pct"),
                                          (F.count(F.lit(1)) * 2).cast("double").alias("visits")], {"charge": {"median_charge": 0.5, "charge_q1": 0.25, "charge_q3": 0.75}})
    e = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), (F.lit("free text") if m == "note" else F.col(m).cast("string")).alias("value")) for m in MET]))
    return materialise(s.select("site", "k", e.alias("_e")).select("site", "k", "_e.metric", "_e.value"), "site-tables")


@query("n1_metric_rules", sql=" UNION ALL ".join(f"SELECT '{m}' AS metric, '{r}' AS rule" for m, r in RULES.items()))
def n1(spark, sf):
    return P.metric_rules(site_stats(spark, sf)).where("is_value").select("metric", "rule")


@query("n2_value_columns", views="hosp patient", cte=STATS, sql="SELECT metric, count(*) AS n_cells, count(v) AS n_numeric, true AS is_value FROM lg GROUP BY 1 UNION ALL SELECT 'note', count(*), 0, false FROM sw")
def n2(spark, sf):
    return P.metric_rules(site_stats(spark, sf)).drop("rule")


POOL = STATS + """, pw AS (SELECT k, metric, count(*) AS n_sites, sum(v) AS s, min(v) AS lo, max(v) AS hi, sum(v * n) / sum(n) AS wm, any_value(lp) AS lp FROM lg JOIN (SELECT site, k, n FROM sw) USING (site, k)
    JOIN (SELECT k, 100 * sum(late_n) / sum(late_n / (late_pct / 100)) FILTER (late_pct > 0) AS lp FROM sw GROUP BY 1) USING (k) GROUP BY 1, 2),
  pooled AS (SELECT k, metric, n_sites, CASE WHEN metric IN ('n', 'late_n', 'visits') THEN s WHEN metric IN ('charge_q1', 'min_charge') THEN lo WHEN metric IN ('charge_q3', 'max_charge') THEN hi
    WHEN metric = 'late_pct' THEN lp ELSE wm END AS p FROM pw)"""


@query("n3_pool_keyed", views="hosp patient", cte=POOL, sql="SELECT k, metric, n_sites, round(p, 4) AS pooled FROM pooled")
def n3(spark, sf):
    return rnd(P.pool_keyed(site_stats(spark, sf), ["k"]).drop("rule"), ["pooled"], 4)


SITES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]


@query("n3_site_columns", views="hosp patient", cte=POOL, sql="SELECT k, metric, " + ", ".join(f'round(max(v) FILTER (site = \'{s}\'), 4) AS "value__{s}"' for s in SITES)
       + ', round(any_value(p), 4) AS "value__ALL" FROM lg JOIN pooled USING (k, metric) GROUP BY 1, 2')
def n3s(spark, sf):
    s = site_stats(spark, sf)
    d = P.with_site_columns(s, P.pool_keyed(s, ["k"]), ["k"], SITES)
    return rnd(d, [c for c in d.columns if c.startswith("value__")], 4)


@query("n4_exact_percentage", views="hosp patient", cte=STATS, sql="SELECT k, round(100 * sum(late_n) / sum(late_n / (late_pct / 100)) FILTER (late_pct > 0), 6) AS pooled FROM sw GROUP BY 1")
def n4(spark, sf):
    s = site_stats(spark, sf).where("metric in ('n', 'late_n', 'late_pct')")
    return rnd(P.pool_keyed(s, ["k"]).where("metric = 'late_pct'").select("k", "pooled"), ["pooled"])


# Display tables per site: size rows, patient and encounter shares, a nested share, medians, text.
DISP = """hp AS (SELECT h.*, site, sex_category FROM hosp h JOIN patient USING (patient_id)),
  ss AS (SELECT site, count(*) AS n, count(DISTINCT patient_id) AS np, count(DISTINCT patient_id) FILTER (sex_category = 'Male') AS nm, count(*) FILTER (discharge_category = 'Expired') AS nx,
    count(*) FILTER (discharge_category = 'Expired' AND charge > 200000) AS ny, CAST(round_even(quantile_cont(age_at_admission, 0.5), 0) AS BIGINT) AS m, CAST(round_even(quantile_cont(age_at_admission, 0.25), 0) AS BIGINT) AS q1,
    CAST(round_even(quantile_cont(age_at_admission, 0.75), 0) AS BIGINT) AS q3 FROM hp GROUP BY 1),
  tp AS (SELECT *, nm * 1000 // np AS a, nx * 1000 // n AS b, ny * 1000 // nx AS c FROM ss),
  tq AS (SELECT *, CASE WHEN a > 0 AND abs(nm / (a / 1000.0::DOUBLE) - np) <= 0.05::DOUBLE * np THEN np ELSE nm / (a / 1000.0::DOUBLE) END AS da, CASE WHEN abs(nx / (b / 1000.0::DOUBLE) - n) <= 0.05::DOUBLE * n THEN n ELSE nx / (b / 1000.0::DOUBLE) END AS db,
    CASE WHEN abs(ny / (c / 1000.0::DOUBLE) - n) <= 0.05::DOUBLE * n THEN n ELSE ny / (c / 1000.0::DOUBLE) END AS dc FROM tp)"""


def display_cells(spark, sf):
    h = V.hosp(spark, sf).join(V.patient(spark, sf), "patient_id")
    x = F.col("discharge_category") == "Expired"
    s = with_quantiles(h, ["site"], [F.count(F.lit(1)).alias("n"), F.countDistinct("patient_id").alias("np"), F.countDistinct(F.when(F.col("sex_category") == "Male", F.col("patient_id"))).alias("nm"),
                                     F.count(F.when(x, 1)).alias("nx"), F.count(F.when(x & (F.col("charge") > 200000), 1)).alias("ny")], {"age_at_admission": {"m": 0.5, "q1": 0.25, "q3": 0.75}})

    def share(a, b):
        p = F.floor(F.col(a) * 1000 / F.col(b))
        return F.concat(F.format_number(a, 0), F.lit(" ("), F.floor(p / 10).cast("string"), F.lit("."), (p % 10).cast("string"), F.lit("%)"))
    whole = lambda c: F.bround(c, 0).cast("long").cast("string")
    up = F.col("site") == "ASIA"
    rows = [(F.lit("N: Encounter blocks"), F.format_number("n", 0)), (F.lit("N: Unique patients"), F.format_number("np", 0)),
            (F.when(up, "  SEX: Male").otherwise("  Sex: male"), share("nm", "np")), (F.lit("Expired, n (%)"), share("nx", "n")), (F.lit("  Expired, n (%)"), share("ny", "nx")),
            (F.lit("Age, median"), F.concat(whole("m"), F.lit(" ["), whole("q1"), F.lit(", "), whole("q3"), F.lit("]"))), (F.lit("Comment"), F.lit("see notes"))]
    e = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), lab.alias("label"), c.alias("cell")) for i, (lab, c) in enumerate(rows)]))
    return s.select("site", e.alias("_e")).select("site", "_e.*", F.lit("Overall").alias("column"))


NUL = "NULL::DOUBLE AS median, NULL::DOUBLE AS q1, NULL::DOUBLE AS q3"


@query("n5_pool_display", views="hosp patient", cte=DISP, sql=f"""SELECT 'n: encounter blocks' AS row_key, 'plain' AS kind, sum(n)::DOUBLE AS n, NULL::DOUBLE AS pct, {NUL} FROM tq
  UNION ALL SELECT 'n: unique patients', 'plain', sum(np)::DOUBLE, NULL, {NUL} FROM tq UNION ALL SELECT '  sex: male', 'n_pct', sum(nm)::DOUBLE, round(100 * sum(nm) / sum(da), 6), {NUL} FROM tq
  UNION ALL SELECT 'expired, n (%)', 'n_pct', sum(nx)::DOUBLE, round(100 * sum(nx) / sum(db), 6), {NUL} FROM tq UNION ALL SELECT '  expired, n (%)', 'n_pct', sum(ny)::DOUBLE, round(100 * sum(ny) / sum(dc), 6), {NUL} FROM tq
  UNION ALL SELECT 'age, median', 'med_iqr', NULL, NULL, round(sum(m * n) / sum(n)::DOUBLE, 6), min(q1)::DOUBLE, max(q3)::DOUBLE FROM tq UNION ALL SELECT 'comment', 'text', NULL, NULL, {NUL} FROM tq GROUP BY 1""")
def n5(spark, sf):
    p = P.display_text(P.pool_display(display_cells(spark, sf)))
    return rnd(p.select("row_key", "kind", "n", "pct", "median", "q1", "q3"), ["pct", "median"])


COM = """cm AS (SELECT site, race_category AS comorbidity, count(*) AS n_patients, round_even(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (PARTITION BY site), 2) AS p FROM patient GROUP BY 1, 2),
  dn AS (SELECT sum(d) AS d FROM (SELECT site, round_even(quantile_cont(n_patients / (p / 100), 0.5), 0) AS d FROM cm WHERE p > 0 GROUP BY 1))"""


@query("n6_pool_comorbidities", views="patient", cte=COM, sql="""SELECT comorbidity, CAST(sum(n_patients) AS BIGINT) AS n_patients, round(sum(n_patients) * 100.0::DOUBLE / (SELECT d FROM dn), 6) AS prevalence_percent,
  round(sum(n_patients) * 1000.0::DOUBLE / (SELECT d FROM dn), 5) AS per_1000_hospitalizations FROM cm GROUP BY 1""")
def n6(spark, sf):
    c = T.level_counts(V.patient(spark, sf), ["site"], "race_category").select("site", F.col("level").alias("comorbidity"), F.col("n").alias("n_patients"), F.bround("pct", 2).alias("prevalence_percent"))
    return rnd(rnd(P.pool_comorbidities(c), ["prevalence_percent"]), ["per_1000_hospitalizations"], 5)


@query("n7_pool_name_value", views="patient", sql="""SELECT 'Total patients' AS label, count(*)::DOUBLE AS pooled FROM patient UNION ALL SELECT 'Number male', (count(*) FILTER (sex_category = 'Male'))::DOUBLE FROM patient
  UNION ALL SELECT 'Average balance', NULL""")
def n7(spark, sf):
    s = V.patient(spark, sf).groupBy("site").agg(F.count(F.lit(1)).alias("t"), F.count(F.when(F.col("sex_category") == "Male", 1)).alias("m"), F.avg("balance").alias("b"))
    e = F.explode(F.array(F.struct(F.lit("Total patients").alias("label"), F.format_number("t", 0).alias("value")), F.struct(F.lit("Number male").alias("label"), F.col("m").cast("string").alias("value")),
                          F.struct(F.lit("Average balance ").alias("label"), F.col("b").cast("string").alias("value"))))
    return P.pool_name_value(s.select("site", e.alias("_e")).select("site", "_e.*"))


@query("n8_pool_crosstab", views="patient", cte="c AS (SELECT site, race_category AS r, sex_category AS s, count(*) AS n FROM patient GROUP BY ALL)", sql="""SELECT r AS race_category, s AS sex_category,
  CAST(sum(n) FILTER (n >= 20) AS BIGINT) AS pooled FROM c GROUP BY 1, 2""")
def n8(spark, sf):
    c = V.patient(spark, sf).groupBy("site", "race_category", "sex_category").agg(F.count(F.lit(1)).alias("n"))
    c = c.withColumn("text", F.when(F.col("n") < 20, "<20").otherwise(F.format_number("n", 0)))
    return P.pool_crosstab(c, ["race_category", "sex_category"])


@query("n9_pool_bins", views="hosp patient", cte="h AS (SELECT site, charge, floor(charge / 50000) AS b FROM hosp JOIN patient USING (patient_id))", sql="""SELECT CAST(b AS BIGINT) AS bin_num, count(*) AS count, round(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM h), 6) AS percentage FROM h GROUP BY 1""")
def n9(spark, sf):
    h = V.hosp(spark, sf).join(V.patient(spark, sf), "patient_id").withColumn("bin_num", F.floor(F.col("charge") / 50000))
    per_site = h.groupBy("site", "bin_num").agg(F.count(F.lit(1)).alias("count"))
    return rnd(P.pool_bins(per_site, ["bin_num"]), ["percentage"])


@query("n10_read_sites", views="hosp patient", sql="SELECT replace(site, ' ', '_') AS site, admission_type_category, count(*) AS n FROM hosp JOIN patient USING (patient_id) GROUP BY 1, 2")
def n10(spark, sf):
    h = V.hosp(spark, sf).join(V.patient(spark, sf), "patient_id")
    root = scratch(spark, "sites")
    counts = h.groupBy(F.translate("site", " ", "_").alias("site"), "admission_type_category").agg(F.count(F.lit(1)).alias("n"))
    P.write_sites(counts, root, "types.parquet")
    return P.read_sites(spark, root, "types.parquet").select("site", "admission_type_category", "n")


BENCH = [("Unique patients", "D", "count", "N: Unique patients"), ("Age median", "D", "median", "Age"), ("Sex Male", "D", "pct", "Sex: male"), ("Expired", "O", "pct", "Expired"), ("CRRT", "T", "pct", "CRRT")]


def _verdict(a, b, pct):
    near = f"abs({a} - {b}) <= 5" if pct else f"abs({a} - {b}) / {b} <= 0.25"
    return f"CASE WHEN {near} THEN 'SIMILAR' WHEN {a} > {b} THEN 'ABOVE' ELSE 'BELOW' END"


@query("n11_benchmark", views="hosp patient", cte=DISP + ", o AS (SELECT * FROM tp WHERE site = 'ASIA'), e AS (SELECT * FROM tp WHERE site = 'EUROPE')", sql=f"""SELECT 'Unique patients' AS metric, o.np::DOUBLE AS own_value, e.np::DOUBLE AS ref_value, '' AS verdict FROM o, e
  UNION ALL SELECT 'Age median', o.m::DOUBLE, e.m::DOUBLE, {_verdict('o.m', 'e.m', False)} FROM o, e UNION ALL SELECT 'Sex Male', round(o.a / 10.0::DOUBLE, 6), round(e.a / 10.0::DOUBLE, 6), {_verdict('o.a / 10.0', 'e.a / 10.0', True)} FROM o, e
  UNION ALL SELECT 'Expired', round(o.b / 10.0::DOUBLE, 6), round(e.b / 10.0::DOUBLE, 6), {_verdict('o.b / 10.0', 'e.b / 10.0', True)} FROM o, e""")
def n11(spark, sf):
    c = display_cells(spark, sf)
    b = P.benchmark(c.where("site = 'ASIA'"), c.where("site = 'EUROPE'"), BENCH)
    return rnd(b.select("metric", "own_value", "ref_value", "verdict"), ["own_value", "ref_value"])


