"""Distributions, bins, profiles and tests (K)."""

from pyspark.sql import functions as F

from bedside.operators import dist as D
from bedside.operators.clean import stack
from bedside.plans import views as V
from bedside.plans.on_resp import rnd
from bedside.plans.registry import query
from bedside.sources.tables import materialise

BLOCK = "encounter_block"


@query("k1_compact_ecdf", views="obs", cte="c AS (SELECT category, value, count(*) AS n FROM obs GROUP BY 1, 2)",
       sql="""SELECT category, value, round(sum(n) OVER (PARTITION BY category ORDER BY value) / sum(n) OVER (PARTITION BY category), 8) AS probability FROM c""")
def k1(spark, sf):
    return rnd(D.ecdf(V.obs(spark, sf), ["category"]), ["probability"], 8)


@query("k2_ecdf_summary", views="obs", sql="SELECT category, count(*) AS count, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS std, "
       + ", ".join(f"round(quantile_cont(value, {p / 100}), 6) AS p{p}" for p in D.PERCENTILES) + " FROM obs GROUP BY 1")
def k2(spark, sf):
    return rnd(D.ecdf_summary(V.obs(spark, sf), ["category"]), ["mean", "std", *[f"p{p}" for p in D.PERCENTILES]])


def values(spark, sf):
    """Every metric inside its user's window, for two strata."""
    o = V.obs(spark, sf).withColumnRenamed("category", "metric")
    w = V.win(spark, sf)
    w = w.withColumn("stratum", F.explode(F.array_compact(F.array(F.lit("icu"), F.when(F.col(BLOCK) % 2 == 0, "icu/even")))))
    r = spark.createDataFrame([(c, 1.0, 300.0) for c in V.LOCATION], "metric string, outlier_min double, outlier_max double")
    return D.windowed_metrics(o, w, r, BLOCK, "recorded_dttm").select("stratum", "metric", "value")


VALS = """vals AS (SELECT stratum, category AS metric, value FROM obs JOIN win USING (encounter_block), (SELECT unnest(['icu', 'icu/even']) AS stratum)
    WHERE recorded_dttm BETWEEN start_dttm AND end_dttm AND value BETWEEN 1 AND 300 AND (stratum = 'icu' OR encounter_block % 2 = 0))"""


def config(spark):
    return spark.createDataFrame([(c, 20.0, 80.0, 1.0, 300.0, 4, 6, 5) for c in V.LOCATION],
                                 "metric string, normal_lower double, normal_upper double, outlier_min double, outlier_max double, "
                                 "bins_below int, bins_normal int, bins_above int")


KEYS = ["stratum", "metric"]


def _edges(src, n):
    qs = ", ".join(str(i / n) for i in range(n + 1))
    return f"list_sort(list_distinct(list_transform(quantile_cont({src}, [{qs}]), lambda x: x)))"


def _bins(name, rows, keys, edges):
    """SQL of quantile bins of ``rows`` (keys, value) with edges from ``edges`` (keys, e)."""
    k = ", ".join(keys)
    return f"""{name}h AS (SELECT {k}, greatest(len(list_filter(e, lambda x: x < value)), 1) AS bin_num, count(*) AS n FROM {rows} JOIN {edges} USING ({k}) GROUP BY ALL),
  {name} AS (SELECT {k}, b AS bin_num, e[b] AS bin_min, e[least(b + 1, len(e))] AS bin_max, coalesce(n, 0) AS count FROM
    (SELECT {k}, e, unnest(range(1, greatest(len(e), 2))) AS b FROM {edges}) f LEFT JOIN {name}h USING ({k}) WHERE {name}h.bin_num = b OR {name}h.bin_num IS NULL)""".replace(
        f"FROM {edges}) f LEFT JOIN {name}h USING ({k}) WHERE {name}h.bin_num = b OR {name}h.bin_num IS NULL", f"FROM {edges}) f LEFT JOIN (SELECT {k}, bin_num AS b, n FROM {name}h) USING ({k}, b)")


SEG = VALS + """, sg AS (SELECT stratum, metric, 'below' AS segment, value FROM vals WHERE value BETWEEN 1 AND 20 UNION ALL
    SELECT stratum, metric, 'normal', value FROM vals WHERE value BETWEEN 20 AND 80 UNION ALL SELECT stratum, metric, 'above', value FROM vals WHERE value BETWEEN 80 AND 300),
  ed AS (""" + " UNION ALL ".join(f"SELECT stratum, metric, segment, {_edges('value', n)} AS e, count(*) AS t FROM sg WHERE segment = '{s}' GROUP BY ALL"
                                  for s, n in (("below", 4), ("normal", 6), ("above", 5))) + "),\n" + _bins("bb", "sg", ["stratum", "metric", "segment"], "ed") + f""",
  tl AS (SELECT stratum, metric, segment, value FROM sg JOIN ed USING (stratum, metric, segment) WHERE (segment = 'below' AND value <= e[2]) OR (segment = 'above' AND value >= e[len(e) - 1])),
  te AS (SELECT stratum, metric, segment, {_edges('value', 5)} AS e FROM tl GROUP BY ALL HAVING count(*) >= 10),
  """ + _bins("tt", "tl", ["stratum", "metric", "segment"], "te") + """,
  tx AS (SELECT stratum, metric, segment, max(bin_num) AS x FROM tt GROUP BY ALL), bk AS (SELECT stratum, metric, segment, max(bin_num) AS k FROM bb GROUP BY ALL),
  fin AS (SELECT stratum, metric, segment, CASE WHEN x IS NOT NULL AND segment = 'below' THEN bin_num + x - 1 ELSE bin_num END AS bin_num, bin_min, bin_max, count FROM bb
      JOIN bk USING (stratum, metric, segment) LEFT JOIN tx USING (stratum, metric, segment) WHERE x IS NULL OR bin_num <> CASE WHEN segment = 'below' THEN 1 ELSE k END
    UNION ALL SELECT stratum, metric, segment, CASE WHEN segment = 'above' THEN bin_num + k - 1 ELSE bin_num END, bin_min, bin_max, count FROM tt JOIN bk USING (stratum, metric, segment))"""


@query("k3_segmented_bins", views="obs win", cte=SEG, sql="""SELECT stratum, metric, segment, bin_num, round(bin_min, 6) AS bin_min, round(bin_max, 6) AS bin_max, CAST(count AS BIGINT) AS count,
  round(count * 100.0::DOUBLE / t, 6) AS percentage FROM fin JOIN ed USING (stratum, metric, segment)""")
def k3(spark, sf):
    b = D.segmented_bins(values(spark, sf), config(spark), KEYS, ["metric"])
    return rnd(b, ["bin_min", "bin_max", "percentage"])


@query("k4_flat_bins", views="obs resp", cte=f"""st AS (SELECT 'peep_set' AS metric, peep_set AS value FROM resp UNION ALL SELECT 'lpm_set', lpm_set FROM resp),
  ed AS (SELECT metric, {_edges('value', 10)} AS e, count(*) AS t FROM st GROUP BY 1), """ + _bins("bb", "st", ["metric"], "ed"),
       sql="""SELECT metric, bin_num, round(bin_min, 6) AS bin_min, round(bin_max, 6) AS bin_max, CAST(count AS BIGINT) AS count, round(count * 100.0::DOUBLE / t, 6) AS percentage
  FROM bb JOIN ed USING (metric)""")
def k4(spark, sf):
    long = stack(V.resp(spark, sf), [], ["peep_set", "lpm_set"])
    return rnd(D.flat_bins(long, ["metric"]), ["bin_min", "bin_max", "percentage"])


@query("k5_segment_statistics", views="obs win", cte=SEG, sql="""SELECT stratum, metric, segment, count(*) AS count, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std,
  min(value) AS min, max(value) AS max, round(quantile_cont(value, 0.5), 6) AS median FROM sg GROUP BY ALL""")
def k5(spark, sf):
    return rnd(D.segment_statistics(values(spark, sf), config(spark), KEYS, ["metric"]), ["mean", "std", "median"])


LABS = """lb AS (SELECT *, CASE WHEN setting < 30 THEN ' MG/dL' WHEN setting < 50 THEN NULL WHEN setting < 60 THEN '' ELSE 'mmol/L ' END AS u FROM obs),
  pr AS (SELECT category, coalesce(nullif(lower(trim(u)), ''), '(no units)') AS unit, count(*) AS n FROM lb GROUP BY ALL),
  cl AS (SELECT *, CASE WHEN category IN ('view', 'error') THEN 'mg/dL' WHEN category = 'click' THEN 'mmol/L' END AS canonical_unit,
    CASE WHEN category NOT IN ('view', 'error', 'click') THEN 'not_in_spec' WHEN (category IN ('view', 'error') AND unit = 'mg/dl') OR (category = 'click' AND unit IN ('mmol/l', '(no units)'))
    THEN 'ok' ELSE 'unit_mismatch' END AS status FROM pr)"""


def labs(spark, sf):
    s = F.col("setting")
    return V.obs(spark, sf).withColumn("reference_unit", F.when(s < 30, " MG/dL").when(s < 50, F.lit(None)).when(s < 60, "").otherwise("mmol/L "))


def classified(spark, sf):
    v = spark.createDataFrame([("View", "mg/dL", "MG/DL"), ("error", "mg/dL", "mg/dL"), ("click", "mmol/L", "mmol/l"), ("click", "mmol/L", "(no units)")],
                              "category string, canonical_unit string, allowed_variant string")
    return D.classify_units(D.category_units(labs(spark, sf), "category"), v)


@query("k6_category_units", views="obs", cte=LABS, sql="SELECT * FROM pr")
def k6(spark, sf):
    return D.category_units(labs(spark, sf), "category")


@query("k7_classify_units", views="obs", cte=LABS, sql="SELECT *, CASE status WHEN 'ok' THEN 0 WHEN 'unit_mismatch' THEN 1 ELSE 2 END AS status_rank FROM cl")
def k7(spark, sf):
    return classified(spark, sf)


@query("k8_unit_issues", views="obs", cte=LABS, sql="""SELECT category, unit, n, status AS issue FROM cl WHERE status <> 'ok' UNION ALL SELECT category, unit, n, 'no_bin_config' FROM cl
  WHERE status = 'ok' AND category <> 'view' UNION ALL SELECT category, unit, n, 'no_outlier_range' FROM cl WHERE status = 'ok' AND category <> 'click'""")
def k8(spark, sf):
    one = lambda c: spark.createDataFrame([(c,)], "category string")
    return D.unit_issues(classified(spark, sf), one("VIEW"), one("click"))


@query("k9_windowed_ecdf", views="obs win", cte=VALS + ", c AS (SELECT stratum, metric, value, count(*) AS n FROM vals GROUP BY ALL)",
       sql="""SELECT stratum, metric, value, round(sum(n) OVER (PARTITION BY stratum, metric ORDER BY value) / sum(n) OVER (PARTITION BY stratum, metric), 8) AS probability FROM c""")
def k9(spark, sf):
    return rnd(D.ecdf(values(spark, sf), KEYS), ["probability"], 8)


SPANS = {"whole_stay": "", "first_24hr": " FILTER (h <= 24)", "first_48hr": " FILTER (h <= 48)", "first_72hr": " FILTER (h <= 72)"}


@query("k10_collection_statistics", views="obs win", cte="""m AS (SELECT category, encounter_block, recorded_dttm, value, start_dttm, end_dttm,
    (epoch_us(recorded_dttm) - epoch_us(start_dttm)) / 3600000000.0::DOUBLE AS h FROM obs JOIN win USING (encounter_block) WHERE recorded_dttm BETWEEN start_dttm AND end_dttm),
  p AS (SELECT category, encounter_block, count(DISTINCT (recorded_dttm, value)) AS d, (epoch_us(max(end_dttm)) - epoch_us(min(start_dttm))) / 3600000000.0::DOUBLE AS los, """
       + ", ".join(f"count(*){f} AS {s}" for s, f in SPANS.items()) + " FROM m GROUP BY 1, 2)",
       sql="SELECT category, count(*) AS total_number_of_stays, CAST(sum(whole_stay) AS BIGINT) AS total_observations, CAST(sum(d) AS BIGINT) AS distinct_observations, round(avg(los), 5) AS mean_los_hours, "
       + ", ".join(f"round(avg({s}), 6) AS {s}_mean, round(quantile_cont({s}, 0.5), 6) AS {s}_median, round(quantile_cont({s}, 0.75) - quantile_cont({s}, 0.25), 6) AS {s}_iqr" for s in SPANS)
       + " FROM p GROUP BY 1")
def k10(spark, sf):
    c = D.collection_statistics(V.obs(spark, sf), V.win(spark, sf), BLOCK, "recorded_dttm", ["category"])
    return rnd(rnd(c, [f"{s}_{x}" for s in SPANS for x in ("mean", "median", "iqr")]), ["mean_los_hours"], 5)


@query("k11_combination_counts", sql="SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2")
def k11(spark, sf):
    return D.combination_counts(V.table(spark, sf, "part"), ["p_brand", "p_type", "no_such_column"])


@query("k12_table_combinations", views="visit", sql="""SELECT 'location_category' AS combination, location_category AS "values", count(*) AS n FROM visit GROUP BY 2
  UNION ALL SELECT 'device_category+med_category', coalesce(device_category, 'Missing') || ' | ' || med_category, count(*) FROM visit GROUP BY 2""")
def k12(spark, sf):
    return D.table_combinations(V.visit(spark, sf), "adt", {"adt": [["location_name", "location_category"], ["device_category", "med_category"], ["absent"]]})


NR = """x AS (SELECT category, 'value' AS variable, CASE WHEN value <= 150 THEN value END AS x FROM obs UNION ALL SELECT category, 'setting', setting FROM obs),
  k AS (SELECT *, row_number() OVER (PARTITION BY category, variable ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY category, variable) AS n FROM x WHERE x IS NOT NULL),
  q AS (SELECT category, variable, max(x) FILTER (r = round_even(0.25::DOUBLE * (n - 1), 0)) AS q1, max(x) FILTER (r = round_even(0.75::DOUBLE * (n - 1), 0)) AS q3 FROM k GROUP BY 1, 2)"""


def cut(spark, sf):
    return V.obs(spark, sf).withColumn("value", F.when(F.col("value") <= 150, F.col("value")))


NUMS = "count(*) AS total_obs, count(x) AS n, count(*) - count(x) AS missing, min(x) AS min, max(x) AS max, round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.5), 6) AS median"


@query("k13_numeric_summary", views="obs", cte=NR, sql=f"SELECT category, variable, {NUMS}, any_value(q1) AS q1, any_value(q3) AS q3 FROM x JOIN q USING (category, variable) GROUP BY 1, 2")
def k13(spark, sf):
    return rnd(D.numeric_summary(cut(spark, sf), ["category"], ["value", "setting", "absent"]), ["mean", "sd", "median"])


@query("k14_categorical_profile", cte="c AS (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY n DESC, v) AS k FROM c)",
       sql="""SELECT CASE WHEN k <= 5 THEN v ELSE 'Other' END AS value, CAST(sum(n) AS BIGINT) AS count, round_even(sum(n) * 100.0::DOUBLE / (SELECT sum(n) FROM c), 2) AS percentage FROM r GROUP BY 1""")
def k14(spark, sf):
    return D.categorical_profile(V.table(spark, sf, "part"), "p_brand", 5)


@query("k14_categorical_summary", views="obs resp", cte="c AS (SELECT device_category AS v, count(*) AS n FROM resp GROUP BY 1)",
       sql="""SELECT 'device_category' AS "column", CAST(sum(n) AS BIGINT) AS total_rows, count(v) AS unique_values, CAST(coalesce(sum(n) FILTER (v IS NULL), 0) AS BIGINT) AS missing_count,
  first(v ORDER BY n DESC, v) FILTER (v IS NOT NULL) AS mode, round_even(sum(n) FILTER (v IS NULL) * 100.0::DOUBLE / sum(n), 2) AS missing_percentage,
  round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 3) AS entropy FROM c""")
def k14s(spark, sf):
    return D.categorical_summary(V.resp(spark, sf), "device_category")


@query("k15_numeric_profile", views="obs", cte="""x AS (SELECT 'value' AS variable, CASE WHEN value <= 150 THEN value END AS x FROM obs UNION ALL SELECT 'setting', setting FROM obs),
  q AS (SELECT variable, quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.75) AS q3, avg(x) AS m FROM x GROUP BY 1),
  mo AS (SELECT variable, count(x) AS n, avg(pow(x - m, 2)) AS m2, avg(pow(x - m, 3)) AS m3, avg(pow(x - m, 4)) AS m4,
    count(*) FILTER (x < q1 - 1.5::DOUBLE * (q3 - q1) OR x > q3 + 1.5::DOUBLE * (q3 - q1)) AS oc FROM x JOIN q USING (variable) GROUP BY 1)""",
       sql=f"""SELECT variable, {NUMS}, round(any_value(q1), 6) AS q1, round(any_value(q3), 6) AS q3, round(any_value(q3 - q1), 6) AS iqr, round(max(x) - min(x), 6) AS range,
  round(stddev_samp(x) / avg(x) * 100, 6) AS cv, round(any_value(m3 / pow(m2, 1.5::DOUBLE) * sqrt(mo.n * (mo.n - 1)) / (mo.n - 2)), 5) AS skewness,
  round(any_value((mo.n - 1) / ((mo.n - 2) * (mo.n - 3))::DOUBLE * ((mo.n + 1) * (m4 / (m2 * m2) - 3) + 6)), 5) AS kurtosis, any_value(oc) AS outlier_count,
  round_even((count(*) - count(x)) * 100.0::DOUBLE / count(*), 2) AS missing_percentage, round_even(any_value(oc) * 100.0::DOUBLE / count(x), 2) AS outlier_percentage
  FROM x JOIN q USING (variable) JOIN mo USING (variable) GROUP BY 1""")
def k15(spark, sf):
    p = D.numeric_profile(cut(spark, sf), ["value", "setting"])
    return rnd(rnd(p, ["mean", "sd", "median", "q1", "q3", "iqr", "range", "cv"]), ["skewness", "kurtosis"], 5)


@query("k16_iqr_outliers", views="obs", cte="q AS (SELECT category, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM obs GROUP BY 1)",
       sql="SELECT event_id, category, value FROM obs JOIN q USING (category) WHERE value < q1 - 1.5::DOUBLE * (q3 - q1) OR value > q3 + 1.5::DOUBLE * (q3 - q1)")
def k16(spark, sf):
    return D.iqr_outliers(V.obs(spark, sf), ["category"], "value").select("event_id", "category", "value")


@query("k17_entropy", sql=" UNION ALL ".join(f"""SELECT '{c}' AS "column", round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 3) AS entropy FROM (SELECT count(*) AS n FROM part GROUP BY {c})""" for c in ("p_brand", "p_type", "p_size")))
def k17(spark, sf):
    return D.count_entropy(V.table(spark, sf, "part"), ["p_brand", "p_type", "p_size"])


TWO = """a AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 0), b AS (SELECT o_totalprice AS v FROM orders WHERE o_orderkey % 2 = 1),
  c AS (SELECT v, count(*) FILTER (g = 0) AS n1, count(*) FILTER (g = 1) AS n2 FROM (SELECT v, 0 AS g FROM a UNION ALL SELECT v, 1 FROM b) GROUP BY 1),
  r AS (SELECT *, sum(n1) OVER (ORDER BY v) AS c1, sum(n2) OVER (ORDER BY v) AS c2, sum(n1 + n2) OVER (ORDER BY v) AS cc, sum(n1) OVER () AS t1, sum(n2) OVER () AS t2 FROM c)"""


def halves(spark, sf, c):
    o = V.table(spark, sf, "orders")
    return o.where("o_orderkey % 2 = 0").select(c), o.where("o_orderkey % 2 = 1").select(c)


@query("k18_ks_test", cte=TWO + """, d AS (SELECT CAST(max(t1) AS BIGINT) AS n1, CAST(max(t2) AS BIGINT) AS n2, max(abs(c1 / t1 - c2 / t2)) AS s FROM r),
  e AS (SELECT *, sqrt(n1 * n2 / (n1 + n2)::DOUBLE) * s AS x FROM d)""", sql="""SELECT n1, n2, round(s, 8) AS statistic,
  round(least(1, greatest(0, CASE WHEN x = 0 THEN 1 WHEN x < 1 THEN 1 - sqrt(2 * pi()) / x * (SELECT sum(exp(-(2 * k - 1) * (2 * k - 1) * pi() * pi() / (8 * x * x))) FROM (SELECT unnest(range(1, 21)) AS k))
    ELSE 2 * (SELECT sum(CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END * exp(-2 * k * k * x * x)) FROM (SELECT unnest(range(1, 101)) AS k)) END)), 6) AS p_value FROM e""")
def k18a(spark, sf):
    return rnd(rnd(D.ks_test(*halves(spark, sf, "o_totalprice"), "o_totalprice"), ["statistic"], 8), ["p_value"], 6)


# normal tail by the power series of its integral
TAIL = """(1 - sqrt(2 / pi()) * (SELECT sum((CASE WHEN k % 2 = 0 THEN 1 ELSE -1 END) * exp((2 * k + 1) * ln(greatest(z, 1e-300)) - k * ln(2) - lgamma(k + 1)) / (2 * k + 1))
    FROM (SELECT unnest(range(0, 100)) AS k)))"""
RANKS = """u0 AS (SELECT CAST(sum(n1) AS BIGINT) AS n1, CAST(sum(n2) AS BIGINT) AS n2, sum(n1 * (cc - (n1 + n2) + (n1 + n2 + 1) / 2.0::DOUBLE)) - sum(n1) * (sum(n1) + 1) / 2.0::DOUBLE AS u,
    sum(pow(n1 + n2, 3) - (n1 + n2)) AS tie FROM r),
  u1 AS (SELECT *, (greatest(u, n1 * n2 - u) - n1 * n2 / 2.0::DOUBLE - 0.5::DOUBLE) / sqrt(n1 * n2 / 12.0::DOUBLE * (n1 + n2 + 1 - tie / ((n1 + n2) * (n1 + n2 - 1.0::DOUBLE)))) AS z FROM u0)"""


@query("k18_mann_whitney", cte=TWO + ", " + RANKS, sql=f"SELECT n1, n2, round(u, 2) AS statistic, round(least(1, {TAIL}), 6) AS p_value FROM u1")
def k18b(spark, sf):
    return rnd(rnd(D.mann_whitney(*halves(spark, sf, "o_totalprice"), "o_totalprice"), ["statistic"], 2), ["p_value"], 6)


# small samples: balances of the customers of one nation in two market segments
SMALL = """a AS (SELECT c_acctbal AS v FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'BUILDING'), b AS (SELECT c_acctbal AS v FROM customer WHERE c_nationkey = 3 AND c_mktsegment = 'MACHINERY'),
  """ + TWO[TWO.index("c AS ("):]


def segments(spark, sf):
    c = V.table(spark, sf, "customer").where("c_nationkey = 3")
    return [c.where(F.col("c_mktsegment") == s).select("c_acctbal") for s in ("BUILDING", "MACHINERY")]


# paths of single steps through the lattice, counted per cell, one anti-diagonal after the other
@query("k18_ks_exact", cte=SMALL + """, d AS (SELECT CAST(max(t1) AS BIGINT) AS n1, CAST(max(t2) AS BIGINT) AS n2, max(abs(c1 * t2 - c2 * t1)) AS edge FROM r)""",
       sql="""SELECT n1, n2, round(edge / (n1 * n2)::DOUBLE, 8) AS statistic, round(greatest(0, 1 - coalesce((SELECT k FROM (WITH RECURSIVE w AS (
    SELECT 0::BIGINT AS t, 0::BIGINT AS i, 1.0::DOUBLE AS k FROM d WHERE edge > 0 UNION ALL
    SELECT t + 1, i + x, sum(k) FROM w, d, (SELECT unnest([0, 1]) AS x) WHERE t < n1 + n2 AND i + x <= n1 AND t + 1 - i - x <= n2 AND abs((i + x) * n2 - (t + 1 - i - x) * n1) < edge GROUP BY ALL)
    SELECT k FROM w, d WHERE t = n1 + n2)) / exp(lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1)), 0)), 6) AS p_value FROM d""")
def k18ke(spark, sf):
    return rnd(rnd(D.ks_test(*segments(spark, sf), "c_acctbal", exact_cells=None), ["statistic"], 8), ["p_value"], 6)


# rank sums of all subsets, counted by taking or leaving one rank after the other
@query("k18_mann_whitney_exact", cte=SMALL + ", " + RANKS + """, sub AS (SELECT * FROM (WITH RECURSIVE w AS (
    SELECT 0::BIGINT AS t, 0::BIGINT AS c, 0::BIGINT AS s, 1.0::DOUBLE AS k FROM u1 WHERE tie = 0 AND least(n1, n2) <= 20 AND lgamma(n1 + n2 + 1) - lgamma(n1 + 1) - lgamma(n2 + 1) < 50 * ln(2) UNION ALL
    SELECT t + 1, c + x, s + x * (t + 1), sum(k) FROM w, u1, (SELECT unnest([0, 1]) AS x) WHERE t < n1 + n2 AND c + x <= n1 GROUP BY ALL)
    SELECT s - n1 * (n1 + 1) // 2 AS u, k FROM w, u1 WHERE t = n1 + n2 AND c = n1)),
  ex AS (SELECT least(1, 2 * sum(k) FILTER (sub.u >= greatest(u1.u, n1 * n2 - u1.u)) / sum(k)) AS p FROM sub, u1)""",
       sql=f"SELECT n1, n2, round(u, 2) AS statistic, round(least(1, coalesce(p, {TAIL})), 6) AS p_value FROM u1, ex")
def k18me(spark, sf):
    return rnd(rnd(D.mann_whitney(*segments(spark, sf), "c_acctbal", exact=20), ["statistic"], 2), ["p_value"], 6)


@query("k18_chi_square", cte="""c AS (SELECT o_orderpriority AS v, count(*) FILTER (o_orderkey % 2 = 0) AS n1, count(*) FILTER (o_orderkey % 2 = 1) AS n2 FROM orders GROUP BY 1),
  t AS (SELECT sum(n1) AS t1, sum(n2) AS t2, count(*) - 1 AS dof FROM c), s AS (SELECT t1, t2, dof, sum(pow(n1 - (n1 + n2) * t1 / (t1 + t2), 2) / ((n1 + n2) * t1 / (t1 + t2))
    + pow(n2 - (n1 + n2) * t2 / (t1 + t2), 2) / ((n1 + n2) * t2 / (t1 + t2))) AS s FROM c, t GROUP BY ALL)""",
       sql="""SELECT CAST(t1 AS BIGINT) AS n1, CAST(t2 AS BIGINT) AS n2, CAST(dof AS INTEGER) AS dof, round(s, 6) AS statistic, round(exp(-s / 2) * (1 + s / 2), 6) AS p_value FROM s""")
def k18c(spark, sf):
    return rnd(D.chi_square(*halves(spark, sf, "o_orderpriority"), "o_orderpriority"), ["statistic", "p_value"])


@query("k19_auto_profile", sql="""SELECT 'numeric' AS kind, 'p_size' AS "column", count(p_size) AS n, count(*) - count(p_size) AS missing, round(avg(p_size), 6) AS mean, round(quantile_cont(p_size, 0.5), 6) AS median, NULL AS levels FROM part
  UNION ALL SELECT 'numeric', 'p_retailprice', count(p_retailprice), count(*) - count(p_retailprice), round(avg(p_retailprice), 6), round(quantile_cont(p_retailprice, 0.5), 6), NULL FROM part
  UNION ALL SELECT 'categorical', 'p_brand', count(p_brand), count(*) - count(p_brand), NULL, NULL, count(DISTINCT p_brand) FROM part
  UNION ALL SELECT 'categorical', 'p_type', count(p_type), count(*) - count(p_type), NULL, NULL, count(DISTINCT p_type) FROM part""")
def k19(spark, sf):
    return rnd(D.auto_profile(V.table(spark, sf, "part").select("p_size", "p_retailprice", "p_brand", "p_type")), ["mean", "median"])


GAPS = "gp AS (SELECT device_category AS a, CASE WHEN device_category IS NOT NULL AND setting > 0 THEN value END AS b, fio2_set AS c FROM (SELECT r.*, peep_set AS setting, lpm_set AS value FROM resp r))"


def gappy(spark, sf):
    return V.resp(spark, sf).select(F.col("device_category").alias("a"), F.when(F.col("device_category").isNotNull() & (F.col("peep_set") > 0), F.col("lpm_set")).alias("b"),
                                    F.col("fio2_set").alias("c"))


@query("k20_missingness", views="obs resp", cte=GAPS, sql=" UNION ALL ".join(f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, count({c}) AS complete_count,
  round_even((count(*) - count({c})) * 100.0::DOUBLE / count(*), 2) AS missing_percent FROM gp""" for c in "abc"))
def k20(spark, sf):
    return D.missingness(gappy(spark, sf))


@query("k20_missingness_overview", views="obs resp", cte=GAPS + ", m AS (SELECT (a IS NULL)::INT + (b IS NULL)::INT + (c IS NULL)::INT AS k FROM gp)",
       sql="""SELECT count(*) AS total_rows, CAST(sum(k) AS BIGINT) AS missing_cells, count(*) FILTER (k = 0) AS complete_rows, count(*) FILTER (k IN (1, 2)) AS partial_rows,
  count(*) FILTER (k = 3) AS empty_rows, 3 AS total_columns, count(*) * 3 AS total_cells, round_even(sum(k) * 100.0::DOUBLE / (count(*) * 3), 2) AS overall_missing_percentage FROM m""")
def k20o(spark, sf):
    return D.missingness_overview(gappy(spark, sf))


@query("k21_high_missingness", views="obs resp", cte=GAPS, sql=""" SELECT "column", missing_count, round_even(p, 2) AS missing_percent, round_even(p - 20.5::DOUBLE, 2) AS threshold_exceeded_by FROM (""" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) - count({c}) AS missing_count, (count(*) - count({c})) * 100.0::DOUBLE / count(*) AS p FROM gp""" for c in "abc") + ") WHERE p > 20.5")
def k21(spark, sf):
    return D.high_missingness(gappy(spark, sf), 20.5)


@query("k21_co_missing_pairs", views="obs resp", cte=GAPS, sql="SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT '{x}' AS column1, '{y}' AS column2, round_even(count(*) FILTER ({x} IS NULL AND {y} IS NULL) / count(*) FILTER ({x} IS NULL OR {y} IS NULL)::DOUBLE, 3) AS jaccard, "
    f"count(*) FILTER ({x} IS NULL AND {y} IS NULL) AS both_missing_count FROM gp" for x, y in ("ab", "ac", "bc")) + ") WHERE jaccard > 0.15")
def k21p(spark, sf):
    return D.co_missing_pairs(gappy(spark, sf), 0.15)


@query("k22_raw_and_clean", views="obs", cte="""x AS (SELECT 'raw' AS stage, 'value' AS variable, value AS x FROM obs UNION ALL SELECT 'raw', 'setting', setting FROM obs
    UNION ALL SELECT 'clean', 'value', CASE WHEN value BETWEEN 5 AND 150 THEN value END FROM obs UNION ALL SELECT 'clean', 'setting', CASE WHEN setting <= 90 THEN setting END FROM obs)""",
       sql=f"SELECT stage, variable, {NUMS}, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3 FROM x GROUP BY 1, 2")
def k22(spark, sf):
    return rnd(D.raw_and_clean(V.obs(spark, sf), {"value": (5, 150), "setting": (None, 90)}), ["mean", "sd", "median", "q1", "q3"])


@query("k23_summary_with_total", views="obs resp", cte="x AS (SELECT coalesce(device_category, 'Missing') AS l, 'peep_set' AS variable, peep_set AS x FROM resp UNION ALL SELECT coalesce(device_category, 'Missing'), 'fio2_set', fio2_set FROM resp)",
       sql=f"""SELECT CASE WHEN grouping(l) = 1 THEN 'All' ELSE l END AS level, variable, count(*) AS total_obs, count(x) AS n, count(*) - count(x) AS missing, round(min(x), 6) AS min, round(max(x), 6) AS max,
  round(avg(x), 6) AS mean, round(stddev_samp(x), 6) AS sd, round(quantile_cont(x, 0.5), 6) AS median, round(quantile_cont(x, 0.25), 6) AS q1, round(quantile_cont(x, 0.75), 6) AS q3
  FROM x GROUP BY GROUPING SETS ((l, variable), (variable))""")
def k23(spark, sf):
    return rnd(D.numeric_summary_with_total(V.resp(spark, sf), "device_category", ["peep_set", "fio2_set"]), ["min", "max", "mean", "sd", "median", "q1", "q3"])


@query("k24_year_distribution", sql="SELECT CAST(year(o_orderdate) AS INTEGER) AS year, count(*) AS n FROM orders GROUP BY 1")
def k24(spark, sf):
    return D.by_time_part(V.table(spark, sf, "orders"), "o_orderdate", "year")


@query("k24_hour_distribution", sql="SELECT CAST(hour(ts) AS INTEGER) AS hour, count(*) AS n FROM events GROUP BY 1")
def k24h(spark, sf):
    return D.by_time_part(V.table(spark, sf, "events"), "ts", "hour")


@query("k25_table_info", sql="""SELECT count(*) AS n_rows, 6 AS n_columns, count(DISTINCT o_custkey) AS unique_o_custkey, count(DISTINCT o_orderpriority) AS unique_o_orderpriority,
  CAST(year(min(o_orderdate)) AS INTEGER) AS first_year, CAST(year(max(o_orderdate)) AS INTEGER) AS last_year FROM orders""")
def k25(spark, sf):
    return D.table_info(V.table(spark, sf, "orders"), ["o_custkey"], ["o_orderpriority", "absent"], "o_orderdate")


CELLS = ["segment", "bin_num", "bin_min", "bin_max", "count", "percentage", "value", "probability"]
CELL_SQL = """SELECT '{kind}' AS kind, stratum, metric, {segment} AS segment, bin_num, round(bin_min, 6) AS bin_min, round(bin_max, 6) AS bin_max, CAST(count AS BIGINT) AS count,
  round(count * 100.0::DOUBLE / t, 6) AS percentage, CAST(NULL AS DOUBLE) AS value, CAST(NULL AS DOUBLE) AS probability FROM {rows} JOIN {edges} USING ({keys})"""
CURVE_SQL = """SELECT 'ecdf', stratum, metric, NULL, NULL, NULL, NULL, NULL, NULL, value,
  round(sum(n) OVER (PARTITION BY stratum, metric ORDER BY value) / sum(n) OVER (PARTITION BY stratum, metric), 8) FROM c"""
COUNTS = ", c AS (SELECT stratum, metric, value, count(*) AS n FROM {vals} GROUP BY ALL)"


def cells(df):
    """Whole rows of bins and curves, rounded."""
    return rnd(rnd(df, ["bin_min", "bin_max", "percentage"]), ["probability"], 8).select("kind", *KEYS, *CELLS)


@query("k26_panel", views="obs win", cte=SEG + COUNTS.format(vals="vals"), sql="SELECT * FROM (" + CELL_SQL.format(
    kind="bins", segment="segment", rows="fin", edges="ed", keys="stratum, metric, segment") + " UNION ALL " + CURVE_SQL + ") WHERE metric = 'view'")
def k26(spark, sf):
    v = materialise(values(spark, sf), "windowed")  # both results read the joined values once
    return cells(D.panel(D.segmented_bins(v, config(spark), KEYS, ["metric"]), D.ecdf(v, KEYS), "view", "icu"))


# three sources of one user: laboratory values in their unit, vital signs, respiratory settings
STREAM = """ms AS (SELECT encounter_block, recorded_dttm, 'labs/' || category AS metric, value FROM (SELECT *, CASE WHEN setting < 30 THEN ' MG/dL' WHEN setting < 50 THEN NULL
      WHEN setting < 60 THEN '' ELSE 'mmol/L ' END AS u FROM obs) WHERE (category IN ('view', 'error') AND trim(lower(u)) = 'mg/dl') OR (category = 'click' AND trim(lower(u)) = 'mmol/l')
    UNION ALL SELECT encounter_block, recorded_dttm, 'vitals/' || category, setting FROM obs
    UNION ALL SELECT encounter_block, recorded_dttm, 'resp/peep_set', peep_set FROM resp UNION ALL SELECT encounter_block, recorded_dttm, 'resp/lpm_set', lpm_set FROM resp
    UNION ALL SELECT encounter_block, recorded_dttm, 'resp/fio2_set', fio2_set FROM resp),
  sw AS (SELECT encounter_block, start_dttm, end_dttm, unnest(['icu', 'icu/even']) AS stratum FROM win),
  al AS (SELECT stratum, metric, value FROM ms JOIN (SELECT * FROM sw WHERE stratum = 'icu' OR encounter_block % 2 = 0) USING (encounter_block)
    WHERE recorded_dttm BETWEEN start_dttm AND end_dttm AND value BETWEEN CASE WHEN metric = 'resp/fio2_set' THEN 0.21 ELSE 1 END AND 300)"""


def stream(spark, sf):
    o = V.obs(spark, sf)
    units = {"view": ["mg/dL"], "error": ["mg/dL"], "click": ["mmol/L"]}
    return D.measurement_stream(labs(spark, sf), o.withColumn("value", F.col("setting")), V.resp(spark, sf), units,
                                ["peep_set", "lpm_set", "fio2_set"], BLOCK, "recorded_dttm")


def stream_config(spark):
    """Bins of laboratory values and vital signs; settings have none."""
    return config(spark).withColumn("metric", F.explode(F.array(*[F.concat(F.lit(f"{s}/"), "metric") for s in ("labs", "vitals")])))


def stream_values(spark, sf, count_once=False):
    w = V.win(spark, sf)
    w = w.withColumn("stratum", F.explode(F.array_compact(F.array(F.lit("icu"), F.when(F.col(BLOCK) % 2 == 0, "icu/even")))))
    if count_once:
        # a second window inside the first: its values still count once
        w = w.unionByName(w.withColumn("start_dttm", F.timestamp_micros(F.floor((F.unix_micros("start_dttm") + F.unix_micros("end_dttm")) / 2))))
    names = [(f"{s}/{c}", 1.0, 300.0) for s in ("labs", "vitals") for c in V.LOCATION]
    r = spark.createDataFrame([*names, ("resp/peep_set", 1.0, 300.0), ("resp/lpm_set", 1.0, 300.0), ("resp/fio2_set", 0.21, 300.0)],
                              "metric string, outlier_min double, outlier_max double")
    return D.windowed_metrics(stream(spark, sf), w, r, BLOCK, "recorded_dttm", count_once=count_once).select(*KEYS, "value")


FLAT = f""", rs AS (SELECT * FROM al WHERE metric LIKE 'resp/%'), fd AS (SELECT stratum, metric, {_edges('value', 10)} AS e, count(*) AS t FROM rs GROUP BY ALL),
  """ + _bins("fb", "rs", ["stratum", "metric"], "fd")
ALL_SOURCES = STREAM + ", vals AS (SELECT * FROM al WHERE metric NOT LIKE 'resp/%'),\n" + SEG[SEG.index("sg AS ("):] + FLAT + COUNTS.format(vals="al")


@query("k9_all_sources", views="obs resp win", cte=ALL_SOURCES, sql=CELL_SQL.format(kind="bins", segment="segment", rows="fin", edges="ed", keys="stratum, metric, segment")
       + " UNION ALL " + CELL_SQL.format(kind="flat", segment="NULL", rows="fb", edges="fd", keys="stratum, metric") + " UNION ALL " + CURVE_SQL)
def k9_all(spark, sf):
    return cells(D.metric_panels(stream_values(spark, sf), stream_config(spark), KEYS, ["metric"]))


@query("k9_counted_once", views="obs resp win", cte=STREAM + COUNTS.format(vals="al"), sql="SELECT stratum, metric, value, round(probability, 8) AS probability FROM ("
       + CURVE_SQL.replace("NULL, NULL, NULL, NULL, NULL, NULL, value,", "value,").replace("/ sum(n) OVER (PARTITION BY stratum, metric), 8)", "/ sum(n) OVER (PARTITION BY stratum, metric), 8) AS probability") + ")")
def k9_once(spark, sf):
    """Two windows that overlap; every value counts once in a stratum."""
    return rnd(D.ecdf(stream_values(spark, sf, count_once=True), KEYS), ["probability"], 8)


@query("k27_profile_table", views="visit", sql="""SELECT 'location_category' AS "column", location_category AS value, count(*) AS count, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM visit), 2) AS percentage, NULL AS mean FROM visit GROUP BY 2
  UNION ALL SELECT 'setting', NULL, count(setting), NULL, round(avg(setting), 6) FROM visit""")
def k27(spark, sf):
    p = D.profile_table(V.visit(spark, sf), "adt", {"adt": (["location_category", "absent"], ["setting"])})
    return p.select("column", "value", "count", "percentage", F.round("mean", 6).alias("mean"))


