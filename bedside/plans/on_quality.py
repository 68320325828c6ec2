"""Data quality and review (L)."""

from pyspark.sql import functions as F

from bedside.operators import quality as Q
from bedside.plans import views as V
from bedside.plans.on_resp import rnd
from bedside.plans.registry import query

BLOCK = "encounter_block"


def chk(name, bad, src, fail, table):
    """SQL of one check row."""
    return (f"""SELECT '{table}' AS "table", '{name}' AS "check", count(*) FILTER ({bad}) AS count, round_even(count(*) FILTER ({bad}) * 100.0::DOUBLE / count(*), 2) AS percentage, """
            f"CASE WHEN count(*) FILTER ({bad}) = 0 THEN 'pass' ELSE '{fail}' END AS status FROM {src}")


@query("l1_duplicate_keys", sql=" UNION ALL ".join(f"""SELECT '{t}' AS "table", 'duplicate_keys' AS "check", CAST(coalesce(sum(n) FILTER (n > 1), 0) AS BIGINT) AS count,
  round_even(coalesce(sum(n) FILTER (n > 1), 0) * 100.0::DOUBLE / sum(n), 2) AS percentage, CASE WHEN coalesce(sum(n) FILTER (n > 1), 0) = 0 THEN 'pass' ELSE 'error' END AS status
  FROM (SELECT count(*) AS n FROM {t} GROUP BY {k})""" for t, k in (("lineitem", "l_orderkey, l_linenumber"), ("orders", "o_orderkey"), ("events", "user_id, event_type, CAST(ts AS DATE)"))))
def l1(spark, sf):
    ev = V.table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    return Q.combined_report([Q.duplicate_keys(V.table(spark, sf, "lineitem"), "lineitem", ["l_orderkey", "l_linenumber"]),
                              Q.duplicate_keys(V.table(spark, sf, "orders"), "orders", ["o_orderkey"]), Q.duplicate_keys(ev, "events", ["user_id", "event_type", "d"])])


@query("l2_date_order", cte="lo AS (SELECT * FROM lineitem JOIN orders ON l_orderkey = o_orderkey)", sql=chk("invalid_date_ranges", "l_shipdate < o_orderdate", "lo", "error", "lineitem"))
def l2(spark, sf):
    lo = V.table(spark, sf, "lineitem").join(V.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return Q.run_checks(lo, "lineitem", [Q.date_order("o_orderdate", "l_shipdate")])


@query("l3_missing_category", views="obs resp", sql=chk("missing_device_category", "device_category IS NULL", "resp", "warning", "respiratory_support"))
def l3(spark, sf):
    return Q.run_checks(V.resp(spark, sf), "respiratory_support", [Q.missing_value("device_category")])


@query("l4_invalid_category", views="obs resp", sql=chk("invalid_device_category", "coalesce(lower(device_category), '') NOT IN ('imv', 'nippv', '', 'nan', 'none')", "resp", "warning", "resp"))
def l4(spark, sf):
    return Q.run_checks(V.resp(spark, sf), "resp", [Q.not_permitted("device_category", ["IMV", "NIPPV"])])


@query("l4_offending_values", views="obs resp", sql="SELECT device_category AS value, count(*) AS n FROM resp WHERE device_category NOT IN ('imv', 'nippv') GROUP BY 1")
def l4o(spark, sf):
    return Q.offending_values(V.resp(spark, sf), "device_category", Q.not_permitted("device_category", ["IMV", "NIPPV"]))


@query("l5_future_timestamps", sql=chk("future_o_orderdate", "o_orderdate > TIMESTAMP '2000-01-01 00:00:00'", "orders", "warning", "orders"))
def l5(spark, sf):
    return Q.run_checks(V.table(spark, sf, "orders"), "orders", [Q.in_future("o_orderdate", "2000-01-01 00:00:00")])


@query("l6_negative_values", sql=chk("negative_c_acctbal", "c_acctbal < 0", "customer", "error", "customer"))
def l6(spark, sf):
    return Q.run_checks(V.table(spark, sf, "customer"), "customer", [Q.negative("c_acctbal")])


@query("l7_range_checks", sql=chk("out_of_range_l_discount", "l_discount < 0.02 OR l_discount > 0.08", "lineitem", "warning", "lineitem") + " UNION ALL "
       + chk("out_of_range_l_extendedprice", "l_extendedprice > 99999", "lineitem", "warning", "lineitem"))
def l7(spark, sf):
    return Q.run_checks(V.table(spark, sf, "lineitem"), "lineitem", [Q.outside("l_discount", 0.02, 0.08), Q.outside("l_extendedprice", None, 99999)])


MG = "mg AS (SELECT * REPLACE (CASE WHEN event_id % 11 = 0 THEN 'other' ELSE med_group END AS med_group) FROM meds)"


@query("l8_group_mapping", views="meds", cte=MG, sql=chk("mismatched_category_group", "med_group <> CASE WHEN med_category = 'propofol' THEN 'sedation' ELSE 'vasoactives' END", "mg", "warning", "meds"))
def l8(spark, sf):
    m = V.meds(spark, sf).withColumn("med_group", F.when(F.col("event_id") % 11 == 0, "other").otherwise(F.col("med_group")))
    return Q.run_checks(m, "meds", [Q.wrong_group()])


@query("l9_dose_without_unit", views="meds", sql=chk("missing_dose_units", "med_dose IS NOT NULL AND med_dose_unit IS NULL", "meds", "warning", "meds"))
def l9(spark, sf):
    return Q.run_checks(V.meds(spark, sf), "meds", [Q.dose_without_unit()])


@query("l10_several_primaries", views="dx", cte="p AS (SELECT hospitalization_id, sum(diagnosis_primary) AS n FROM dx GROUP BY 1)", sql="""SELECT 'multiple_primary_diagnoses' AS "check", count(*) FILTER (n > 1) AS count,
  round_even(count(*) FILTER (n > 1) * 100.0::DOUBLE / count(*), 2) AS percentage, CASE WHEN count(*) FILTER (n > 1) = 0 THEN 'pass' ELSE 'warning' END AS status FROM p""")
def l10(spark, sf):
    return Q.several_primaries(V.dx(spark, sf))


@query("l11_code_length", views="dx", cte="d2 AS (SELECT * REPLACE (diagnosis_code || repeat('1', CAST(p_size % 5 AS INTEGER)) AS diagnosis_code) FROM dx)",
       sql=chk("invalid_code_lengths", "(diagnosis_code_format = 'ICD9CM' AND length(replace(diagnosis_code, '.', '')) NOT BETWEEN 3 AND 5) OR (diagnosis_code_format = 'ICD10CM' AND length(replace(diagnosis_code, '.', '')) NOT BETWEEN 3 AND 7)", "d2", "warning", "dx"))
def l11(spark, sf):
    d = V.dx(spark, sf).withColumn("diagnosis_code", F.concat("diagnosis_code", F.expr("repeat('1', p_size % 5)")))
    return Q.run_checks(d, "dx", [Q.code_length()])


SPEC = Q.TableSpec(types={"device_category": "VARCHAR", "fio2_set": "FLOAT", "lpm_set": "INTEGER", "mode_category": "VARCHAR"}, required=["encounter_block", "recorded_dttm", "tracheostomy"],
                   permitted={"device_category": ["imv", "nippv", "high flow nc", "nasal cannula"]}, ranges={"lpm_set": (1, 60), "peep_set": (None, 98)}, order=[("recorded_dttm", "next_dttm")])


def full(spark, sf):
    r = V.resp(spark, sf).withColumn("next_dttm", F.timestamp_micros(F.unix_micros("recorded_dttm") + (F.col("event_id") % 7 - 1) * F.lit(1000)))
    return Q.full_check(r, "respiratory_support", SPEC)


def _fc(cat, check, col, bad):
    p = f"count(*) FILTER ({bad}) * 100.0::DOUBLE / count(*)"
    return (f"""SELECT 'respiratory_support' AS "table", '{cat}' AS category, '{check}' AS "check", '{col}' AS "column", count(*) FILTER ({bad}) AS count, round_even({p}, 2) AS percentage,
      CASE WHEN {p} >= 10 THEN 'error' WHEN {p} >= 1 THEN 'warning' ELSE 'pass' END AS severity FROM resp""")


def _fx(check, col, bad):
    return f"SELECT 'respiratory_support', 'conformance', '{check}', '{col}', {bad}, {bad * 100.0}::DOUBLE, '{'error' if bad else 'pass'}'"


FULL = " UNION ALL ".join([_fc("completeness", "missing", c, f"{c} IS NULL") for c in SPEC.types] + [
    _fc("conformance", "permitted_values", "device_category", "coalesce(device_category, '') NOT IN ('imv', 'nippv', 'high flow nc', 'nasal cannula', '')"),
    _fc("plausibility", "range", "lpm_set", "lpm_set < 1 OR lpm_set > 60"), _fc("plausibility", "range", "peep_set", "peep_set > 98"),
    _fc("plausibility", "date_order", "recorded_dttm>next_dttm", "event_id % 7 = 0")] + [_fx("required_column", c, int(c == "tracheostomy")) for c in SPEC.required]
    + [_fx("type", c, int(c == "lpm_set")) for c in SPEC.types])


@query("l12_full_check", views="obs resp", sql=FULL)
def l12(spark, sf):
    return full(spark, sf)


@query("l13_value_coverage", sql="""SELECT 'p_type' AS "column", v AS value FROM (SELECT unnest(['Economy', 'PROMO', 'Bespoke', 'Custom']) AS v) WHERE lower(v) NOT IN (SELECT lower(p_type) FROM part)""")
def l13(spark, sf):
    vocab = spark.createDataFrame([("p_type", x) for x in ("Economy", "PROMO", "Bespoke", "Custom")], "column string, value string")
    return Q.value_coverage(V.table(spark, sf, "part"), vocab, "p_type")


@query("l14_missing_references", cte="i AS (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1), p AS (SELECT DISTINCT user_id AS k FROM events)",
       sql="""SELECT 'orders' AS child, 'events' AS parent, 'patient_id' AS "key", count(*) AS n_ids, count(*) FILTER (p.k IS NULL) AS n_missing, CAST(coalesce(sum(n) FILTER (p.k IS NULL), 0) AS BIGINT) AS rows_missing,
  round_even(count(*) FILTER (p.k IS NULL) * 100.0::DOUBLE / count(*), 2) AS percentage FROM i LEFT JOIN p ON i.k = p.k""")
def l14(spark, sf):
    o = V.table(spark, sf, "orders").withColumnRenamed("o_custkey", "patient_id")
    e = V.table(spark, sf, "events").withColumnRenamed("user_id", "patient_id")
    return Q.missing_references(o, e, "patient_id", "orders", "events")


def _cc(name, a, b):
    v = f"count(*) FILTER (e NOT IN (SELECT encounter_block FROM blocks WHERE {b}))"
    return f"SELECT '{name}' AS rule, count(*) AS n_applicable, {v} AS n_violations, round_even({v} * 100.0::DOUBLE / count(*), 2) AS percentage FROM (SELECT DISTINCT encounter_block AS e FROM blocks WHERE {a})"


@query("l15_conditional_completeness", views="blocks", sql=_cc("imv needs icu", "device_category = 'imv'", "location_category = 'icu'") + " UNION ALL "
       + _cc("pressor needs device", "med_category = 'norepinephrine'", "device_category IN ('imv', 'nippv')"))
def l15(spark, sf):
    b = V.blocks(spark, sf)
    return Q.conditional_completeness([("imv needs icu", b.where("device_category = 'imv'"), b.where("location_category = 'icu'"), BLOCK),
                                       ("pressor needs device", b.where("med_category = 'norepinephrine'"), b.where("device_category in ('imv', 'nippv')"), BLOCK)])


@query("l16_monthly_trend", sql="""SELECT o_orderpriority AS category, strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, round(avg(o_totalprice), 4) AS avg FROM orders GROUP BY 1, 2
  UNION ALL SELECT o_orderpriority, NULL, count(*), NULL FROM orders GROUP BY 1""")
def l16(spark, sf):
    return rnd(Q.monthly_trend(V.table(spark, sf, "orders"), "o_orderdate", "o_orderpriority", "o_totalprice"), ["avg"], 4)


@query("l17_column_profile", views="obs resp", sql=" UNION ALL ".join(f"""SELECT '{c}' AS "column", '{t}' AS dtype, count({c}) AS n, count(*) - count({c}) AS missing, count(DISTINCT {c}) AS "distinct" FROM resp"""
                                                                       for c, t in (("event_id", "INTEGER"), ("recorded_dttm", "DATETIME"), ("device_category", "VARCHAR"), ("fio2_set", "FLOAT"))))
def l17(spark, sf):
    return Q.column_profile(V.resp(spark, sf).select("event_id", "recorded_dttm", "device_category", "fio2_set"))


# Issues: one per (source, quality) of the labelled documents; every fourth is a coverage error with several values.
ISS = """it AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY ALL), il AS (SELECT source, list_sort(list(lang)) AS langs, CAST(sum(n) AS BIGINT) AS n FROM it GROUP BY 1),
  issues AS (SELECT 'completeness' AS category, 'value_coverage' AS check_type, 'Missing values in ' || source AS message, langs AS mv FROM il UNION ALL
    SELECT 'Plausibility', 'range check', 'Rows of ' || source || ': ' || n, [] FROM il),
  ids AS (SELECT *, lower(replace(category || '_' || check_type, ' ', '_')) || '_' || substr(md5(message), 1, 8) AS issue_id FROM issues),
  items AS (SELECT issue_id, category, check_type, message, unnest(CASE WHEN check_type = 'value_coverage' AND len(mv) > 1 THEN mv ELSE [NULL] END) AS value FROM ids)"""


def issues(spark, sf):
    it = V.table(spark, sf, "documents").groupBy("source", "lang").agg(F.count(F.lit(1)).alias("n"))
    il = it.groupBy("source").agg(F.array_sort(F.collect_list("lang")).alias("langs"), F.sum("n").alias("n"))
    a = il.select(F.lit("completeness").alias("category"), F.lit("value_coverage").alias("check_type"), F.concat(F.lit("Missing values in "), "source").alias("message"),
                  F.lit("error").alias("severity"), F.col("langs").alias("missing_values"))
    b = il.select(F.lit("Plausibility").alias("category"), F.lit("range check").alias("check_type"), F.concat(F.lit("Rows of "), "source", F.lit(": "), F.col("n").cast("string")).alias("message"),
                  F.lit("error").alias("severity"), F.array().cast("array<string>").alias("missing_values"))
    return a.unionByName(b)


@query("l18_issue_ids", cte=ISS, sql="SELECT issue_id, message FROM ids")
def l18(spark, sf):
    return issues(spark, sf).select(Q.issue_id(F.col("category"), F.col("check_type"), F.col("message")).alias("issue_id"), "message")


@query("l19_review_items", cte=ISS, sql="SELECT issue_id, value, 'pending' AS decision FROM items")
def l19(spark, sf):
    return Q.review_items(issues(spark, sf)).select("issue_id", "value", "decision")


DEC = ISS + """, cur AS (SELECT *, CASE WHEN value = 'en' THEN 'rejected' WHEN value = 'fr' THEN 'accepted' WHEN value IS NULL AND message LIKE 'Rows of %' AND substr(md5(message), 1, 1) < '8' THEN 'rejected' ELSE 'pending' END AS decision FROM items)"""


def current(spark, sf):
    items = Q.review_items(issues(spark, sf))
    # each atom is decided twice; the later decision counts
    first = items.select("issue_id", "value", F.lit("accepted").alias("decision"), F.lit("first look").alias("reason"), F.lit(1).alias("decided_at")).where("value in ('en', 'fr')")
    second = items.select("issue_id", "value", F.when(F.col("value") == "en", "rejected").when(F.col("value") == "fr", "accepted").when(
        F.col("value").isNull() & (F.substring(F.md5("message"), 1, 1) < "8"), "rejected").alias("decision"), F.lit("second look").alias("reason"), F.lit(2).alias("decided_at"))
    return Q.current_decisions(items, first.unionByName(second.where("decision is not null")))


@query("l19_current_decisions", cte=DEC, sql="SELECT issue_id, value, decision FROM cur")
def l19c(spark, sf):
    return current(spark, sf).select("issue_id", "value", "decision")


@query("l20_decision_counts", cte=DEC, sql="""SELECT category, count(*) FILTER (decision = 'accepted') AS accepted_count, count(*) FILTER (decision = 'rejected') AS rejected_count,
  count(*) FILTER (decision = 'pending') AS pending_count, count(*) AS total_errors FROM cur GROUP BY 1""")
def l20(spark, sf):
    return Q.decision_counts(current(spark, sf), ["category"])


@query("l20_adjusted_status", cte=DEC, sql="""SELECT issue_id AS "table", CASE WHEN count(*) FILTER (decision <> 'rejected') > 0 THEN 'incomplete' ELSE 'complete' END AS adjusted_status FROM cur GROUP BY 1""")
def l20s(spark, sf):
    c = current(spark, sf).withColumnRenamed("issue_id", "table")
    return Q.adjusted_status(c, c.select("table").distinct().withColumn("original_status", F.lit("incomplete"))).select("table", "adjusted_status")


@query("l21_split_by_decision", cte=DEC + ", g AS (SELECT issue_id, message, decision, count(*) AS atoms, list_sort(list(value) FILTER (value IS NOT NULL)) AS vs FROM cur GROUP BY ALL), tc AS (SELECT issue_id, bool_or(decision <> 'pending') AS t FROM g GROUP BY 1)",
       sql="""SELECT issue_id, decision, atoms, CASE WHEN t AND len(vs) > 0 THEN CASE decision WHEN 'rejected' THEN 'Rejected' WHEN 'accepted' THEN 'Acknowledged' ELSE 'Missing' END || ' ' || atoms || ' values: ' || array_to_string(vs, ', ')
  ELSE message END AS message FROM g JOIN tc USING (issue_id)""")
def l21(spark, sf):
    return Q.split_by_decision(current(spark, sf)).select("issue_id", "decision", "atoms", "message")


@query("l22_score_summary", views="obs resp", cte=f"fc AS ({FULL})", sql="""SELECT category, count(*) FILTER (severity = 'pass') + CASE WHEN category = 'completeness' THEN 1 ELSE 0 END + CASE WHEN category = 'conformance' THEN 1 ELSE 0 END AS passed,
  count(*) + CASE WHEN category = 'conformance' THEN 2 ELSE 0 END AS total, round_even((count(*) FILTER (severity = 'pass') + CASE WHEN category = 'completeness' THEN 1 ELSE 0 END + CASE WHEN category = 'conformance' THEN 1 ELSE 0 END) * 100.0::DOUBLE
  / (count(*) + CASE WHEN category = 'conformance' THEN 2 ELSE 0 END), 1) AS pct FROM fc GROUP BY 1""")
def l22(spark, sf):
    rej = spark.createDataFrame([("respiratory_support", "completeness", 1)], "table string, category string, n_rejected int")
    # an absent table: two conformance rows (one passes here), one plausibility row that must not count
    gone = spark.createDataFrame([("ecmo_mcs", "conformance", "pass"), ("ecmo_mcs", "conformance", "error"), ("ecmo_mcs", "plausibility", "error")], "table string, category string, severity string")
    c = full(spark, sf).select("table", "category", "severity").unionByName(gone)
    return Q.score_summary(c, rej, gone)


@query("l23_combined_report", sql=chk("negative_c_acctbal", "c_acctbal < 0", "customer", "error", "customer") + " UNION ALL " + chk("future_o_orderdate", "o_orderdate > TIMESTAMP '2000-01-01 00:00:00'", "orders", "warning", "orders"))
def l23(spark, sf):
    return Q.combined_report([l6(spark, sf), l5(spark, sf)])


@query("l24_critical_gate", sql="""SELECT n AS "table", CASE WHEN n IN (SELECT source FROM documents) THEN 'failed' ELSE 'missing' END AS problem FROM (SELECT unnest(['Labs', 'src0', 'src1', 'src19']) AS n)
  WHERE n NOT IN (SELECT source FROM documents) OR n IN (SELECT source FROM documents GROUP BY 1 HAVING max(n_chars) > 20000)""")
def l24(spark, sf):
    f = V.table(spark, sf, "documents").groupBy(F.col("source").alias("table")).agg(F.max("n_chars").alias("m")).withColumn(
        "message", F.when(F.col("m") > 20000, "File NOT FOUND").otherwise("ok"))
    return Q.critical_gate(f, ["Labs", "src0", "src1", "src19"])
