"""Data-quality checks, review decisions and score summaries.

All row rules of a table are counted in one aggregate; examples are a short filtered
read per failing rule.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.functions.expr import count_when, first_by, flag, pct, union_all

# Identifying columns per table.
KEYS = {
    "patient": ["patient_id"],
    "hospitalization": ["hospitalization_id"],
    "adt": ["hospitalization_id", "in_dttm", "location_category"],
    "code_status": ["patient_id", "start_dttm"],
    "crrt_therapy": ["hospitalization_id", "recorded_dttm"],
    "ecmo_mcs": ["hospitalization_id", "recorded_dttm", "device_category"],
    "hospital_diagnosis": ["hospitalization_id", "diagnosis_code"],
    "labs": ["hospitalization_id", "lab_collect_dttm", "lab_category"],
    "medication_admin_continuous": ["hospitalization_id", "admin_dttm", "med_category", "mar_action_category"],
    "medication_admin_intermittent": ["hospitalization_id", "admin_dttm", "med_category", "mar_action_category"],
    "microbiology_culture": ["hospitalization_id", "collect_dttm", "organism_category"],
    "microbiology_nonculture": ["hospitalization_id", "result_dttm", "organism_category"],
    "microbiology_susceptibility": ["organism_id", "antimicrobial_category"],
    "patient_assessments": ["hospitalization_id", "recorded_dttm", "assessment_category"],
    "patient_procedures": ["hospitalization_id", "procedure_billed_dttm", "procedure_code"],
    "position": ["hospitalization_id", "recorded_dttm"],
    "respiratory_support": ["hospitalization_id", "recorded_dttm"],
    "vitals": ["hospitalization_id", "recorded_dttm", "vital_category"],
}
# Permitted categories.
SEX = ["Male", "Female", "Other", "Unknown"]
CODE_STATUS = ["DNR", "DNAR", "UDNR", "DNR/DNI", "DNAR/DNI", "AND", "Full", "Presume Full", "Other"]
CRRT_MODES = ["scuf", "cvvh", "cvvhd", "cvvhdf", "avvh"]
MCS_DEVICES = ["Impella", "Centrimag", "TandemHeart", "HeartMate", "ECMO", "Other"]
MCS_GROUPS = ["Impella_2.5", "Impella_CP", "Impella_5.0", "Impella_5.5", "Impella_LD", "Impella_RP", "Impella_RP_Flex",
              "iVAC", "TandemHeart_LV", "TandemHeart_RV", "CentriMag_LV", "CentriMag_RV", "IABP",
              "VA_ECMO", "VV_ECMO", "VAV_ECMO", "LAVA_ECMO", "HeartWare", "HMII", "HMIII"]
# Expected drug groups.
DRUG_GROUPS = {"norepinephrine": "vasoactives", "epinephrine": "vasoactives", "phenylephrine": "vasoactives",
               "vasopressin": "vasoactives", "dopamine": "vasoactives", "dobutamine": "vasoactives", "milrinone": "vasoactives",
               "propofol": "sedation", "dexmedetomidine": "sedation", "midazolam": "sedation", "fentanyl": "sedation"}
# Tables without which no Table One is made.
CRITICAL_TABLES = ["Patient", "Hospitalization", "ADT", "Labs", "Vitals", "Medication Admin Continuous", "Patient Assessments",
                   "Hospital Diagnosis", "Respiratory Support"]
# Type names for drift reports.
TYPE_NAMES = {"double": "FLOAT", "float": "FLOAT", "decimal": "FLOAT", "bigint": "INTEGER", "int": "INTEGER", "smallint": "INTEGER",
              "tinyint": "INTEGER", "timestamp": "DATETIME", "timestamp_ntz": "DATETIME", "string": "VARCHAR", "boolean": "BOOLEAN", "date": "DATE"}
ERROR_AT, WARN_AT = 10.0, 1.0


@dataclass
class Check:
    """A row rule: rows that meet ``bad`` count against it; ``on_fail`` is its status then."""
    name: str
    bad: Column
    on_fail: str = "warning"


def run_checks(df: DataFrame, table: str, checks: list[Check]) -> DataFrame:
    """(table, check, count, percentage, status) for all rules in one pass."""
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[count_when(c.bad).alias(f"c{i}") for i, c in enumerate(checks)])
    rows = F.array(*[F.struct(F.lit(c.name).alias("check"), F.col(f"c{i}").alias("count"), F.bround(F.coalesce(
        pct(F.col(f"c{i}"), F.col("_n")), F.lit(0.0)), 2).alias("percentage"), F.when(F.col(f"c{i}") == 0, "pass").otherwise(
        c.on_fail).alias("status")) for i, c in enumerate(checks)])
    return wide.select(F.lit(table).alias("table"), F.explode(rows).alias("r")).select("table", "r.*")


def examples(df: DataFrame, check: Check, columns: list[str], n: int = 10) -> DataFrame:
    """Up to n rows that break a rule: Spark stops reading once it has them."""
    return df.where(check.bad).select(*[c for c in columns if c in df.columns]).limit(n)


def duplicate_keys(df: DataFrame, table: str, keys: list[str] | None = None, on_fail: str = "error") -> DataFrame:
    """All rows whose key occurs more than once."""
    keys = keys or KEYS[table]
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    s = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_t"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("count"))
    return s.select(F.lit(table).alias("table"), F.lit("duplicate_keys").alias("check"), "count", F.bround(F.coalesce(
        pct(F.col("count"), F.col("_t")), F.lit(0.0)), 2).alias("percentage"), F.when(F.col("count") == 0, "pass").otherwise(on_fail).alias("status"))


def date_order(first: str, second: str, name: str = "invalid_date_ranges") -> Check:
    return Check(name, F.col(second) < F.col(first), "error")


def missing_value(column: str, on_fail: str = "warning") -> Check:
    return Check(f"missing_{column}", F.col(column).isNull(), on_fail)


def not_permitted(column: str, permitted: list[str], on_fail: str = "warning", case_sensitive: bool = False) -> Check:
    """Category outside its vocabulary; null and blank text are tolerated."""
    v = F.coalesce(F.col(column).cast("string"), F.lit(""))
    if case_sensitive:
        return Check(f"invalid_{column}", F.col(column).isNotNull() & ~v.isin(permitted), on_fail)
    return Check(f"invalid_{column}", ~F.lower(v).isin([p.lower() for p in permitted] + ["", "nan", "none"]), on_fail)


def offending_values(df: DataFrame, column: str, check: Check) -> DataFrame:
    return df.where(check.bad & F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))


def in_future(column: str, now) -> Check:
    """Later than ``now``, which the caller fixes so that a run can be repeated."""
    return Check(f"future_{column}", F.col(column) > F.lit(now).cast("timestamp"), "warning")


def negative(column: str, on_fail: str = "error") -> Check:
    return Check(f"negative_{column}", F.col(column) < 0, on_fail)


def outside(column: str, low=None, high=None, on_fail: str = "warning") -> Check:
    bad = F.lit(False)
    if low is not None:
        bad = bad | (F.col(column) < low)
    if high is not None:
        bad = bad | (F.col(column) > high)
    return Check(f"out_of_range_{column}", bad, on_fail)


def wrong_group(category: str = "med_category", group: str = "med_group", expected: dict[str, str] | None = None) -> Check:
    m = expected or DRUG_GROUPS
    want = F.element_at(F.create_map(*[F.lit(x) for kv in m.items() for x in kv]), F.col(category))
    return Check("mismatched_category_group", F.col(group) != want, "warning")


def dose_without_unit(dose: str = "med_dose", unit: str = "med_dose_unit") -> Check:
    return Check("missing_dose_units", F.col(dose).isNotNull() & F.col(unit).isNull(), "warning")


def several_primaries(dx: DataFrame, ident: str = "hospitalization_id") -> DataFrame:
    """Hospitalizations with more than one primary diagnosis."""
    per = dx.groupBy(ident).agg(F.sum(flag(F.col("diagnosis_primary") == 1)).alias("n"))
    return per.agg(count_when(F.col("n") > 1).alias("count"), F.bround(F.coalesce(pct(count_when(F.col("n") > 1), F.count(F.lit(1))), F.lit(0.0)), 2)
                   .alias("percentage")).select(F.lit("multiple_primary_diagnoses").alias("check"), "count", "percentage", F.when(
                       F.col("count") == 0, "pass").otherwise("warning").alias("status"))


def code_length(code: str = "diagnosis_code", fmt: str = "diagnosis_code_format") -> Check:
    n = F.length(F.regexp_replace(F.col(code), r"\.", ""))
    return Check("invalid_code_lengths", ((F.col(fmt) == "ICD9CM") & ~n.between(3, 5)) | ((F.col(fmt) == "ICD10CM") & ~n.between(3, 7)), "warning")


def issue_id(category, check_type, message) -> Column:
    """Stable id: category, check type and the start of a hash of the message."""
    prefix = F.when(category == "", check_type).otherwise(F.concat(category, F.lit("_"), check_type))
    return F.concat(F.lower(F.regexp_replace(prefix, " ", "_")), F.lit("_"), F.substring(F.md5(message), 1, 8))


@dataclass
class TableSpec:
    """What a table must look like for the full check. ``types`` uses the report names,
    ``ranges`` is column -> (low, high), ``order`` is [(earlier, later)]."""
    types: dict[str, str]
    required: list[str]
    permitted: dict[str, list[str]] | None = None
    ranges: dict[str, tuple] | None = None
    order: list[tuple[str, str]] | None = None
    units: dict[str, list[str]] | None = None


def type_name(spark_type: str) -> str:
    return TYPE_NAMES.get(spark_type.split("(")[0], spark_type.upper())


def full_check(df: DataFrame | None, table: str, spec: TableSpec, spark: SparkSession | None = None) -> DataFrame:
    """Conformance, completeness and plausibility of one table as rows
    (table, category, check, column, count, percentage, severity). Shares of 10 % and more are
    errors, of 1 % and more warnings; structural faults are errors. An absent table fails
    its required columns only."""
    spark = df.sparkSession if df is not None else spark
    have = dict(df.dtypes) if df is not None else {}
    schema = "table string, category string, check string, column string, count bigint, percentage double, severity string"
    fixed = [(table, "conformance", "required_column", c, int(c not in have), 0.0 if c in have else 100.0, "pass" if c in have else "error")
             for c in spec.required]
    fixed += [(table, "conformance", "type", c, int(type_name(have[c]) != t), 0.0 if type_name(have[c]) == t else 100.0,
               "pass" if type_name(have[c]) == t else "error") for c, t in spec.types.items() if c in have]
    out = spark.createDataFrame(fixed, schema)
    if df is None:
        return out
    rules = [("completeness", "missing", c, F.col(c).isNull()) for c in spec.types if c in have]
    rules += [("conformance", "permitted_values", c, not_permitted(c, v).bad) for c, v in (spec.permitted or {}).items() if c in have]
    rules += [("conformance", "unit", c, not_permitted(c, v).bad) for c, v in (spec.units or {}).items() if c in have]
    rules += [("plausibility", "range", c, outside(c, lo, hi).bad) for c, (lo, hi) in (spec.ranges or {}).items() if c in have]
    rules += [("plausibility", "date_order", f"{a}>{b}", F.col(b) < F.col(a)) for a, b in (spec.order or []) if a in have and b in have]
    wide = df.agg(F.count(F.lit(1)).alias("_n"), *[count_when(r[3]).alias(f"c{i}") for i, r in enumerate(rules)])
    share = lambda i: F.coalesce(pct(F.col(f"c{i}"), F.col("_n")), F.lit(0.0))
    rows = F.array(*[F.struct(F.lit(cat).alias("category"), F.lit(chk).alias("check"), F.lit(c).alias("column"), F.col(f"c{i}").alias("count"),
                              F.bround(share(i), 2).alias("percentage"), F.when(share(i) >= ERROR_AT, "error").when(
                                  share(i) >= WARN_AT, "warning").otherwise("pass").alias("severity")) for i, (cat, chk, c, _) in enumerate(rules)])
    return out.unionByName(wide.select(F.lit(table).alias("table"), F.explode(rows).alias("r")).select("table", "r.*"))


def value_coverage(df: DataFrame, vocabulary: DataFrame, column: str) -> DataFrame:
    """Vocabulary values never seen in the data, case-insensitive; one row per value.
    ``vocabulary`` is (column, value)."""
    seen = df.select(F.lower(F.trim(F.col(column).cast("string"))).alias("_v")).distinct()
    return vocabulary.where(F.col("column") == column).withColumn("_v", F.lower(F.trim("value"))).join(seen, "_v", "left_anti").drop("_v")


def missing_references(child: DataFrame, parent: DataFrame, key: str, child_name: str, parent_name: str) -> DataFrame:
    """Distinct child ids and rows without a parent."""
    ids = child.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    lost = ids.join(parent.select(key).distinct().withColumn("_in", F.lit(1)), key, "left")
    gone = F.col("_in").isNull()
    return lost.agg(F.count(F.lit(1)).alias("n_ids"), count_when(gone).alias("n_missing"), F.coalesce(F.sum(F.when(gone, F.col("n"))), F.lit(0)).alias(
        "rows_missing")).select(F.lit(child_name).alias("child"), F.lit(parent_name).alias("parent"), F.lit(key).alias("key"), "*",
                                F.bround(pct(F.col("n_missing"), F.col("n_ids")), 2).alias("percentage"))


def conditional_completeness(rules: list[tuple[str, DataFrame, DataFrame, str]]) -> DataFrame:
    """'If A then B' across tables: ids in A and how many of them lack B. Rules are
    (name, A rows, B rows, key)."""
    parts = []
    for name, a, b, key in rules:
        j = a.select(key).distinct().join(b.select(key).distinct().withColumn("_b", F.lit(1)), key, "left")
        parts.append(j.agg(F.count(F.lit(1)).alias("n_applicable"), count_when(F.col("_b").isNull()).alias("n_violations")).select(
            F.lit(name).alias("rule"), "*", F.bround(F.coalesce(pct(F.col("n_violations"), F.col("n_applicable")), F.lit(0.0)), 2).alias("percentage")))
    return union_all(parts)


def monthly_trend(df: DataFrame, ts: str, category: str, value: str | None = None) -> DataFrame:
    """Rows (and mean value) per month and category, with the all-time row (month null).
    Only the all-time rows are meant to leave the site."""
    aggs = [F.count(F.lit(1)).alias("n")]
    if value:
        aggs.append(F.avg(value).alias("avg"))
    m = df.withColumns({"month": F.date_format(F.date_trunc("month", F.col(ts)), "yyyy-MM"), "category": F.col(category)})
    monthly = m.groupBy("category", "month").agg(*aggs)
    overall = monthly.groupBy("category").agg(F.sum("n").alias("n"))
    return monthly.unionByName(overall, allowMissingColumns=True)


def column_profile(df: DataFrame) -> DataFrame:
    """Actual type (report name), non-null and distinct count of every column."""
    w = df.agg(F.count(F.lit(1)).alias("_t"), *[x for c in df.columns for x in (F.count(F.col(c)).alias(f"{c}__n"), F.countDistinct(F.col(c)).alias(f"{c}__d"))])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), F.lit(type_name(t)).alias("dtype"), F.col(f"{c}__n").alias("n"), (F.col("_t") - F.col(f"{c}__n"))
                              .alias("missing"), F.col(f"{c}__d").alias("distinct")) for c, t in df.dtypes])
    return w.select(F.explode(rows).alias("r")).select("r.*")


def review_items(issues: DataFrame) -> DataFrame:
    """Pending decisions, one per error atom: the issue itself, or each missing value of a
    coverage error with more than one. ``issues`` is (category, check_type, message, severity,
    missing_values array)."""
    e = issues.where("severity = 'error'").withColumn("issue_id", issue_id(F.col("category"), F.col("check_type"), F.col("message")))
    multi = (F.col("check_type") == "value_coverage") & (F.size("missing_values") > 1)
    atoms = F.when(multi, F.col("missing_values")).otherwise(F.array(F.lit(None).cast("string")))
    return e.withColumn("value", F.explode(atoms)).select("issue_id", "category", "check_type", "message", "severity", "value",
                                                          F.lit("pending").alias("decision"), F.lit("").alias("reason"))


def current_decisions(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Latest decision per atom. A decision on the whole issue (value null) is inherited by
    values that have none of their own. ``decisions`` is (issue_id, value, decision, reason,
    decided_at)."""
    last = first_by(decisions.withColumn("_v", F.coalesce("value", F.lit(""))), ["issue_id", "_v"], ["decided_at", "decision", "reason"],
                    ["decided_at", "decision", "reason"], last=True)
    own = last.where("_v <> ''").select("issue_id", F.col("_v").alias("value"), F.struct("decision", "reason").alias("_own"))
    whole = last.where("_v = ''").select("issue_id", F.struct("decision", "reason").alias("_whole"))
    # an issue whose values were ever decided one by one no longer passes its own decision on
    split = own.select("issue_id").distinct().withColumn("_split", F.lit(1))
    j = items.drop("decision", "reason").join(own, ["issue_id", "value"], "left").join(whole, "issue_id", "left").join(split, "issue_id", "left")
    d = F.coalesce("_own", F.when(F.col("_split").isNull() | F.col("value").isNull(), F.col("_whole")))
    return j.withColumns({"decision": F.coalesce(d["decision"], F.lit("pending")), "reason": F.coalesce(d["reason"], F.lit(""))}).drop(
        "_own", "_whole", "_split")


def decision_counts(current: DataFrame, keys: list[str] | None = None) -> DataFrame:
    of = lambda v: count_when(F.col("decision") == v)
    return current.groupBy(*(keys or [])).agg(of("accepted").alias("accepted_count"), of("rejected").alias("rejected_count"),
                                              of("pending").alias("pending_count"), F.count(F.lit(1)).alias("total_errors"))


def adjusted_status(current: DataFrame, statuses: DataFrame, key: str = "table") -> DataFrame:
    """'complete' only when every error atom was rejected, or there is none."""
    c = decision_counts(current, [key])
    return statuses.join(c, key, "left").withColumn("adjusted_status", F.when(
        F.coalesce(F.col("accepted_count"), F.lit(0)) + F.coalesce(F.col("pending_count"), F.lit(0)) > 0, F.col("original_status")).otherwise("complete"))


def split_by_decision(current: DataFrame) -> DataFrame:
    """One row per issue and decision bucket for reports: values listed, reasons joined. An
    issue still all pending stays whole under its own message."""
    g = current.groupBy("issue_id", "category", "check_type", "message", "decision").agg(
        F.array_sort(F.collect_list("value")).alias("values"), F.array_sort(F.collect_set(F.when(F.col("reason") != "", F.col("reason")))).alias("_r"),
        F.count(F.lit(1)).alias("atoms"))
    touched = g.groupBy("issue_id").agg(F.max(flag(F.col("decision") != "pending")).alias("_touched"))
    label = F.when(F.col("decision") == "rejected", "Rejected").when(F.col("decision") == "accepted", "Acknowledged").otherwise("Missing")
    text = F.concat(label, F.lit(" "), F.col("atoms").cast("string"), F.lit(" values: "), F.concat_ws(", ", "values"))
    multi = F.size("values") > 0
    return g.join(touched, "issue_id").select(
        "issue_id", "category", "check_type", "decision", "atoms", F.when(multi & (F.col("_touched") == 1), text).otherwise(F.col("message")).alias("message"),
        F.concat_ws("; ", "_r").alias("reason"))


def score_summary(checks: DataFrame, rejected: DataFrame, absent: DataFrame | None = None) -> DataFrame:
    """Passed and total per category; rejected atoms count as passed; absent tables add
    conformance only. ``checks`` is (table, category, severity); ``rejected`` is
    (table, category, n_rejected); ``absent`` lists tables."""
    c = checks
    if absent is not None:
        c = c.join(absent.select("table").distinct().withColumn("_abs", F.lit(1)), "table", "left").where(
            F.col("_abs").isNull() | (F.col("category") == "conformance")).drop("_abs")
    s = c.groupBy("table", "category").agg(count_when(F.col("severity") == "pass").alias("passed"), F.count(F.lit(1)).alias("total"))
    s = s.join(rejected, ["table", "category"], "left").groupBy("category").agg(
        F.sum(F.col("passed") + F.coalesce("n_rejected", F.lit(0))).alias("passed"), F.sum("total").alias("total"))
    return s.withColumn("pct", F.bround(pct(F.col("passed"), F.col("total")), 1))


def combined_report(tables: list[DataFrame]) -> DataFrame:
    """One row per check over all tables."""
    return union_all(tables)


def critical_gate(found: DataFrame, names: list[str] | None = None, column: str = "table") -> DataFrame:
    """Required tables that are missing or were not found. ``found`` has the table name and
    a message."""
    spark = found.sparkSession
    need = spark.createDataFrame([(n,) for n in (names or CRITICAL_TABLES)], f"`{column}` string")
    ok = found.groupBy(column).agg(F.max(flag(F.lower("message").contains("not found"))).alias("_lost"))
    j = need.join(ok, column, "left")
    return j.where(F.col("_lost").isNull() | (F.col("_lost") == 1)).select(column, F.when(F.col("_lost").isNull(), "missing").otherwise("failed").alias("problem"))
