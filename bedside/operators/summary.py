"""Per-table summaries as long (section, item, value, pct) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import attach, count_when, days_between, hours_between, pct, top_k, union_all
from bedside.functions.ordered import Ordered
from bedside.functions.quantiles import with_quantiles
from bedside.operators import journey
from bedside.operators.dist import by_time_part
from bedside.operators.severity import cci_category

HOSP = "hospitalization_id"


def figures(df: DataFrame, section: str, items: dict[str, Column], quantiles: dict | None = None) -> DataFrame:
    """Named figures of a table, one row each."""
    wide = with_quantiles(df, [], [c.cast("double").alias(n) for n, c in items.items()], quantiles) if quantiles else df.agg(
        *[c.cast("double").alias(n) for n, c in items.items()])
    names = [*items, *[n for d in (quantiles or {}).values() for n in d]]
    rows = F.array(*[F.struct(F.lit(section).alias("section"), F.lit(n).alias("item"), F.col(n).cast("double").alias("value")) for n in names])
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def levels(df: DataFrame, section: str, col: str, top: int | None = None, by: str | None = None) -> DataFrame:
    """Known levels with rows (or distinct ``by`` ids) and share of all rows (or ids)."""
    n = F.count(F.lit(1)) if by is None else F.countDistinct(by)
    c = df.where(F.col(col).isNotNull()).groupBy(F.col(col).cast("string").alias("item")).agg(n.cast("double").alias("value"))
    total = df.agg(n.alias("_t"))
    if top is not None:
        c = top_k(c, top, [F.desc("value"), F.asc("item")])
    return attach(c, total).select(F.lit(section).alias("section"), "item", "value", F.round(pct(F.col("value"), F.col("_t")), 2).alias("pct"))


def diversity(df: DataFrame, section: str, col: str, ident: str = HOSP) -> DataFrame:
    """Hospitalizations with one and with several levels, and the most of any."""
    per = df.groupBy(ident).agg(F.countDistinct(col).alias("k"))
    return figures(per, section, {"single": count_when(F.col("k") == 1), "multiple": count_when(F.col("k") > 1), "most": F.max("k")})


def hours_of_day(df: DataFrame, ts: str) -> DataFrame:
    return by_time_part(df, ts, "hour").select(F.lit("hour").alias("section"), F.col("hour").cast("string").alias("item"), F.col("n").cast("double").alias("value"))


def labs_summary(labs: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    known = F.col("lab_value").isNotNull()
    parts = [
        figures(labs, "basic", {"records": n, "hospitalizations": F.countDistinct(HOSP), "categories": F.countDistinct("lab_category"),
                                "order_categories": F.countDistinct("lab_order_category")}),
        levels(labs, "order_category", "lab_order_category"), levels(labs, "top_labs", "lab_category", 10),
        figures(labs, "results", {"numeric": F.count("lab_value_numeric"), "text_only": count_when(known & F.col("lab_value_numeric").isNull()),
                                  "missing": count_when(~known)})]
    if "lab_specimen_category" in labs.columns:
        s = F.col("lab_specimen_category")
        parts.append(figures(labs, "specimen", {"types": F.countDistinct(s), "with": F.count(s), "without": count_when(s.isNull())}))
    if {"lab_order_dttm", "lab_result_dttm"} <= set(labs.columns):
        t = labs.withColumn("_h", hours_between("lab_order_dttm", "lab_result_dttm")).where("_h > 0")
        parts.append(figures(t, "turnaround", {"mean_hours": F.avg("_h")}, {"_h": {"median_hours": 0.5}}))
    return union_all(parts)


def vitals_summary(vitals: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    seen = vitals.where("recorded_dttm is not null")
    return union_all([
        figures(vitals, "basic", {"records": n, "hospitalizations": F.countDistinct(HOSP), "types": F.countDistinct("vital_category")}),
        levels(vitals, "top_vitals", "vital_category", 5),
        figures(seen, "recording", {"days": F.countDistinct(F.to_date("recorded_dttm")), "per_hospitalization": n / F.countDistinct(HOSP)}),
        figures(vitals, "missing", {"values": count_when(F.col("vital_value").isNull()), "percent": pct(count_when(F.col("vital_value").isNull()), n)}),
        hours_of_day(seen, "recorded_dttm")])


def respiratory_summary(resp: DataFrame) -> DataFrame:
    parts = [
        figures(resp, "basic", {"records": F.count(F.lit(1)), "hospitalizations": F.countDistinct(HOSP), "devices": F.countDistinct("device_category"),
                                "modes": F.countDistinct("mode_category")}),
        levels(resp, "top_modes", "mode_category", 5, HOSP), levels(resp, "top_devices", "device_category", 5), diversity(resp, "mode_diversity", "mode_category")]
    parts += [figures(resp, "oxygen", {f"{c}_n": F.count(c), f"{c}_mean": F.avg(c)}) for c in ("lpm_set", "fio2_set") if c in resp.columns]
    return union_all(parts)


def position_summary(position: DataFrame, tie: str) -> DataFrame:
    """Changes per hospitalization, time to the next row, prone exposure, missing share."""
    n, prone = F.count(F.lit(1)), F.col("position_category") == "prone"
    per = position.groupBy(HOSP).agg(n.alias("_k"))
    nxt = Ordered(position.where("recorded_dttm is not null"), [HOSP], ["recorded_dttm", tie]).lead("_next", "recorded_dttm").apply()
    nxt = nxt.where("_next is not null").withColumn("_h", hours_between("recorded_dttm", "_next"))
    miss = count_when(F.col("position_category").isNull())
    return union_all([
        figures(position, "basic", {"records": n, "hospitalizations": F.countDistinct(HOSP), "positions": F.countDistinct("position_category")}),
        levels(position, "positions", "position_category"),
        figures(per, "changes", {"mean": F.avg("_k"), "most": F.max("_k")}, {"_k": {"median": 0.5}}),
        figures(nxt, "duration", {"mean_hours": F.avg("_h")}, {"_h": {"median_hours": 0.5}}),
        figures(position, "prone", {"hospitalizations": F.countDistinct(F.when(prone, F.col(HOSP))), "records": count_when(prone),
                                    "percent": pct(F.countDistinct(F.when(prone, F.col(HOSP))), F.countDistinct(HOSP))}),
        figures(position, "missing", {"records": miss, "percent": pct(miss, n)}), diversity(position, "diversity", "position_category"),
        hours_of_day(position, "recorded_dttm")])


def _numbers(df: DataFrame, section: str, col: str, extra: dict[str, Column] | None = None) -> DataFrame:
    d = df.where(F.col(col).isNotNull())
    return figures(d, section, {"count": F.count(col), "mean": F.avg(col), "std": F.stddev_samp(col), "min": F.min(col), "max": F.max(col), **(extra or {})},
                   {col: {"q1": 0.25, "median": 0.5, "q3": 0.75}})


def _ages(df: DataFrame) -> DataFrame:
    a = F.col("age_at_admission")
    return _numbers(df, "age", "age_at_admission", {"adults": count_when(a >= 18), "children": count_when(a < 18)})


def hospitalization_summary(hosp: DataFrame) -> DataFrame:
    h = hosp.withColumn("_los", days_between("admission_dttm", "discharge_dttm"))
    return union_all([
        figures(hosp, "basic", {"hospitalizations": F.countDistinct(HOSP), "patients": F.countDistinct("patient_id")}), _ages(hosp), _numbers(h, "stay", "_los"),
        levels(hosp, "discharge", "discharge_category", 5), levels(hosp, "admission_type", "admission_type_category", 3)])


def patient_summary(patients: DataFrame, hosp: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    parts = [figures(patients, "basic", {"patients": F.countDistinct("patient_id")}), levels(patients, "sex", "sex_category"), levels(patients, "race", "race_category", 3),
             levels(patients, "ethnicity", "ethnicity_category"), _ages(patients.join(hosp.select("patient_id", "age_at_admission"), "patient_id", "left"))]
    if "death_dttm" in patients.columns:
        parts.append(figures(patients, "deaths", {"count": F.count("death_dttm"), "percent": pct(F.count("death_dttm"), n)}))
    return union_all(parts)


def adt_summary(adt: DataFrame) -> DataFrame:
    """Encounter categories, ICU stays, durations and location levels."""
    cats = journey.encounter_categories(adt)
    rows = F.array(*[F.struct(F.lit("encounters").alias("section"), F.lit(c).alias("item"), F.col(c).cast("double").alias("value")) for c in cats.columns])
    d = adt.where("in_dttm is not null and out_dttm is not null").withColumn("_h", hours_between("in_dttm", "out_dttm"))
    icu = adt.where("location_category = 'icu'")
    return union_all([cats.select(F.explode(rows).alias("r")).select("r.*"), _numbers(d, "duration_hours", "_h"), levels(adt, "location", "location_category"),
                      figures(icu, "icu", {"events": F.count(F.lit(1)), "hospitalizations": F.countDistinct(HOSP)})])


def diagnosis_summary(dx: DataFrame, cci: DataFrame, top: int = 20) -> DataFrame:
    """Format shares by rows and hospitalizations, top codes, diagnoses per hospitalization,
    usable ICD-10 share and comorbidity bands."""
    n = F.count(F.lit(1))
    per = dx.groupBy(HOSP).agg(n.alias("_k"))
    codes = top_k(dx.groupBy(F.col("diagnosis_code").alias("item")).agg(n.alias("_rows"), F.countDistinct(HOSP).cast("double").alias("value")), top,
                  [F.desc("_rows"), F.asc("item")])
    total = dx.agg(F.countDistinct(HOSP).alias("_t"))
    codes = attach(codes, total).select(F.lit("top_codes").alias("section"), "item", "value", F.round(pct(F.col("value"), F.col("_t")), 2).alias("pct"))
    ten = count_when(F.col("diagnosis_code_format") == "ICD10CM")
    return union_all([
        figures(dx, "basic", {"diagnoses": n, "hospitalizations": F.countDistinct(HOSP), "codes": F.countDistinct("diagnosis_code")}),
        levels(dx, "format_rows", "diagnosis_code_format"), levels(dx, "format_hospitalizations", "diagnosis_code_format", None, HOSP), codes,
        figures(per, "per_hospitalization", {"mean": F.avg("_k"), "most": F.max("_k")}, {"_k": {"median": 0.5}}),
        figures(dx, "comorbidity_index", {"icd10_rows": ten, "percent": pct(ten, n)}),
        levels(cci.withColumn("band", cci_category("cci_score")), "comorbidity_band", "band")])
