"""Baseline-characteristics tables and stratified summary tables.

Numbers first: every table is a long numeric frame (group keys, pos, label, n, denom,
median, q1, q3); text cells and wide layouts are a last projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedside.functions.expr import attach, count_when, first_by, pct, union_all, wilson
from bedside.functions.quantiles import with_quantiles
from bedside.operators import temporal
from bedside.operators.clean import stack
from bedside.operators.dist import numeric_summary
from bedside.operators.disclosure import count_text
from bedside.operators.severity import CHARLSON, cci_category

BLOCK = "encounter_block"


@dataclass
class Row:
    """One line (or block of level lines) of the table. ``kind``: count, distinct, sum,
    flag, levels, median or header. ``within`` is a flag column that limits the line to a
    sub-population, which is then also the denominator."""
    label: str
    kind: str
    column: str | None = None
    within: str | None = None
    patient: bool = False


# Labels and order of the table.
CORE_ROWS = [
    Row("N: Encounter blocks", "count"),
    Row("N: Unique patients", "distinct", "patient_id"),
    Row("N: Hospitals", "distinct", "hospital_id"),
    Row("Age at admission, median [Q1, Q3]", "median", "age_at_admission"),
    Row("  Race", "levels", "race_category", patient=True),
    Row("  Ethnicity", "levels", "ethnicity_category", patient=True),
    Row("  Sex", "levels", "sex_category", patient=True),
    Row("Encounter Types", "header"),
    Row("  ICU encounters, n (%)", "flag", "icu_enc"),
    Row("  Advanced respiratory support, n (%)", "flag", "high_support_enc"),
    Row("  Vasoactive support, n (%)", "flag", "vaso_support_enc"),
    Row("  Other critically ill, n (%)", "flag", "other_critically_ill"),
]
WARD_ROW = Row("  Ward only (survived, no critical care), n (%)", "flag", "ward_no_critical_care")
ICU_ROWS = [
    Row("ICU episodes, total n", "sum", "icu_episodes"),
    Row("Encounters with >=1 ICU episode, n (%)", "flag", "any_icu_episode"),
]
OUTCOME_ROWS = [
    Row("Hospital mortality, n (%)", "flag", "death_enc"),
    Row("  Discharged to hospice, n (%)", "flag", "hospice_outcome"),
    Row("  Expired, n (%)", "flag", "expired_outcome"),
    Row("  First admission location", "levels", "first_admission_location"),
    Row("  Admission type", "levels", "admission_type_category"),
]
ICU_STAY_ROW = Row("ICU length of stay (days), median [Q1, Q3]", "median", "first_icu_los_days")
STAY_ROWS = [
    Row("Hospital length of stay (days), median [Q1, Q3]", "median", "hospital_length_of_stay_days"),
    Row("Charlson Comorbidity Index, median [Q1, Q3]", "median", "cci_score"),
]
SOFA_ROWS = [
    Row("SOFA Scores", "header"),
    Row("  Total SOFA score, median [Q1, Q3]", "median", "sofa_total"),
    Row("    Respiratory, median [Q1, Q3]", "median", "sofa_resp"),
    Row("    Coagulation, median [Q1, Q3]", "median", "sofa_coag"),
    Row("    Liver, median [Q1, Q3]", "median", "sofa_liver"),
    Row("    Cardiovascular, median [Q1, Q3]", "median", "sofa_cv_97"),
    Row("    CNS, median [Q1, Q3]", "median", "sofa_cns"),
    Row("    Renal, median [Q1, Q3]", "median", "sofa_renal"),
    Row("  P/F ratio, median [Q1, Q3]", "median", "p_f"),
    Row("  P/F ratio (imputed), median [Q1, Q3]", "median", "p_f_imputed"),
]
THERAPY_ROWS = [
    Row("CRRT, n (%)", "flag", "crrt_flag"),
    Row("Sepsis events (CDC ASE), n", "sum", "sepsis_events_by_sepsis_col"),
    Row("Encounters with >=1 sepsis event, n (%)", "flag", "any_sepsis"),
]
VENT_ROWS = [
    Row("Invasive mechanical ventilation, n (%)", "flag", "on_vent"),
    Row("Ventilator hours", "sum", "vent_duration_hours"),
    Row("  First location at IMV start", "levels", "first_location_imv", "on_vent"),
    Row("  Initial ventilator mode", "levels", "initial_mode_category", "on_vent"),
    Row("Time to extubation (hrs), median [Q1, Q3]", "median", "time_to_extubation_hours", "on_vent"),
    Row("  Extubation outcome", "levels", "extubation_status", "on_vent"),
    Row("Reintubation (≥2 IMV episodes), n (%)", "flag", "reintubated", "on_vent"),
    Row("  VFD, median [Q1, Q3]", "median", "vfd_28", "on_vent"),
    Row("  NIDFD, median [Q1, Q3]", "median", "nidfd_28", "nippv_hfnc_enc"),
]
VASOPRESSORS = ["norepinephrine", "epinephrine", "phenylephrine", "vasopressin", "dopamine"]
SEDATIVES = ["propofol", "midazolam", "lorazepam", "dexmedetomidine", "fentanyl"]
BLOCKERS = ["cisatracurium", "rocuronium"]


def _drug_rows(within: str | None, pad: str) -> list[Row]:
    rows = [Row(f"{pad}Vasopressor encounters, n (%)" if within is None else f"{pad}Vasopressors, n (%)", "flag", "any_vasopressor", within)]
    for d in VASOPRESSORS:
        rows += [Row(f"{pad}  {d.title()}, n (%)", "flag", f"{d}_flag", within),
                 Row(f"{pad}    {d.title()} dose (mcg/kg/min), median [Q1, Q3]", "median", f"{d}_median", within)]
    for title, drugs in (("Sedatives and analgesics, n (%)", SEDATIVES), ("Neuromuscular blocking agents, n (%)", BLOCKERS)):
        rows += [Row(f"{pad}{title}", "header")] + [Row(f"{pad}  {d.title()}", "flag", f"{d}_flag", within) for d in drugs]
    return rows


DRUG_ROWS = _drug_rows(None, "")
IMV_DRUG_ROWS = [Row("Medications during IMV", "header"), *_drug_rows("on_vent", "  ")]


def table_one_rows(ward: bool = False) -> list[Row]:
    """The ward table has one encounter type more and no ICU, score or ventilation lines."""
    if ward:
        return [*CORE_ROWS, WARD_ROW, *OUTCOME_ROWS, *STAY_ROWS, *THERAPY_ROWS, *DRUG_ROWS]
    return [*CORE_ROWS, *ICU_ROWS, *OUTCOME_ROWS, ICU_STAY_ROW, *STAY_ROWS, *SOFA_ROWS, *THERAPY_ROWS, *VENT_ROWS, *DRUG_ROWS, *IMV_DRUG_ROWS]


def with_overall(enc: DataFrame, group: str, out: str = "column") -> DataFrame:
    """Every encounter under 'Overall' and under its own group."""
    return enc.withColumn(out, F.explode(F.array(F.lit("Overall"), F.col(group).cast("string"))))


def table_one(enc: DataFrame, rows: list[Row], keys: list[str], block: str = BLOCK, patient: str = "patient_id") -> DataFrame:
    """Numeric table for every combination of ``keys``. One wide conditional aggregate for
    counts, one count over stacked levels, one quantile pass over stacked values; lines
    whose column is absent are left out."""
    rows = [(i, r) for i, r in enumerate(rows) if r.column is None or r.column in enc.columns]
    rows = [(i, r) for i, r in rows if r.within is None or r.within in enc.columns]
    inside = lambda r: F.lit(True) if r.within is None else F.col(r.within) == 1
    parts = []

    wide = [(i, r) for i, r in rows if r.kind in ("count", "sum", "flag")]
    aggs, items = [F.count(F.lit(1)).alias("_all")], []
    for i, r in wide:
        n = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(F.col(r.column).cast("double")),
             "flag": lambda: count_when(inside(r) & (F.col(r.column) == 1))}[r.kind]()
        aggs.append(n.cast("double").alias(f"n{i}"))
        denom = F.lit(None).cast("double")
        if r.kind == "flag":
            denom = F.col("_all").cast("double")
            if r.within is not None:
                aggs.append(count_when(inside(r)).cast("double").alias(f"d{i}"))
                denom = F.col(f"d{i}")
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"),
                              F.col(f"n{i}").alias("n"), denom.alias("denom")))
    for i, r in rows:
        if r.kind == "header":
            items.append(F.struct(F.lit(i).alias("pos"), F.lit(r.label).alias("label"), F.lit("header").alias("kind"),
                                  F.lit(None).cast("double").alias("n"), F.lit(None).cast("double").alias("denom")))
    parts.append(enc.groupBy(*keys).agg(*aggs).select(*keys, F.explode(F.array(*items)).alias("_r")).select(*keys, "_r.*"))

    for i, r in rows:
        if r.kind == "distinct":
            parts.append(enc.groupBy(*keys).agg(F.countDistinct(r.column).cast("double").alias("n")).select(
                *keys, F.lit(i).alias("pos"), F.lit(r.label).alias("label"), F.lit("count").alias("kind"), "n"))

    for grain in (False, True):
        levels = [(i, r) for i, r in rows if r.kind == "levels" and r.patient == grain]
        if not levels:
            continue
        src = enc
        if grain:
            cols = [r.column for _, r in levels]
            src = first_by(enc, [*keys, patient], [block], [*keys, patient, *cols])
        e = F.array_compact(F.array(*[F.when(inside(r), F.struct(F.lit(i).alias("pos"), F.lit(r.label).alias("title"), F.coalesce(
            F.col(r.column).cast("string"), F.lit("Missing")).alias("level"))) for i, r in levels]))
        c = src.select(*keys, F.explode(e).alias("_e")).select(*keys, "_e.*").groupBy(*keys, "pos", "title", "level").agg(
            F.count(F.lit(1)).cast("double").alias("n"))
        d = c.groupBy(*keys, "pos").agg(F.sum("n").alias("denom"))
        parts.append(c.join(d, [*keys, "pos"]).select(*keys, "pos", F.concat("title", F.lit(": "), "level").alias("label"),
                                                      F.lit("flag").alias("kind"), "n", "denom"))

    medians = [(i, r) for i, r in rows if r.kind == "median"]
    if medians:
        e = F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(r.label).alias("label"), F.when(inside(r), F.col(r.column).cast("double")).alias("_v"))
                      for i, r in medians])
        long = enc.select(*keys, F.explode(e).alias("_e")).select(*keys, "_e.*").where("_v is not null")
        q = with_quantiles(long, [*keys, "pos", "label"], [F.count("_v").cast("double").alias("n")], {"_v": {"median": 0.5, "q1": 0.25, "q3": 0.75}})
        parts.append(q.withColumn("kind", F.lit("median")))
    out = union_all(parts)
    return out.withColumn("pct", pct(F.col("n"), F.col("denom")))


def cell_text() -> Column:
    """Text of a numeric line: '1,234', '1,234 (5.6%)' or '60 [41, 72]'."""
    one = lambda c: F.format_string("%.1f", F.bround(F.col(c), 1))
    return (F.when(F.col("kind") == "median", F.concat(one("median"), F.lit(" ["), one("q1"), F.lit(", "), one("q3"), F.lit("]")))
            .when(F.col("kind") == "flag", count_text("n", "pct")).when(F.col("kind") == "header", "").otherwise(count_text("n")))


def display_table(numbers: DataFrame, keys: list[str], column: str, columns: list[str]) -> DataFrame:
    """Wide text table: one line per label, one text column per wanted column value. Levels
    of one line follow each other by the frequency of the first column."""
    cells = numbers.withColumn("cell", cell_text())
    wide = cells.groupBy(*keys, "pos", "label").agg(
        *[F.coalesce(F.max(F.when(F.col(column) == c, F.col("cell"))), F.lit("")).alias(c) for c in columns],
        F.max(F.when(F.col(column) == columns[0], F.col("n"))).alias("_n"))
    w = Window.partitionBy(*keys).orderBy("pos", F.desc_nulls_last("_n"), "label")
    return wide.withColumn("line", F.row_number().over(w)).drop("pos", "_n")


def long_cells(numbers: DataFrame, table: str, column: str) -> DataFrame:
    """Numeric table as result cells for disclosure control."""
    return numbers.select(F.lit(table).alias("table"), "pos", F.trim("label").alias("label"), F.col(column).alias("column"),
                          cell_text().alias("cell"))


def pair_substrata(numbers: DataFrame, left: str, right: str, stratum: str = "stratum") -> DataFrame:
    """Two sub-strata side by side, left order first, blank where a line is missing."""
    half = lambda s, name: numbers.where(F.col(stratum) == s).select("label", "pos", cell_text().alias(name))
    return temporal.side_by_side(half(left, left.split("/")[-1]), half(right, right.split("/")[-1]), "label", "pos")


# Sub-strata shown side by side.
PAIRS = [("advanced_resp/icu", "advanced_resp/no_icu"), ("nippv_hfnc/icu", "nippv_hfnc/no_icu"), ("vaso/icu", "vaso/no_icu"),
         ("vaso/ed_icu", "vaso/ed_ward"), ("no_imv/icu", "no_imv/no_icu")]


def all_pairs(numbers: DataFrame, pairs: list[tuple[str, str]] | None = None, stratum: str = "stratum") -> DataFrame:
    """Every pair of sub-strata in one job: (pair, label, left, right), blank where missing."""
    side = {s: (f"{a} | {b}", name) for a, b in (pairs or PAIRS) for s, name in ((a, "left"), (b, "right"))}
    pair = F.create_map(*[F.lit(x) for s, (p, _) in side.items() for x in (s, p)])
    where = F.create_map(*[F.lit(x) for s, (_, n) in side.items() for x in (s, n)])
    d = numbers.withColumns({"pair": F.element_at(pair, F.col(stratum)), "_side": F.element_at(where, F.col(stratum)), "_cell": cell_text()})
    pick = lambda n: F.coalesce(F.max(F.when(F.col("_side") == n, F.col("_cell"))), F.lit("")).alias(n)
    return d.where("pair is not null").groupBy("pair", "label").agg(
        pick("left"), pick("right"), F.coalesce(F.min(F.when(F.col("_side") == "left", F.col("pos"))), F.min("pos")).alias("pos"))


# Lines that only some strata carry.
EXTRA_ROWS = [
    Row("Resp. device onset, n (%)", "flag", "has_onset"), Row("  Pre-device LOS (days), median [Q1, Q3]", "median", "pre_device_los_days"),
    Row("  Post-device LOS (days), median [Q1, Q3]", "median", "post_device_los_days"), Row("28-day VFD, median [Q1, Q3]", "median", "vfd_28"),
    Row("28-day NIDFD, median [Q1, Q3]", "median", "nidfd_28"), Row("Peak NEE (mcg/kg/min), median [Q1, Q3]", "median", "nee_peak"),
    Row("Time to ICU after first pressor (hours), median [Q1, Q3]", "median", "time_to_icu_hours")]


def stratum_extra_rows(enc: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that only some strata carry: stay around the device onset, free days, peak
    norepinephrine equivalent and time to ICU; their position follows an anchor line."""
    return table_one(enc, EXTRA_ROWS, keys)


def insert_after(numbers: DataFrame, extra: DataFrame, anchor: str) -> DataFrame:
    """Extra lines placed right after an anchor line (fractional positions, renumbered by
    whoever displays them)."""
    at = numbers.where(F.trim("label") == anchor).agg(F.max("pos").alias("_a"))
    moved = attach(extra, at).withColumn("pos", F.col("_a") + (F.col("pos") + 1) / 1000.0).drop("_a")
    return numbers.withColumn("pos", F.col("pos").cast("double")).unionByName(moved, allowMissingColumns=True)


def level_counts(df: DataFrame, keys: list[str], col: str) -> DataFrame:
    """n (%) of each level, missing shown, with its frequency order."""
    c = df.groupBy(*keys, F.coalesce(F.col(col).cast("string"), F.lit("Missing")).alias("level")).agg(F.count(F.lit(1)).alias("n"))
    t = c.groupBy(*keys).agg(F.sum("n").alias("_t"))
    c = c.join(t, keys) if keys else attach(c, t)
    return c.withColumn("pct", pct(F.col("n"), F.col("_t"))).drop("_t")


def median_rows(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """Median and quartiles over non-null values, one row per column."""
    return with_quantiles(stack(df, keys, cols), [*keys, "metric"], [F.count("value").alias("n")],
                          {"value": {"median": 0.5, "q1": 0.25, "q3": 0.75}})


def median_of_triples(df: DataFrame, keys: list[str], stems: list[str]) -> DataFrame:
    """Median over encounters of each per-encounter median / q1 / q3 column."""
    cols = [f"{s}_{x}" for s in stems for x in ("median", "q1", "q3")]
    return with_quantiles(df, keys, [F.count(F.lit(1)).alias("n")], {c: {f"m_{c}": 0.5} for c in cols})


def condition_rows(cci: DataFrame, keys: list[str], conditions: list[str] | None = None) -> DataFrame:
    """Encounters per comorbidity, only those that occur."""
    names = [c for c in (conditions or list(CHARLSON)) if c in cci.columns]
    wide = cci.groupBy(*keys).agg(*[F.sum(F.col(c).cast("long")).alias(c) for c in names], F.count(F.lit(1)).alias("_t"))
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("condition"), F.col(c).alias("n")) for c in names]))
    return wide.select(*keys, "_t", e.alias("_e")).select(*keys, "_e.*", pct(F.col("_e.n"), F.col("_t")).alias("pct")).where("n > 0")


# Levels of the enrolment crosstab.
RACES = ["American Indian or Alaska Native", "Asian", "Native Hawaiian or Other Pacific Islander", "Black or African American",
         "White", "Other", "Unknown"]
ETHNICITIES = ["Non-Hispanic", "Hispanic", "Unknown"]
SEXES = ["Female", "Male", "Unknown"]


def demographic_crosstab(patients: DataFrame, keys: list[str] | None = None, races: list[str] | None = None,
                         ethnicities: list[str] | None = None, sexes: list[str] | None = None, threshold: int = 10) -> DataFrame:
    """Dense race x ethnicity x sex counts with margins. Body cells of 1-9 are hidden (n
    null) and taken out of the margins they belong to, so what shows still adds up."""
    keys = keys or []
    races, ethnicities, sexes = races or RACES, ethnicities or ETHNICITIES, sexes or SEXES
    dims = ["race_category", "ethnicity_category", "sex_category"]
    p = patients.select(*keys, *[F.coalesce(c, F.lit("Unknown")).alias(c) for c in dims])
    counts = p.groupBy(*keys, *dims).agg(F.count(F.lit(1)).alias("n"))
    frame = counts.select(*keys).distinct() if keys else counts.agg(F.lit(1).alias("_one"))
    for c, levels in zip(dims, (races, ethnicities, sexes)):
        frame = frame.withColumn(c, F.explode(F.array(*[F.lit(x) for x in levels])))
    body = frame.drop("_one").join(counts, [*keys, *dims], "left").fillna(0, ["n"])
    hide = (F.col("n") >= 1) & (F.col("n") < threshold)
    # margins: all counts minus what is hidden
    signed = counts.unionByName(body.where(hide).withColumn("n", -F.col("n")))
    total = F.lit("Total")
    col_ok = F.col("ethnicity_category").isin(ethnicities) & F.col("sex_category").isin(sexes)
    m = [signed.where(F.col("race_category").isin(races)).groupBy(*keys, "race_category").agg(F.sum("n").alias("n")).withColumns(
            {"ethnicity_category": total, "sex_category": F.lit("")}),
         signed.where(col_ok).groupBy(*keys, "ethnicity_category", "sex_category").agg(F.sum("n").alias("n")).withColumn("race_category", total),
         signed.groupBy(*keys).agg(F.sum("n").alias("n")).withColumns({"race_category": total, "ethnicity_category": total, "sex_category": F.lit("")})]
    edges = frame.drop("_one")
    dense = union_all([
        edges.select(*keys, "race_category").distinct().withColumns({"ethnicity_category": total, "sex_category": F.lit("")}),
        edges.select(*keys, "ethnicity_category", "sex_category").distinct().withColumn("race_category", total),
        edges.select(*keys).distinct().withColumns({"race_category": total, "ethnicity_category": total, "sex_category": F.lit("")}) if keys
        else edges.limit(1).select(total.alias("race_category"), total.alias("ethnicity_category"), F.lit("").alias("sex_category"))])
    margins = dense.join(union_all(m), [*keys, *dims], "left").fillna(0, ["n"]).withColumn("text", F.col("n").cast("string"))
    body = body.withColumns({"text": F.when(hide, f"<{threshold}").otherwise(F.col("n").cast("string")), "n": F.when(~hide, F.col("n"))})
    return body.select(*keys, *dims, "n", "text").unionByName(margins.select(*keys, *dims, "n", "text"))


def latest_code_status(codes: DataFrame, tie: str | None = None) -> DataFrame:
    """Last known code status per patient."""
    known = F.col("code_status_category").isNotNull()
    key = F.when(known, F.struct(*[c for c in ("start_dttm", tie) if c], "code_status_category"))
    return codes.groupBy("patient_id").agg(F.max_by("code_status_category", key).alias("last_code_status_category"))


def code_status_by_type(enc: DataFrame, types: dict[str, str], col: str = "last_code_status_category") -> DataFrame:
    """Counts and shares per encounter type and status: with a Missing level, totals of both
    margins, share of known only, and missing share of the type."""
    tags = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(t)) for t, c in types.items()]))
    d = enc.withColumn("encounter_type", F.explode(tags))
    g = d.groupBy("encounter_type", F.coalesce(F.col(col), F.lit("Missing")).alias("code_status")).agg(F.count(F.lit(1)).alias("n"))
    both = g.unionByName(g.groupBy("code_status").agg(F.sum("n").alias("n")).withColumn("encounter_type", F.lit("Total")))
    t = both.groupBy("encounter_type").agg(F.sum("n").alias("_t"), F.coalesce(F.sum(F.when(F.col("code_status") == "Missing", F.col("n"))), F.lit(0)).alias("_m"))
    rows = both.join(t, "encounter_type").select(
        "encounter_type", "code_status", "n", F.bround(pct(F.col("n"), F.col("_t")), 2).alias("pct"),
        F.when(F.col("code_status") != "Missing", F.bround(pct(F.col("n"), F.col("_t") - F.col("_m")), 4)).alias("pct_known"))
    sums = t.select("encounter_type", F.lit("Total").alias("code_status"), F.col("_t").alias("n"), F.lit(100.0).alias("pct"),
                    F.bround(pct(F.col("_m"), F.col("_t")), 2).alias("pct_missing"))
    return rows.unionByName(sums, allowMissingColumns=True)


def comorbidity_prevalence(cci: DataFrame, keys: list[str] | None = None, conditions: list[str] | None = None) -> DataFrame:
    """n, percent and rate per 1000 per condition."""
    keys = keys or []
    names = [c for c in (conditions or list(CHARLSON)) if c in cci.columns]
    wide = cci.groupBy(*keys).agg(*[F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0)).alias(c) for c in names], F.countDistinct(BLOCK).alias("_t"))
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("comorbidity"), F.col(c).alias("n_patients")) for c in names]))
    d = wide.select(*keys, "_t", e.alias("_e")).select(*keys, "_t", "_e.*")
    return d.withColumns({"prevalence_percent": F.bround(pct(F.col("n_patients"), F.col("_t")), 2),
                          "per_1000_hospitalizations": F.bround(F.col("n_patients") * 1000 / F.col("_t"), 1)}).drop("_t")


def comorbidity_headline(prevalence: DataFrame, total: DataFrame) -> DataFrame:
    """Totals, average per hospitalization and the most common condition. ``total`` has ``n_total``."""
    s = prevalence.agg(F.sum("n_patients").alias("total_comorbidities"), F.max_by(
        "comorbidity", F.struct("per_1000_hospitalizations", "n_patients", "comorbidity")).alias("most_common"), F.max("per_1000_hospitalizations").alias("most_common_per_1000"))
    return attach(s, total).withColumn("avg_per_hospitalization", F.bround(F.col("total_comorbidities") / F.col("n_total"), 2))


def end_of_life(enc: DataFrame, keys: list[str]) -> DataFrame:
    """Encounters, hospice, expired and either, with shares, hospice share of end-of-life
    and its Wilson interval (percent)."""
    s = lambda c: F.coalesce(F.sum(F.col(c).cast("long")), F.lit(0))
    d = enc.groupBy(*keys).agg(F.count(F.lit(1)).alias("total_encounters"), s("hospice_outcome").alias("hospice"),
                               s("expired_outcome").alias("expired"), s("hospice_or_expired").alias("hospice_or_expired"))
    _, lo, hi = wilson(F.col("hospice"), F.col("hospice_or_expired"))
    some = F.col("hospice_or_expired") > 0
    return d.withColumns({
        "hospice_pct": pct(F.col("hospice"), F.col("total_encounters")), "mortality_pct": pct(F.col("expired"), F.col("total_encounters")),
        "hospice_among_eol_pct": pct(F.col("hospice"), F.col("hospice_or_expired")),
        "ci_lower": F.when(some, lo * 100), "ci_upper": F.when(some, hi * 100)})


def hospice_trends(enc: DataFrame, year: str = "admission_year") -> DataFrame:
    return end_of_life(enc, [year]).fillna(0.0, ["ci_lower", "ci_upper"])


CCI_LEVELS = ["0 (No comorbidity)", "1-2 (Mild)", "3-4 (Moderate)", "5+ (Severe)"]


def comorbidity_outcomes(enc: DataFrame, year: str = "admission_year") -> DataFrame:
    """End-of-life outcomes per year and comorbidity category on a dense grid."""
    d = end_of_life(enc.where("cci_score is not null").withColumn("cci_category", cci_category("cci_score")), [year, "cci_category"])
    grid = enc.where(F.col(year).isNotNull()).select(year).distinct().withColumn("cci_category", F.explode(F.array(*[F.lit(x) for x in CCI_LEVELS])))
    out = grid.join(d, [year, "cci_category"], "left").fillna(0, ["total_encounters", "hospice", "expired", "hospice_or_expired"])
    return out.withColumns({"combined_eol_pct": pct(F.col("hospice_or_expired"), F.col("total_encounters")),
                            "hospice_capture_rate": pct(F.col("hospice"), F.col("expired"))})


def outcome_inconsistencies(rows: DataFrame, block: str = BLOCK) -> DataFrame:
    """All rows of encounters flagged dead that have a row without an outcome."""
    dead = rows.where("death_enc = 1")
    bad = dead.where("expired_outcome = 0 and hospice_outcome = 0").select(block).distinct()
    return dead.join(bad, block, "left_semi")


def summary_by_group(df: DataFrame, numeric: list[str], keys: list[str]) -> DataFrame:
    """N, missing, min, quartiles, mean and max of each numeric column per group."""
    s = numeric_summary(df, keys, numeric, "linear")
    return s.select(*keys, "variable", F.col("n").alias("N"), "missing", "min", F.col("q1").alias("q25"), "median", F.col("q3").alias("q75"), "mean", "max")


def demographics_slice(lines: DataFrame, label: str = "label", line: str = "line", stop: str = "SOFA Scores") -> DataFrame:
    """Lines before the score section; everything when there is none."""
    cut = lines.agg(F.min(F.when(F.trim(label) == stop, F.col(line))).alias("_cut"))
    return attach(lines, cut).where(F.col("_cut").isNull() | (F.col(line) < F.col("_cut"))).drop("_cut")


# Headline lines and their names.
HEADLINES = {
    "N: Encounter blocks": "n_encounters", "N: Unique patients": "n_patients", "N: Hospitals": "n_hospitals",
    "Age at admission, median [Q1, Q3]": "age_median_iqr", "Hospital mortality, n (%)": "hospital_mortality", "Sex: Male": "sex_male",
    "Sex: Female": "sex_female", "ICU episodes, total n": "icu_episodes_total", "Sepsis events (CDC ASE), n": "sepsis_events_total",
    "Encounters with >=1 sepsis event, n (%)": "sepsis_encounters",
}


def headline(flow: DataFrame, mortality: DataFrame, lines: DataFrame, column: str = "Overall") -> DataFrame:
    """Flow counts, mortality rates and key lines as one small (section, name, value) table."""
    names = F.create_map(*[F.lit(x) for kv in HEADLINES.items() for x in kv])
    key = F.element_at(names, F.trim(F.col("label")))
    return union_all([
        flow.select(F.lit("flow").alias("section"), F.col("count_name").alias("name"), F.col("count_value").cast("string").alias("value")),
        mortality.select(F.lit("mortality").alias("section"), F.col("count_name").alias("name"), F.col("count_value").cast("string").alias("value")),
        lines.where(key.isNotNull()).select(F.lit("kpi").alias("section"), key.alias("name"), F.col(column).alias("value"))])
