"""Organ-failure score, dose conversion, comorbidity, sepsis and exposure flags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.functions.expr import attach, Z95, any_flag, flag, lookup, pct
from bedside.functions.ordered import Ordered
from bedside.functions.quantiles import with_quantiles
from bedside.operators import temporal
from bedside.operators.resp import device_rank, pf_ratio
from bedside.sources.tables import materialise

BLOCK = "encounter_block"
# Dose unit spellings, applied in this order after blanks are removed and
# the text is lower-cased.
UNIT_PATTERNS = [
    (r"/h(r|our)?$", "/hr"),
    (r"/m(in|inute)?$", "/min"),
    (r"u(nits|nit)?", "u"),
    (r"milli-?", "m"),
    (r"l(iters|itres|itre|iter)?", "l"),
    (r"^(u|µ|μ)g", "mcg"),
    (r"^g(rams|ram)?", "g"),
]
# Mass rates as they are written without blanks; the patterns leave them as they are.
MASS_RATES = [f"{m}{per}/{t}" for m in ("mcg", "mg", "g", "ng") for per in ("", "/kg", "/lb") for t in ("hr", "min")]
LB_PER_KG = 2.20462
# Norepinephrine equivalents.
NEE_WEIGHTS = {"norepinephrine": 1.0, "epinephrine": 1.0, "phenylephrine": 0.1, "dopamine": 0.01,
               "vasopressin": 2.5, "angiotensin": 10.0}
# Which extreme is worse.
WORST_HIGH = ["creatinine", "bilirubin_total", "norepinephrine", "epinephrine", "dopamine", "dobutamine"]
WORST_LOW = ["platelet_count", "po2_arterial", "map", "spo2", "gcs_total"]
SUBSCORES = ["sofa_cv_97", "sofa_coag", "sofa_liver", "sofa_resp", "sofa_cns", "sofa_renal"]
# Limits of the inputs.
INPUT_LIMITS = {"po2_arterial": (0.0, 700.0), "fio2_set": (0.21, 1.0), "spo2": (50.0, 100.0)}

# ICD-10 code beginnings (dots removed) of the 17 Charlson conditions, Quan et al.
# 2005, and the 2011 weights.
CHARLSON = {
    "myocardial_infarction": (0, "I21 I22 I252"),
    "congestive_heart_failure": (2, "I099 I110 I130 I132 I255 I420 I425 I426 I427 I428 I429 I43 I50 P290"),
    "peripheral_vascular_disease": (0, "I70 I71 I731 I738 I739 I771 I790 I792 K551 K558 K559 Z958 Z959"),
    "cerebrovascular_disease": (0, "G45 G46 H340 I60 I61 I62 I63 I64 I65 I66 I67 I68 I69"),
    "dementia": (2, "F00 F01 F02 F03 F051 G30 G311"),
    "chronic_pulmonary_disease": (1, "I278 I279 J40 J41 J42 J43 J44 J45 J46 J47 J60 J61 J62 J63 J64 J65 J66 J67 J684 J701 J703"),
    "connective_tissue_disease": (1, "M05 M06 M315 M32 M33 M34 M351 M353 M360"),
    "peptic_ulcer_disease": (0, "K25 K26 K27 K28"),
    "mild_liver_disease": (2, "B18 K700 K701 K702 K703 K709 K713 K714 K715 K717 K73 K74 K760 K762 K763 K764 K768 K769 Z944"),
    "diabetes_uncomplicated": (0, "E100 E101 E106 E108 E109 E110 E111 E116 E118 E119 E120 E121 E126 E128 E129 E130 E131 "
                                  "E136 E138 E139 E140 E141 E146 E148 E149"),
    "diabetes_with_complications": (1, "E102 E103 E104 E105 E107 E112 E113 E114 E115 E117 E122 E123 E124 E125 E127 E132 "
                                       "E133 E134 E135 E137 E142 E143 E144 E145 E147"),
    "hemiplegia": (2, "G041 G114 G801 G802 G81 G82 G830 G831 G832 G833 G834 G839"),
    "renal_disease": (1, "I120 I131 N032 N033 N034 N035 N036 N037 N052 N053 N054 N055 N056 N057 N18 N19 N250 Z490 Z491 "
                         "Z492 Z940 Z992"),
    "cancer": (2, "C0 C1 C20 C21 C22 C23 C24 C25 C26 C30 C31 C32 C33 C34 C37 C38 C39 C40 C41 C43 C45 C46 C47 C48 C49 C50 "
                  "C51 C52 C53 C54 C55 C56 C57 C58 C6 C70 C71 C72 C73 C74 C75 C76 C81 C82 C83 C84 C85 C88 C90 C91 C92 C93 "
                  "C94 C95 C96 C97"),
    "moderate_severe_liver_disease": (4, "I850 I859 I864 I982 K704 K711 K721 K729 K765 K766 K767"),
    "metastatic_cancer": (6, "C77 C78 C79 C80"),
    "aids": (4, "B20 B21 B22 B24"),
}
# The milder condition does not count beside the severer one.
HIERARCHY = {"diabetes_uncomplicated": "diabetes_with_complications", "mild_liver_disease": "moderate_severe_liver_disease",
             "cancer": "metastatic_cancer"}


def score_cohort(first_icu: DataFrame, hours: float = 24, block: str = BLOCK) -> DataFrame:
    """Window of the score: first ICU entry plus 24 h."""
    return first_icu.where("first_icu_in_dttm is not null").select(
        block, F.col("first_icu_in_dttm").alias("start_dttm"),
        F.timestamp_micros(F.unix_micros("first_icu_in_dttm") + F.lit(int(hours * 3_600_000_000))).alias("end_dttm"))


def windowed_values(df: DataFrame, cohort: DataFrame, ts: str, category: str, wanted: list[str],
                    keys: list[str] | None = None) -> DataFrame:
    """Rows of the wanted categories inside the score window."""
    return temporal.interval_join(df.where(F.col(category).isin(wanted)), cohort, keys or [BLOCK], ts, "start_dttm", "end_dttm")


def clean_unit(unit: str) -> Column:
    c = F.lower(F.regexp_replace(F.col(unit), r"\s+", ""))
    for pattern, plain in UNIT_PATTERNS:
        c = F.regexp_replace(c, pattern, plain)
    return F.when(F.col(unit).isin(MASS_RATES), F.col(unit)).otherwise(c)


def _convert(dose, unit, weight) -> Column:
    d = (F.when(unit.startswith("mg"), dose * 1000).when(unit.startswith("g/"), dose * 1_000_000)
         .when(unit.startswith("ng"), dose / 1000).otherwise(dose))
    d = F.when(unit.endswith("/hr"), d / 60).otherwise(d)
    return F.when(unit.contains("/kg"), d).when(unit.contains("/lb"), d * LB_PER_KG).otherwise(F.when(weight > 0, d / weight))


def convert_doses(meds: DataFrame, weights: DataFrame, keys: list[str] | None = None, ts: str = "admin_dttm",
                  weight_ts: str = "recorded_dttm") -> DataFrame:
    """Doses in mcg/kg/min with the latest weight at the time of the dose."""
    w = weights.select(*(keys or [BLOCK]), F.col(weight_ts).alias("_w_ts"), "weight_kg")
    j = temporal.asof_join(meds, w, keys or [BLOCK], ts, "_w_ts", ["weight_kg"]).drop("matched_ts")
    u = clean_unit("med_dose_unit")
    # a missing unit converts as if it were an absolute dose
    return j.withColumn("dose_unit_clean", u).withColumn(
        "dose_mcg_kg_min", _convert(F.col("med_dose"), F.coalesce(F.col("dose_unit_clean"), F.lit("")), F.col("weight_kg")))


def to_preferred_unit(converted: DataFrame, drugs: list[str]) -> DataFrame:
    """Preferred-unit dose with a status; anything not convertible keeps its dose and a
    status other than success."""
    u = F.col("dose_unit_clean")
    mass = u.isin(MASS_RATES)
    absolute = ~(u.contains("/kg/") | u.contains("/lb/"))
    status = (F.when(~F.col("med_category").isin(drugs), "not_requested").when(F.col("med_dose").isNull(), "missing_dose")
              .when(u.isNull() | (u == ""), "missing_unit").when(~mass, "unrecognized_unit")
              .when(absolute & ~F.coalesce(F.col("weight_kg") > 0, F.lit(False)), "missing_weight").otherwise("success"))
    return converted.withColumn("convert_status", status).withColumn(
        "dose_converted", F.when(F.col("convert_status") == "success", F.col("dose_mcg_kg_min")).otherwise(F.col("med_dose")))


def conversion_counts(converted: DataFrame) -> DataFrame:
    return converted.groupBy("med_category", F.col("dose_unit_clean").alias("unit"), "convert_status").agg(
        F.count(F.lit(1)).alias("n"))


def limit_inputs(long: DataFrame, category: str = "category", value: str = "value") -> DataFrame:
    """Score inputs outside their limits become null."""
    v = F.col(value)
    keep = F.when(F.col(category) == "po2_arterial", v.between(*INPUT_LIMITS["po2_arterial"])).when(
        F.col(category) == "fio2_set", v.between(*INPUT_LIMITS["fio2_set"])).when(
        F.col(category) == "spo2", v.between(*INPUT_LIMITS["spo2"])).otherwise(True)
    return long.withColumn(value, F.when(keep, v))


def worst_values(long: DataFrame, keys: list[str] | None = None, category: str = "category", value: str = "value") -> DataFrame:
    """Worst value per encounter and category, long to wide in one aggregate."""
    pick = lambda f, c: f(F.when(F.col(category) == c, F.col(value))).alias(c)
    return long.groupBy(*(keys or [BLOCK])).agg(*[pick(F.max, c) for c in WORST_HIGH], *[pick(F.min, c) for c in WORST_LOW])


def pao2_from_spo2(spo2: str) -> Column:
    """Oxygen tension from saturation (Severinghaus); only below 97 %."""
    x = F.lit(11700.0) / (F.lit(100.0) / F.col(spo2) - 1)
    root = F.sqrt(x * x + 125000.0)
    return F.when(F.col(spo2) < 97, F.cbrt(root + x) - F.cbrt(root - x))


def worst_ratio(pf: DataFrame, ts: str, keys: list[str] | None = None, tie: str = "event_id") -> DataFrame:
    """Lowest concurrent P/F with its device and rank; extreme PO2 and FiO2 for reference."""
    key = F.struct("concurrent_pf", ts, tie)
    d = pf.groupBy(*(keys or [BLOCK])).agg(F.min("concurrent_pf").alias("p_f"), F.min("po2_arterial").alias("po2_at_ratio"),
                                           F.max("fio2_set").alias("fio2_set"), F.min_by("device_category", key).alias("device_category"))
    return d.withColumn("device_rank", device_rank("device_category"))


def sofa_scores(worst: DataFrame, fill_missing: bool = False) -> DataFrame:
    """Six component scores and their sum. Missing inputs leave a component null (or 0 with
    ``fill_missing``); nulls do not count in the sum."""
    c = lambda n: F.col(n)
    ladder = lambda col, cuts: _ladder(c(col), cuts)
    vent = F.lower("device_category").isin("imv", "nippv", "cpap")
    dop, epi, nor, dob = (c(x) for x in ("dopamine", "epinephrine", "norepinephrine", "dobutamine"))
    s = {
        "sofa_cv_97": F.when((dop > 15) | (epi > 0.1) | (nor > 0.1), 4).when((dop > 5) | (epi <= 0.1) | (nor <= 0.1), 3)
        .when((dop <= 5) | (dob > 0), 2).when(c("map") < 70, 1).when(c("map") >= 70, 0),
        "sofa_coag": F.when(c("platelet_count") < 20, 4).when(c("platelet_count") < 50, 3).when(c("platelet_count") < 100, 2)
        .when(c("platelet_count") < 150, 1).when(c("platelet_count") >= 150, 0),
        "sofa_liver": ladder("bilirubin_total", [(12, 4), (6, 3), (2, 2), (1.2, 1)]),
        "sofa_resp": F.when((c("p_f") < 100) & vent, 4).when((c("p_f") >= 100) & (c("p_f") < 200) & vent, 3)
        .when((c("p_f") >= 200) & (c("p_f") < 300), 2).when((c("p_f") >= 300) & (c("p_f") < 400), 1).when(c("p_f") >= 400, 0),
        "sofa_cns": F.when(c("gcs_total") < 6, 4).when(c("gcs_total").between(6, 9), 3).when(c("gcs_total").between(10, 12), 2)
        .when(c("gcs_total").between(13, 14), 1).when(c("gcs_total") == 15, 0),
        "sofa_renal": ladder("creatinine", [(5, 4), (3.5, 3), (2, 2), (1.2, 1)]),
    }
    out = worst.withColumns(s)
    if fill_missing:
        out = out.fillna(0, SUBSCORES)
    total = F.lit(0)
    for x in SUBSCORES:
        total = total + F.coalesce(F.col(x), F.lit(0))
    return out.withColumn("sofa_total", total)


def _ladder(col, cuts):
    out = F.when(col >= cuts[0][0], cuts[0][1])
    for low, score in cuts[1:]:
        out = out.when(col >= low, score)
    return out.when(col < cuts[-1][0], 0)


def sofa(labs: DataFrame, vitals: DataFrame, assessments: DataFrame, meds: DataFrame, weights: DataFrame, resp: DataFrame,
         cohort: DataFrame, fill_missing: bool = True) -> DataFrame:
    """The whole score: windowed worst values, converted doses and worst concurrent P/F.
    Inputs are long (encounter, event_id, recorded_dttm, category, value); ``resp`` is filled. Drugs
    and windows are filtered before anything is ordered; FiO2 counts from inside the window only, to
    which ``resp.windowed_fio2`` carries earlier settings. ``p_f_imputed`` is the imputed oxygen tension
    over the highest FiO2 of the pairs."""
    rows = labs.unionByName(vitals).unionByName(assessments)
    long = windowed_values(rows, cohort, "recorded_dttm", "category", WORST_HIGH + WORST_LOW).select(BLOCK, "category", "value")
    dose = windowed_values(meds, cohort, "admin_dttm", "med_category", ["norepinephrine", "epinephrine", "dopamine", "dobutamine"])
    dose = convert_doses(dose, weights.join(cohort.select(BLOCK).distinct(), BLOCK, "left_semi"))
    inside = temporal.interval_join(resp, cohort.select(BLOCK, "start_dttm", "end_dttm"), [BLOCK], "recorded_dttm", "start_dttm", "end_dttm")
    long = long.unionByName(dose.select(BLOCK, F.col("med_category").alias("category"), F.col("dose_mcg_kg_min").alias("value")))
    worst = worst_values(limit_inputs(long))
    po2 = windowed_values(labs, cohort, "recorded_dttm", "category", ["po2_arterial"]).where("value is not null").select(
        BLOCK, "event_id", "recorded_dttm", F.col("value").alias("po2_arterial"))
    ratio = worst_ratio(pf_ratio(po2, inside, [BLOCK], "recorded_dttm"), "recorded_dttm").drop("po2_at_ratio")
    joined = worst.withColumn("pao2_imputed", pao2_from_spo2("spo2")).join(ratio, BLOCK, "left")
    return sofa_scores(joined.withColumn("p_f_imputed", F.try_divide("pao2_imputed", "fio2_set")), fill_missing)


def sofa_mortality(df: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Mortality by total score with the Wilson margin around the observed rate."""
    keys = keys or []
    d = df.where("sofa_total is not null")
    n, k = F.col("n_encounters"), F.col("n_deaths")
    g = d.groupBy(*keys, F.col("sofa_total").alias("sofa_score")).agg(F.count("death_enc").alias("n_encounters"),
                                                                      F.sum("death_enc").alias("n_deaths"))
    t = g.groupBy(*keys).agg(F.sum("n_encounters").alias("total_encounters"))
    g = g.join(t, keys) if keys else attach(g, t)
    p, z2 = k / n, Z95 * Z95
    margin = F.lit(Z95) * F.sqrt((p * (1 - p) + F.lit(z2) / (4 * n)) / n) / (1 + F.lit(z2) / n) * 100
    r2 = lambda c: F.bround(c, 2)
    return g.withColumns({"mortality_rate_percent": r2(p * 100), "ci_lower_95": r2(F.greatest(p * 100 - margin, F.lit(0.0))),
                          "ci_upper_95": r2(F.least(p * 100 + margin, F.lit(100.0))), "ci_margin_95": r2(margin)})


def charlson_table(spark: SparkSession, length: int) -> DataFrame:
    """(prefix, bits of its conditions in the order of ``CHARLSON``) of the prefixes of this length, as an inline table: its size is
    known when the join is planned, so codes are not shuffled by their few prefixes."""
    bits: dict[str, int] = {}
    for i, (_, text) in enumerate(CHARLSON.values()):
        for p in text.split():
            if len(p) == length:
                bits[p] = bits.get(p, 0) | 1 << i
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{p}', {b}L)" for p, b in bits.items()) + f" AS t(_p{length}, _b{length})")


def _is_ten(code_format: str) -> Column:
    """ICD-10-CM by its letters and digits, however it is written; the usual spellings need no pattern."""
    c = F.col(code_format)
    plain = F.regexp_replace(F.lower(c), "[^a-z0-9]", "").isin("icd10cm", "icd10")
    return F.when(c.isin("ICD10CM", "icd10cm", "ICD10", "icd10"), True).when(c.isin("ICD9CM", "icd9cm", "ICD9", "icd9"), False).otherwise(plain)


def charlson(dx: DataFrame, keys: list[str], hierarchy: bool = True, weights: dict[str, int] | None = None) -> DataFrame:
    """17 condition flags and the weighted index per key, ICD-10-CM rows only. Each code
    meets the short prefix tables by equality on its first two, three and four characters, one row all the way; conditions
    travel as bits of one number, combined per key before the shuffle. A null key has no conditions."""
    weights = weights or {n: w for n, (w, _) in CHARLSON.items()}
    code = F.upper(F.translate("diagnosis_code", ".", ""))
    hit, bits = dx.where(_is_ten("diagnosis_code_format")).select(*keys, code.alias("_code")), F.lit(0).cast("long")
    for n in sorted({len(p) for _, text in CHARLSON.values() for p in text.split()}):
        hit = hit.withColumn(f"_p{n}", F.substring("_code", 1, n)).join(charlson_table(dx.sparkSession, n), f"_p{n}", "left")
        bits = bits.bitwiseOR(F.coalesce(F.col(f"_b{n}"), F.lit(0).cast("long")))
    bits = hit.groupBy(*keys).agg(F.bit_or(bits).alias("_bits"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    has = lambda i: flag(known & (F.col("_bits").bitwiseAND(F.lit(1 << i)) != 0))
    out = bits.select(*keys, *[has(i).alias(n) for i, n in enumerate(CHARLSON)])
    if hierarchy:
        out = out.withColumns({m: flag((F.col(m) == 1) & (F.col(s) == 0)) for m, s in HIERARCHY.items()})
    score = F.lit(0)
    for n, w in weights.items():
        score = score + F.col(n) * w
    return out.withColumn("cci_score", score)


def charlson_per_encounter(cci: DataFrame, mapping: DataFrame, hosp_id: str = "hospitalization_id", block: str = BLOCK) -> DataFrame:
    """Highest flag and score over the hospitalizations of an encounter."""
    cols = [*CHARLSON, "cci_score"]
    return cci.join(mapping.select(hosp_id, block), hosp_id).groupBy(block).agg(*[F.max(c).alias(c) for c in cols])


def cci_category(score: str) -> Column:
    s = F.col(score)
    return (F.when(s <= 0, "0 (No comorbidity)").when(s <= 2, "1-2 (Mild)").when(s <= 4, "3-4 (Moderate)")
            .when(s > 4, "5+ (Severe)"))


def antimicrobial_runs(doses: DataFrame, key: str, day: str, drug: str) -> DataFrame:
    """Antimicrobial day runs per encounter: days with any dose, at most one day without in
    between, with the number of dose days of the run."""
    days = doses.groupBy(key, F.col(day).alias("_d")).agg(F.count(drug).alias("_n"))
    ts = F.col("_d").cast("timestamp")
    d = days.withColumn("_t", ts)
    d = materialise(Ordered(d, [key], ["_t"]).lag("_p", "_d").apply(), "dose-days")
    fresh = flag(F.col("_p").isNull() | (F.datediff("_d", "_p") > 2)).cast("long")
    d = Ordered(d.withColumn("_f", fresh), [key], ["_t"]).cumsum("_run", "_f").apply()
    return d.groupBy(key, "_run").agg(F.min("_d").alias("run_start"), F.max("_d").alias("run_end"), F.count(F.lit(1)).alias("days"))


def adult_sepsis_events(cultures: DataFrame, doses: DataFrame, dysfunction: DataFrame, key: str = "hospitalization_id",
                        window_days: int = 2, min_days: int = 4) -> DataFrame:
    """Published adult sepsis event rule on calendar days: a blood culture with a run of at
    least four antimicrobial days that begins within two days of it, and organ dysfunction
    within two days. One row per culture day (``culture_day``, ``dose_day``,
    ``dysfunction_day`` columns); ``episode_id`` numbers the sepsis days of an encounter."""
    c = cultures.select(key, F.col("culture_day")).distinct()
    runs = antimicrobial_runs(doses, key, "dose_day", "drug").where(F.col("days") >= min_days)
    near = lambda col: F.explode(F.array(*[F.date_add(col, i) for i in range(-window_days, window_days + 1)]))
    infected = runs.select(key, near(F.col("run_start")).alias("culture_day")).distinct().withColumn("_inf", F.lit(1))
    failing = dysfunction.select(key, near(F.col("dysfunction_day")).alias("culture_day")).distinct().withColumn("_dys", F.lit(1))
    out = c.join(infected, [key, "culture_day"], "left").join(failing, [key, "culture_day"], "left")
    out = out.select(key, "culture_day", flag((F.col("_inf") == 1) & (F.col("_dys") == 1)).alias("sepsis"))
    out = materialise(out.withColumn("_t", F.col("culture_day").cast("timestamp")), "culture-days")
    out = Ordered(out, [key], ["_t"]).cumsum("_k", F.col("sepsis").cast("long")).apply().drop("_t")
    return out.withColumn("episode_id", F.when(F.col("sepsis") == 1, F.col("_k"))).drop("_k")


def sepsis_counts(events: DataFrame, mapping: DataFrame, hosp_id: str = "hospitalization_id", block: str = BLOCK) -> DataFrame:
    """Sepsis events per encounter counted by flag and by episode id; 0 when none."""
    per = events.where("sepsis = 1").join(mapping.select(hosp_id, block), hosp_id).groupBy(block).agg(
        F.count(F.lit(1)).alias("sepsis_events_by_sepsis_col"), F.count("episode_id").alias("sepsis_events_by_episode_id"))
    return mapping.select(block).distinct().join(per, block, "left").fillna(0)


def sepsis_incidence(enc: DataFrame, groups: dict[str, str | None], value: str = "sepsis_events_by_sepsis_col") -> DataFrame:
    """Encounters with sepsis and incidence (percent) per flag group; None means all."""
    rows, aggs = [], []
    for i, (g, c) in enumerate(groups.items()):
        inside = F.lit(True) if c is None else F.col(c) == 1
        aggs += [F.count(F.when(inside, 1)).alias(f"n{i}"), F.count(F.when(inside & (F.col(value) > 0), 1)).alias(f"k{i}")]
        rows.append(F.struct(F.lit(g).alias("group"), F.col(f"n{i}").alias("n_encounters"), F.col(f"k{i}").alias("n_sepsis"),
                             F.bround(pct(F.col(f"k{i}"), F.col(f"n{i}")), 1).alias("incidence_pct")))
    return enc.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def norepinephrine_equivalent(doses: DataFrame, block: str = BLOCK, ts: str = "admin_dttm", dose: str = "med_dose") -> DataFrame:
    """Weighted doses summed per hour, then peak and median hour per encounter."""
    hourly = (doses.withColumn("_w", F.coalesce(lookup("med_category", NEE_WEIGHTS), F.lit(0.0)) * F.col(dose))
              .groupBy(block, F.date_trunc("hour", F.col(ts)).alias("hour")).agg(F.coalesce(F.sum("_w"), F.lit(0.0)).alias("nee")))
    return with_quantiles(hourly, [block], [F.max("nee").alias("nee_peak")], {"nee": {"nee_median": 0.5}})


def exposure_flags(enc: DataFrame, sources: dict[str, DataFrame | None], block: str = BLOCK) -> DataFrame:
    """0/1 per encounter for each source table; an absent table leaves its flag out."""
    for name, rows in sources.items():
        if rows is not None:
            hit = rows.select(block).distinct().withColumn(name, F.lit(1))
            enc = enc.join(hit, block, "left").fillna(0, [name])
    return enc
