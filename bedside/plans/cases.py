"""Encounters with all their sources, and every Table One feature of them.

A case is the series of a user in a stretch of four days: stays, respiratory rows, drugs, labs and
diagnoses of one encounter share its key. The SQL names its views like those of ``views``, so that the
SQL of single features is used as it stands.
"""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from bedside.functions.expr import days_between, flag, micros
from bedside.operators import cohort as H
from bedside.operators import journey as J
from bedside.operators import meds as M
from bedside.operators import report as T
from bedside.operators import resp as R
from bedside.operators import severity as S
from bedside.operators import temporal
from bedside.operators.assemble import assemble, together
from bedside.plans import views as V
from bedside.plans.on_cohort import FLAGS
from bedside.plans.on_resp import INF, TUBE
from bedside.plans.on_severity import ASE, CCI, DOSE, INPUT, SCORES, cci, inputs_of
from bedside.sources.tables import cached_table, materialise

BLOCK = "encounter_block"
ORDER = ["recorded_dttm", "event_id"]
SEDATION = [*T.SEDATIVES, *T.BLOCKERS]
DRUGS = [*T.VASOPRESSORS, *SEDATION]
TARGET = T.VASOPRESSORS
DAY = 86_400_000_000


def obs(spark, sf):
    day = F.floor(F.dayofmonth("recorded_dttm") / 4)
    years = F.timestamp_micros(F.unix_micros("recorded_dttm") + F.col(BLOCK) % 3 * F.lit(366 * DAY))
    return V.obs(spark, sf).withColumns({"recorded_dttm": years, BLOCK: F.col(BLOCK) * 8 + day})


def features(spark, sf):
    """One row per case with every column of Table One and of the stratum lines."""
    o = materialise(obs(spark, sf), "cases")
    last = F.coalesce("out_dttm", F.timestamp_micros(micros("in_dttm") + F.lit(3_600_000_000)))
    event = F.col("event_id")
    med = F.element_at(F.array(*[F.lit(d) for d in DRUGS]), (event % len(DRUGS) + 1).cast("int"))
    drugs = V.meds_of(o, med)
    weights = o.where("category = 'click'").select(BLOCK, "recorded_dttm", (40 + F.col("setting")).alias("weight_kg"))
    day, hosp = F.to_date("recorded_dttm"), o.withColumn("hospitalization_id", F.col(BLOCK))

    def stays():
        return materialise(V.stay_of(o).withColumns({"out_dttm": last, "hospitalization_id": event, "discharge_category": F.when(
            event % 41 == 0, "Expired").when(event % 41 == 1, "Hospice").otherwise("Home")}), "stays")

    def devices():
        on = (F.floor((F.floor(micros("recorded_dttm") / 3_600_000_000) + F.col(BLOCK) * 17) / 40) % 3 == 1) & (F.col("peep_set") > 4)
        device = F.when(on, "imv").when(F.col("device_category") == "imv", "room air").otherwise(F.coalesce("device_category", F.lit("room air")))
        return materialise(V.resp_of(o).withColumn("device_category", device), "devices")

    # what starts from the events alone; then what starts from stays and devices; then what needs their spans
    have = together(spark, {
        "adt": stays, "resp": devices,
        "doses": lambda: materialise(S.to_preferred_unit(S.convert_doses(drugs, weights), TARGET), "doses"),
        "cci": lambda: materialise(cci(spark, sf), "conditions"),
        "sepsis": lambda: materialise(S.adult_sepsis_events(
            hosp.where("category = 'purchase'").withColumn("culture_day", day),
            hosp.where("category in ('view', 'click')").withColumns({"dose_day": day, "drug": F.col("category")}),
            hosp.where("category = 'error' and value > 60").withColumn("dysfunction_day", day)), "sepsis-days")})
    adt, resp, dosed = have["adt"], have["resp"], have["doses"]
    stay = J.hospital_stay(adt, tie="event_id")
    icu = J.first_icu_stay(adt)
    vent = R.vent_span(resp)

    def spans():
        flags = materialise(H.all_flags(adt, resp, drugs, drugs=["norepinephrine"]), "flags")
        return flags, materialise(stay.select(BLOCK, F.col("first_in_dttm").alias("admission_dttm"), F.col("last_out_dttm").alias("discharge_dttm"))
                                  .join(flags.select(BLOCK, "death_enc", "nippv_hfnc_enc"), BLOCK).join(vent, BLOCK)
                                  .withColumns({"vent_start_dttm": F.col("vent_start_time"), "death_dttm": F.when(F.col("death_enc") == 1, F.col("discharge_dttm"))}), "spans")

    def scores():
        window = materialise(S.score_cohort(icu), "windows")
        filled = R.windowed_fio2(resp, window, ORDER).select(BLOCK, "event_id", "recorded_dttm", "device_category", "fio2_set")
        i = inputs_of(o)
        of = lambda *c: i.where(F.col("category").isin(*c))
        return S.sofa(of("creatinine", "platelet_count", "bilirubin_total", "po2_arterial"), of("map", "spo2"), of("gcs_total"), drugs, weights, filled, window)

    have |= together(spark, {
        "spans": spans, "sofa": scores, "tube": lambda: R.tube_events(resp, ORDER),
        "pressor": lambda: H.ed_pressor_flags(adt, drugs, drugs=["norepinephrine"]),
        "episodes": lambda: J.icu_episodes(adt, ["in_dttm", "event_id"]), "hours": lambda: R.imv_hours(resp, ORDER),
        "dose": lambda: M.dose_columns(dosed, TARGET, dose="dose_converted"),
        "nee": lambda: S.norepinephrine_equivalent(dosed.where("convert_status = 'success'"), dose="dose_converted")})
    flags, enc = have["spans"]
    start = enc.where("vent_start_time is not null").select(BLOCK, F.col("vent_start_time").alias("at"))
    have |= together(spark, {
        "start": lambda: temporal.assign_location(start, adt, [BLOCK], "at"),
        "extubation": lambda: R.extubation_summary(resp, enc, ORDER, failed_minutes=300, events=have["tube"]),
        "vfd": lambda: R.ventilator_free_days(resp, enc, ORDER), "nidfd": lambda: R.noninvasive_free_days(resp, enc, ORDER)})
    sofa, sepsis, ext = have["sofa"], have["sepsis"], have["extubation"]
    to_icu = R.time_to_target(have["pressor"].join(icu, BLOCK), BLOCK)
    exposure = M.exposure_columns(drugs, DRUGS)
    onset = R.failure_onset(resp).select(BLOCK, "onset_dttm").join(enc.select(BLOCK, "admission_dttm", "discharge_dttm"), BLOCK)

    outcomes = H.outcome_flags(adt).withColumnsRenamed({"hospice": "hospice_outcome", "expired": "expired_outcome"})
    base = flags.withColumn("patient_id", F.floor(F.col(BLOCK) / 8) + 1).join(V.patient(spark, sf).drop("site", "balance"), "patient_id").withColumns({
        "hospital_id": F.col("patient_id") % 7, "age_at_admission": 18 + F.col("patient_id") % 73})
    parts = {
        "stays_": stay.join(adt.groupBy(BLOCK).agg(F.min_by("location_category", F.struct("in_dttm", "event_id")).alias("first_admission_location")), BLOCK).select(
            BLOCK, F.year("first_in_dttm").alias("admission_year"), F.col("hospital_los_days").alias("hospital_length_of_stay_days"), "first_admission_location"),
        "admission": o.groupBy(BLOCK).agg(F.min_by("category", F.struct(*ORDER)).alias("admission_type_category")),
        "outcomes": outcomes, "icu": icu.select(BLOCK, "first_icu_los_days"),
        "episodes": have["episodes"],
        "cci": S.charlson_per_encounter(have["cci"], o.select(F.col("event_id").alias("hospitalization_id"), BLOCK)).select(BLOCK, "cci_score", *S.CHARLSON),
        "sofa": sofa.select(BLOCK, "sofa_total", *S.SUBSCORES, "p_f", "p_f_imputed"),
        "sepsis": S.sepsis_counts(sepsis, hosp.select(BLOCK, "hospitalization_id").distinct()).select(BLOCK, "sepsis_events_by_sepsis_col"),
        "crrt": S.exposure_flags(o.select(BLOCK).distinct(), {"crrt_flag": o.where("category = 'click' and value > 100")}),
        "vent": vent.select(BLOCK, "on_vent"), "hours": have["hours"], "mode": R.initial_mode(resp, ORDER),
        "start": have["start"].select(BLOCK, F.col("location_category").alias("first_location_imv")),
        "extubation": ext.select(BLOCK, "time_to_extubation_hours", "extubation_status", flag(F.col("imv_episodes_n") >= 2).alias("reintubated")),
        "vfd": have["vfd"], "nidfd": have["nidfd"],
        "exposure": exposure.select(BLOCK, *[F.col(d).alias(f"{d}_flag") for d in DRUGS], F.greatest(*TARGET).alias("any_vasopressor")),
        "dose": have["dose"].select(BLOCK, *[f"{d}_median" for d in TARGET]),
        "onset": onset.select(BLOCK, F.lit(1).alias("has_onset"), days_between("admission_dttm", "onset_dttm").alias("pre_device_los_days"),
                              days_between("onset_dttm", "discharge_dttm").alias("post_device_los_days")),
        "nee": have["nee"].select(BLOCK, "nee_peak"),
        "to_icu": to_icu,
    }
    derived = ["hospice_or_expired", "any_icu_episode", "any_sepsis"]
    wanted = {c for r in [*T.table_one_rows(), *T.table_one_rows(ward=True), *T.EXTRA_ROWS] for c in (r.column, r.within) if c} - set(derived)
    out = assemble(base, parts, sorted(wanted))
    return out.withColumns({"any_icu_episode": flag(F.col("icu_episodes") >= 1), "any_sepsis": flag(F.col("sepsis_events_by_sepsis_col") >= 1),
                            "has_onset": F.coalesce("has_onset", F.lit(0))})


#: Columns of the features that are compared, and the digits of those that are no whole numbers.
COLUMNS = sorted({c for r in [*T.table_one_rows(), *T.table_one_rows(ward=True), *T.EXTRA_ROWS] for c in (r.column, r.within) if c} | set(H.STRATA.values())
                 | {"cohort_enc", "ward_enc", "admission_year", "hospice_or_expired", *S.CHARLSON})
DECIMAL = {c: 4 if c.endswith(("_days", "_hours")) else 9 for c in COLUMNS if c.endswith(("_days", "_hours", "_median", "_peak")) or c.startswith("p_f")}


def encounters(spark, sf):
    """The written features, made again only when the event, order or patient files change."""
    sources = [spark.read.parquet(f"{sf.rstrip('/')}/{t}.parquet") for t in ("events", "customer", "lineitem", "part")]
    return cached_table(spark, "case_features", "1", sources, lambda: features(spark, sf))


VIEWS = {
    "obs": """obs AS (SELECT user_id * 8 + day(ts) // 4 AS encounter_block, event_id, ts + to_days(CAST(user_id % 3 * 366 AS INTEGER)) AS recorded_dttm, event_type AS category,
      value, CAST(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS setting FROM events)""",
    "stay": """stay AS (SELECT encounter_block, event_id, recorded_dttm AS in_dttm,
      coalesce(lead(recorded_dttm) OVER (PARTITION BY encounter_block ORDER BY recorded_dttm, event_id), recorded_dttm + INTERVAL 1 HOUR) AS out_dttm,
      CASE category WHEN 'error' THEN 'icu' WHEN 'view' THEN 'ward' WHEN 'purchase' THEN 'ed' WHEN 'signup' THEN 'procedural' ELSE 'other' END AS location_category, value,
      CASE event_id % 41 WHEN 0 THEN 'Expired' WHEN 1 THEN 'Hospice' ELSE 'Home' END AS discharge_category FROM obs)""",
    "resp": V.CTE["resp"].replace("CASE category WHEN 'error' THEN 'imv' WHEN", """CASE WHEN (epoch_us(recorded_dttm) // 3600000000 + encounter_block * 17) // 40 % 3 = 1 AND setting > 4 THEN 'imv'
        WHEN category = 'error' THEN 'room air' ELSE coalesce(CASE category WHEN""").replace("END AS device_category", "END, 'room air') END AS device_category"),
    "meds": V.CTE["meds"].replace("""CASE category WHEN 'purchase' THEN 'norepinephrine' WHEN 'error' THEN 'epinephrine' WHEN 'view' THEN 'vasopressin'
        WHEN 'click' THEN 'propofol' ELSE 'dopamine' END AS m""", f"[{', '.join(repr(d) for d in DRUGS)}][event_id % {len(DRUGS)} + 1] AS m"),
    "blocks": """blocks AS (SELECT stay.encounter_block, stay.event_id AS hospitalization_id, in_dttm AS admission_dttm, out_dttm AS discharge_dttm, location_category,
      discharge_category, device_category, med_category, stay.value FROM stay JOIN resp ON resp.event_id = stay.event_id JOIN meds ON meds.event_id = stay.event_id)""",
}


def _renamed(text: str, *names: str) -> str:
    """SQL in which these views have names of their own."""
    for n in names:
        text = re.sub(rf"\b{n}\b", f"{n}_x", text)
    return text


def _free(tag: str, on: str, start: str) -> str:
    return f"""n{tag} AS (SELECT *, {on} AS o, lead({on}) OVER w AS no, lead(recorded_dttm) OVER w AS nx FROM resp WINDOW w AS (PARTITION BY encounter_block ORDER BY recorded_dttm, event_id)),
  e{tag} AS (SELECT *, {start} + INTERVAL 27 DAY AS we FROM ve WHERE {start} IS NOT NULL),
  l{tag} AS (SELECT encounter_block, max(least(coalesce(nx, ds, recorded_dttm), we)) AS l FROM n{tag} JOIN e{tag} USING (encounter_block)
    WHERE o AND NOT coalesce(no, false) AND recorded_dttm <= we GROUP BY 1),
  {tag} AS (SELECT encounter_block, CASE WHEN death = 1 AND ds <= we THEN 0 WHEN l IS NULL THEN 28 WHEN l >= we THEN 0
    ELSE date_diff('day', CAST(l AS DATE), CAST(we AS DATE)) END AS {tag}_28 FROM e{tag} LEFT JOIN l{tag} USING (encounter_block))"""


_NAMES = ", ".join(f"'{d}'" for d in TARGET)
_WORST = ", ".join([f"max(value) FILTER (category = '{c}') AS {c}" for c in S.WORST_HIGH] + [f"min(value) FILTER (category = '{c}') AS {c}" for c in S.WORST_LOW])
_FLOW = "(device_category = 'high flow nc' AND lpm_set >= 30)"
FEATURES = ", ".join([
    FLAGS,
    """st_ AS (SELECT encounter_block, min(in_dttm) AS ad, max(out_dttm) AS ds, arg_min(location_category, in_dttm) AS first_admission_location,
    max(CASE WHEN discharge_category = 'Expired' THEN 1 ELSE 0 END) AS expired_outcome, max(CASE WHEN discharge_category = 'Hospice' THEN 1 ELSE 0 END) AS hospice_outcome FROM stay GROUP BY 1)""",
    "ty AS (SELECT encounter_block, arg_min(category, recorded_dttm) AS admission_type_category FROM obs GROUP BY 1)",
    """ic AS (SELECT encounter_block, min(in_dttm) AS i, (epoch_us(arg_min(out_dttm, in_dttm)) - epoch_us(min(in_dttm))) / 86400000000.0::DOUBLE AS first_icu_los_days FROM stay
    WHERE location_category = 'icu' GROUP BY 1)""",
    """tr AS (SELECT *, sum(CASE WHEN location_category IN ('ward', 'other') THEN 1 ELSE 0 END) OVER (PARTITION BY encounter_block ORDER BY in_dttm, event_id) AS cs FROM stay),
  ie AS (SELECT encounter_block, count(DISTINCT cs) AS icu_episodes FROM tr WHERE location_category = 'icu' GROUP BY 1)""",
    CCI, "ec AS (SELECT encounter_block, " + ", ".join(f"max({c}) AS {c}" for c in ("cci_score", *S.CHARLSON)) + " FROM cci JOIN obs ON event_id = hospitalization_id GROUP BY 1)",
    INPUT, DOSE.replace("('norepinephrine', 'epinephrine', 'dopamine')", f"({_NAMES})"),
    "coh AS (SELECT encounter_block, min(in_dttm) AS s, min(in_dttm) + INTERVAL 24 HOUR AS e FROM stay WHERE location_category = 'icu' GROUP BY 1)",
    f"""lg_ AS (SELECT r.encounter_block, category, value FROM lim r JOIN coh ON r.encounter_block = coh.encounter_block AND recorded_dttm BETWEEN s AND e
      AND category NOT IN ('norepinephrine', 'dopamine', 'dobutamine')
    UNION ALL SELECT cv.encounter_block, med_category, d FROM cv JOIN coh ON cv.encounter_block = coh.encounter_block AND admin_dttm BETWEEN s AND e
      AND med_category IN ('norepinephrine', 'epinephrine', 'dopamine', 'dobutamine')),
  w2 AS (SELECT encounter_block, {_WORST} FROM lg_ GROUP BY 1)""",
    "wsrc AS (SELECT r.*, s FROM resp r JOIN coh USING (encounter_block) WHERE recorded_dttm BETWEEN s - INTERVAL 24 HOUR AND e)",
    _renamed(INF.format(src="wsrc", key="encounter_block"), "ff").replace("CASE WHEN fio2_set IS NULL AND device_category = 'nasal cannula'",
        "CASE WHEN fio2_set IS NULL AND device_category = 'room air' THEN 0.21::DOUBLE WHEN fio2_set IS NULL AND device_category = 'nasal cannula'"),
    """rr AS (SELECT encounter_block, recorded_dttm AS rt, fio2 AS fio2_set, dev AS device_category FROM wf WHERE recorded_dttm >= s),
  pl AS (SELECT i.* FROM inp i JOIN coh ON i.encounter_block = coh.encounter_block AND recorded_dttm BETWEEN s AND e WHERE category = 'po2_arterial'),
  prs AS (SELECT pl.encounter_block, pl.event_id, pl.recorded_dttm, value / fio2_set AS ratio, fio2_set, device_category FROM pl ASOF JOIN rr ON pl.encounter_block = rr.encounter_block
    AND pl.recorded_dttm >= rt WHERE epoch_us(pl.recorded_dttm) - epoch_us(rt) <= 14400000000 AND fio2_set > 0),
  p1 AS (SELECT encounter_block, min(ratio) AS p_f, max(fio2_set) AS mf, arg_min(device_category, (ratio, recorded_dttm, event_id)) AS device_category FROM prs GROUP BY 1),
  sr AS (SELECT w2.*, p_f, device_category, mf, CASE WHEN spo2 < 97 THEN 11700.0::DOUBLE / (100.0::DOUBLE / spo2 - 1) END AS x FROM w2 LEFT JOIN p1 USING (encounter_block))""",
    f"""sx AS (SELECT encounter_block, p_f, (pow(sqrt(x * x + 125000) + x, 1.0::DOUBLE / 3) - pow(sqrt(x * x + 125000) - x, 1.0::DOUBLE / 3)) / mf AS p_f_imputed, {SCORES} FROM sr),
  so AS (SELECT * REPLACE ({", ".join(f"coalesce({c}, 0) AS {c}" for c in S.SUBSCORES)}), {" + ".join(f"coalesce({c}, 0)" for c in S.SUBSCORES)} AS sofa_total FROM sx)""",
    ASE, "en_ AS (SELECT encounter_block, count(*) FILTER (sepsis = 1) AS n FROM ase2 GROUP BY 1)",
    "cr AS (SELECT DISTINCT encounter_block FROM obs WHERE category = 'click' AND value > 100)",
    f"""ve AS (SELECT encounter_block, min(recorded_dttm) FILTER (device_category = 'imv') AS vs, min(recorded_dttm) FILTER (device_category = 'nippv' OR {_FLOW}) AS ni,
    any_value(ad) AS ad, any_value(ds) AS ds, any_value(death_enc) AS death, any_value(nippv_hfnc_enc) AS nh FROM resp JOIN st_ USING (encounter_block) JOIN flags USING (encounter_block) GROUP BY 1),
  hr AS (SELECT encounter_block, coalesce(sum((epoch_us(n) - epoch_us(recorded_dttm)) / 3600000000.0::DOUBLE) FILTER (device_category = 'imv'), 0) AS vent_duration_hours
    FROM (SELECT *, lead(recorded_dttm) OVER (PARTITION BY encounter_block ORDER BY recorded_dttm, event_id) AS n FROM resp) GROUP BY 1 HAVING count(*) FILTER (device_category = 'imv') > 0),
  im AS (SELECT r.encounter_block, coalesce(first(mode_category ORDER BY recorded_dttm, event_id) FILTER (mode_category IS NOT NULL), 'Missing') AS initial_mode_category
    FROM resp r JOIN ve USING (encounter_block) WHERE recorded_dttm >= vs GROUP BY 1),
  lo AS (SELECT ve.encounter_block, location_category AS first_location_imv FROM ve JOIN stay ON stay.encounter_block = ve.encounter_block AND in_dttm <= vs AND vs < out_dttm)""",
    _renamed(TUBE[TUBE.index("tl AS"):].replace("FROM td", "FROM resp").replace("< 1500", "< 300"), "st", "en"),
    """pe AS (SELECT encounter_block, max(s) FILTER (k = 1) AS s1, max(e) FILTER (k = 1) AS e1, count(*) FILTER (k > 0) AS n, max(CAST(failed AS INTEGER)) AS fl FROM ep GROUP BY 1),
  xt AS (SELECT fr.encounter_block, CASE WHEN NOT fi THEN (epoch_us(e1) - epoch_us(s1)) / 3600000000.0::DOUBLE END AS time_to_extubation_hours, CASE WHEN n >= 2 THEN 1 ELSE 0 END AS reintubated,
    CASE WHEN coalesce(n, 0) = 0 AND fl = 1 THEN 'failed_attempt' WHEN e1 IS NOT NULL THEN 'extubated' WHEN death_enc = 1 THEN 'death_on_imv' ELSE 'discharged_on_imv' END AS extubation_status
    FROM fr LEFT JOIN pe USING (encounter_block) JOIN flags USING (encounter_block))""",
    _free("vfd", "device_category = 'imv'", "vs"), _free("nidfd", f"(device_category = 'nippv' OR {_FLOW})", "CASE WHEN nh = 1 THEN ni END"),
    "ex AS (SELECT encounter_block, " + ", ".join(f"max(CASE WHEN med_category = '{d}' THEN 1 ELSE 0 END) AS {d}_flag" for d in DRUGS)
    + f", max(CASE WHEN med_category IN ({_NAMES}) THEN 1 ELSE 0 END) AS any_vasopressor FROM meds GROUP BY 1)",
    "dm AS (SELECT encounter_block, " + ", ".join(f"quantile_cont(d, 0.5) FILTER (med_category = '{d}') AS {d}_median" for d in TARGET) + " FROM st WHERE status = 'success' GROUP BY 1)",
    f"""oo AS (SELECT encounter_block, min(recorded_dttm) AS os FROM resp WHERE device_category IN ('imv', 'nippv') OR {_FLOW} GROUP BY 1),
  ne AS (SELECT encounter_block, max(v) AS nee_peak FROM (SELECT encounter_block, date_trunc('hour', admin_dttm) AS h, sum(d * CASE med_category WHEN 'norepinephrine' THEN 1.0::DOUBLE
    WHEN 'epinephrine' THEN 1.0::DOUBLE WHEN 'phenylephrine' THEN 0.1::DOUBLE WHEN 'dopamine' THEN 0.01::DOUBLE WHEN 'vasopressin' THEN 2.5::DOUBLE END) AS v
    FROM st WHERE status = 'success' GROUP BY ALL) GROUP BY 1),
  ti AS (SELECT encounter_block, (epoch_us(i) - epoch_us(pt)) / 3600000000.0::DOUBLE AS time_to_icu_hours FROM ed2 JOIN ic USING (encounter_block) WHERE li = 1)""",
    f"""encs AS (SELECT flags.*, patient_id, race_category, ethnicity_category, sex_category, patient_id % 7 AS hospital_id, 18 + patient_id % 73 AS age_at_admission, year(st_.ad) AS admission_year,
    (epoch_us(st_.ds) - epoch_us(st_.ad)) / 86400000000.0::DOUBLE AS hospital_length_of_stay_days, first_admission_location, admission_type_category, expired_outcome, hospice_outcome,
    greatest(expired_outcome, hospice_outcome) AS hospice_or_expired, first_icu_los_days, icu_episodes, CASE WHEN icu_episodes >= 1 THEN 1 ELSE 0 END AS any_icu_episode,
    ec.* EXCLUDE (encounter_block), so.* EXCLUDE (encounter_block), coalesce(en_.n, 0) AS sepsis_events_by_sepsis_col, CASE WHEN en_.n >= 1 THEN 1 ELSE 0 END AS any_sepsis,
    CASE WHEN cr.encounter_block IS NULL THEN 0 ELSE 1 END AS crrt_flag, CASE WHEN vs IS NULL THEN 0 ELSE 1 END AS on_vent, vent_duration_hours, first_location_imv, initial_mode_category,
    time_to_extubation_hours, extubation_status, reintubated, vfd_28, nidfd_28, ex.* EXCLUDE (encounter_block), dm.* EXCLUDE (encounter_block), CASE WHEN os IS NULL THEN 0 ELSE 1 END AS has_onset,
    (epoch_us(os) - epoch_us(st_.ad)) / 86400000000.0::DOUBLE AS pre_device_los_days, (epoch_us(st_.ds) - epoch_us(os)) / 86400000000.0::DOUBLE AS post_device_los_days, nee_peak, time_to_icu_hours
    FROM flags JOIN patient ON patient_id = flags.encounter_block // 8 + 1 {" ".join(f"LEFT JOIN {t} ON {t}.encounter_block = flags.encounter_block" for t in (
        "st_", "ty", "ic", "ie", "ec", "so", "en_", "cr", "ve", "hr", "im", "lo", "xt", "vfd", "nidfd", "ex", "dm", "oo", "ne", "ti"))})""",
])


def sql(cte: str, body: str) -> str:
    """SQL text over the case views, the features and ``cte``."""
    views = [VIEWS[n] for n in ("obs", "stay", "resp", "meds", "blocks")] + [V.CTE[n] for n in ("patient", "dx")]
    return "WITH " + ",\n".join([*views, FEATURES, *([cte] if cte else [])]) + "\n" + body
