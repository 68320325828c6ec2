"""Encounter flags, critical-illness and ward cohorts, strata and flow counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import attach, any_flag, count_when, flag, norm, pct
from bedside.operators import temporal

BLOCK = "encounter_block"

# Default vasoactive drugs of the cohort rule.
VASOACTIVES = ["norepinephrine", "epinephrine", "phenylephrine", "vasopressin", "dopamine", "angiotensin"]
# Devices that always count, and the one that needs a flow.
ALWAYS_DEVICES = ["imv", "nippv", "cpap"]
FLOW_DEVICE, FLOW_MIN = "high flow nc", 30.0
# Discharge categories that count as death.
DEATH_CATEGORIES = ["expired", "hospice"]

# Stratum name -> flag column.
STRATA = {
    "icu": "icu_enc",
    "advanced_resp": "high_support_enc",
    "advanced_resp/icu": "high_support_icu_enc",
    "advanced_resp/no_icu": "high_support_no_icu_enc",
    "nippv_hfnc": "nippv_hfnc_enc",
    "nippv_hfnc/icu": "nippv_hfnc_icu_enc",
    "nippv_hfnc/no_icu": "nippv_hfnc_no_icu_enc",
    "vaso": "vaso_support_enc",
    "vaso/icu": "vaso_icu_enc",
    "vaso/no_icu": "vaso_no_icu_enc",
    "vaso/ed_icu": "vaso_ed_icu_enc",
    "vaso/ed_ward": "vaso_ed_ward_enc",
    "no_imv": "no_imv_enc",
    "no_imv/icu": "no_imv_icu_enc",
    "no_imv/no_icu": "no_imv_no_icu_enc",
    "deaths": "death_enc",
}


def location_flags(adt: DataFrame, block: str = BLOCK, location: str = "location_category",
                   discharge: str = "discharge_category", match: str = "contains") -> DataFrame:
    """ICU / death / ward / procedural-only per encounter in one aggregate. ICU matches
    by substring; ``match='equals'`` for the exact form."""
    loc = norm(location)
    icu = loc.contains("icu") if match == "contains" else loc == "icu"
    proc = loc.contains("procedural") | loc.contains("l&d")
    return (adt.groupBy(block).agg(
        any_flag(icu).alias("icu_enc"),
        any_flag(norm(discharge).isin(DEATH_CATEGORIES)).alias("death_enc"),
        any_flag(loc == "ward").alias("ward_enc"), any_flag(proc).alias("_proc"))
        .withColumn("is_procedural_ld_only", flag((F.col("icu_enc") == 0) & (F.col("_proc") == 1)))
        .drop("_proc"))


def _flow_ok(resp: DataFrame, lpm: str, threshold: float) -> Column:
    if lpm not in resp.columns:
        return F.lit(False)
    return F.expr(f"try_cast(`{lpm}` AS double)") >= F.lit(float(threshold))


def support_rule(resp: DataFrame, always: list[str], device: str = "device_category", lpm: str = "lpm_set",
                 threshold: float = FLOW_MIN) -> Column:
    """Always-qualifying devices, or high flow at or above the threshold. Without a flow
    column high flow never qualifies."""
    d = norm(device)
    return d.isin(always) | ((d == FLOW_DEVICE) & _flow_ok(resp, lpm, threshold))


def high_support(resp: DataFrame, block: str = BLOCK, threshold: float = FLOW_MIN) -> DataFrame:
    return resp.where(support_rule(resp, ALWAYS_DEVICES, threshold=threshold)).select(block).distinct()


def nippv_hfnc(resp: DataFrame, block: str = BLOCK, threshold: float = FLOW_MIN) -> DataFrame:
    return resp.where(support_rule(resp, ["nippv"], threshold=threshold)).select(block).distinct()


def vaso_support(meds: DataFrame, block: str = BLOCK, drugs: list[str] | None = None) -> DataFrame:
    names = [d.lower() for d in (VASOACTIVES if drugs is None else drugs)]
    return meds.where(norm("med_category").isin(names)).select(block).distinct()


def build_flags(adt: DataFrame, resp: DataFrame, meds: DataFrame, block: str = BLOCK,
                drugs: list[str] | None = None, threshold: float = FLOW_MIN) -> DataFrame:
    """One row per encounter with every base flag. Support flags are cleared for
    procedural-only encounters; ``cohort_enc`` is the critical-illness rule."""
    names = [d.lower() for d in (VASOACTIVES if drugs is None else drugs)]
    r = resp.groupBy(block).agg(
        any_flag(support_rule(resp, ALWAYS_DEVICES, threshold=threshold)).alias("high_support_enc"),
        any_flag(support_rule(resp, ["nippv"], threshold=threshold)).alias("nippv_hfnc_enc"),
        any_flag(norm("device_category") == "imv").alias("imv_enc"))
    m = meds.groupBy(block).agg(any_flag(norm("med_category").isin(names)).alias("vaso_support_enc"))
    base = location_flags(adt, block).join(r, block, "left").join(m, block, "left")
    allowed = F.col("is_procedural_ld_only") == 0
    support = ["high_support_enc", "nippv_hfnc_enc", "vaso_support_enc", "imv_enc"]
    base = base.withColumns({c: flag((F.col(c) == 1) & allowed) for c in support})
    any_of = ((F.col("icu_enc") == 1) | (F.col("death_enc") == 1) | (F.col("high_support_enc") == 1)
              | (F.col("vaso_support_enc") == 1))
    return base.withColumn("cohort_enc", flag(any_of & allowed))


def critical_illness(flags: DataFrame) -> DataFrame:
    return flags.where("cohort_enc = 1")


def ward_cohort(flags: DataFrame) -> DataFrame:
    return flags.where("ward_enc = 1")


def cohort_counts(flags: DataFrame) -> DataFrame:
    """Encounters with each flag and in the cohort."""
    names = ["icu_enc", "high_support_enc", "vaso_support_enc", "death_enc", "cohort_enc"]
    return flags.agg(F.count(F.lit(1)).alias("total"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])


def ed_pressor_flags(adt: DataFrame, meds: DataFrame, block: str = BLOCK, admin: str = "admin_dttm",
                     start: str = "in_dttm", end: str = "out_dttm", location: str = "location_category",
                     drugs: list[str] | None = None) -> DataFrame:
    """First vasopressor during an ED stay, then any later ICU row, else any later ward row."""
    names = [d.lower() for d in (VASOACTIVES if drugs is None else drugs)]
    ed = adt.where(norm(location) == "ed").select(block, F.col(start).alias("_i"), F.col(end).alias("_o"))
    hit = temporal.first_event_in_window(meds.where(norm("med_category").isin(names)), ed, [block], admin, "_i", "_o")
    hit = hit.select(block, F.col(admin).alias("first_pressor_admin_dttm"))
    later = F.col(start) > F.col("first_pressor_admin_dttm")
    loc = norm(location)
    return (adt.select(block, start, location).join(hit, block)
            .groupBy(block, "first_pressor_admin_dttm")
            .agg(any_flag(later & loc.contains("icu")).alias("vaso_ed_icu_enc"),
                 any_flag(later & (loc == "ward")).alias("_ward"))
            .withColumn("vaso_ed_ward_enc", flag((F.col("_ward") == 1) & (F.col("vaso_ed_icu_enc") == 0)))
            .drop("_ward"))


def derived_flags(flags: DataFrame, on_vent: str = "imv_enc") -> DataFrame:
    """ICU splits of every support flag, the catch-all groups and the no-ventilation group."""
    on = lambda c: F.col(c) == 1
    out = {}
    for parent, stem in (("vaso_support_enc", "vaso"), ("high_support_enc", "high_support"),
                         ("nippv_hfnc_enc", "nippv_hfnc")):
        out[f"{stem}_icu_enc"] = flag(on(parent) & on("icu_enc"))
        out[f"{stem}_no_icu_enc"] = flag(on(parent) & ~on("icu_enc"))
    none = ~on("icu_enc") & ~on("vaso_support_enc") & ~on("high_support_enc")
    out["other_critically_ill"] = flag(on("death_enc") & none)
    out["ward_no_critical_care"] = flag(~on("death_enc") & none)
    out["no_imv_enc"] = flag(F.coalesce(F.col(on_vent), F.lit(0)) == 0)
    out["no_imv_icu_enc"] = flag((F.coalesce(F.col(on_vent), F.lit(0)) == 0) & on("icu_enc"))
    out["no_imv_no_icu_enc"] = flag((F.coalesce(F.col(on_vent), F.lit(0)) == 0) & ~on("icu_enc"))
    return flags.withColumns(out)


def all_flags(adt: DataFrame, resp: DataFrame, meds: DataFrame, block: str = BLOCK, admin: str = "admin_dttm",
              start: str = "in_dttm", end: str = "out_dttm", drugs: list[str] | None = None,
              threshold: float = FLOW_MIN) -> DataFrame:
    """Base, derived and ED-pressor flags of every encounter."""
    base = derived_flags(build_flags(adt, resp, meds, block, drugs, threshold))
    ed = ed_pressor_flags(adt, meds, block, admin, start, end, drugs=drugs)
    return base.join(ed.drop("first_pressor_admin_dttm"), block, "left").fillna(
        0, ["vaso_ed_icu_enc", "vaso_ed_ward_enc"])


def stratum_members(flags: DataFrame, block: str = BLOCK, keep: list[str] | None = None,
                    strata: dict[str, str] | None = None) -> DataFrame:
    """(stratum, encounter) rows; an encounter appears once per stratum it is in."""
    strata = {s: c for s, c in (STRATA if strata is None else strata).items() if c in flags.columns}
    e = F.explode(F.array(*[F.struct(F.lit(s).alias("stratum"), F.col(c).alias("on")) for s, c in strata.items()]))
    keep = [c for c in (keep or []) if c != block]
    return flags.select(block, *keep, e.alias("_e")).where("_e.on = 1").select("_e.stratum", block, *keep)


def mortality_by_group(flags: DataFrame, groups: dict[str, str | None]) -> DataFrame:
    """Death rate (percent, 0 for an empty group) for each named flag; None means all."""
    aggs, rows = [], []
    for i, c in enumerate(groups.values()):
        inside = F.lit(True) if c is None else F.col(c) == 1
        aggs += [count_when(inside).alias(f"n{i}"), count_when(inside & (F.col("death_enc") == 1)).alias(f"d{i}")]
    for i, name in enumerate(groups):
        rate = F.coalesce(pct(F.col(f"d{i}"), F.col(f"n{i}")), F.lit(0.0))
        rows.append(F.struct(F.lit(name).alias("count_name"), F.col(f"n{i}").alias("n_encounters"),
                             rate.alias("count_value")))
    return flags.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def mortality_by_stratum(flags: DataFrame) -> DataFrame:
    """Encounters, deaths and mortality of every stratum in one pass."""
    m = stratum_members(flags.withColumn("_death", F.col("death_enc")), keep=["_death"])
    n, d = F.count(F.lit(1)), F.sum("_death")
    return m.groupBy("stratum").agg(n.alias("n_encounters"), d.alias("n_deaths"), pct(d, n).alias("mortality_pct"))


def membership_counts(flags: DataFrame, cols: list[str]) -> DataFrame:
    """Encounters per combination of flags (set-intersection plots)."""
    return flags.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))


def outcome_flags(df: DataFrame, block: str = BLOCK, discharge: str = "discharge_category") -> DataFrame:
    d = norm(discharge)
    return df.groupBy(block).agg(any_flag(d == "hospice").alias("hospice"), any_flag(d == "expired").alias("expired"),
                                 any_flag(d.isin(DEATH_CATEGORIES)).alias("hospice_or_expired"))


def flow_counts(all_stays: DataFrame, adult_stays: DataFrame, flags: DataFrame, hosp_id: str = "hospitalization_id",
                ward_mode: bool = False) -> DataFrame:
    """Enrollment-flow table: total, adult, stitched, flag groups."""
    one = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    f = flags.agg(F.count(F.lit(1)).alias("stitched"), one("icu_enc").alias("icu"), one("high_support_enc").alias("resp"),
                  one("vaso_support_enc").alias("vaso"),
                  one(flag((F.col("cohort_enc") == 1) & (F.col("other_critically_ill") == 1))).alias("other"),
                  one("cohort_enc").alias("all"), one("ward_enc").alias("ward"),
                  one(flag((F.col("ward_enc") == 1) & (F.col("ward_no_critical_care") == 1))).alias("ward_none"))
    wide = attach(attach(f, all_stays.agg(F.countDistinct(hosp_id).alias("total"))),
                  adult_stays.agg(F.countDistinct(hosp_id).alias("adult")))
    names = {"0_total_hospitalizations": "total", "1_adult_hospitalizations": "adult", "1b_after_stitching": "stitched",
             "2_icu": "icu", "3_advanced_resp": "resp", "3_vaso": "vaso", "4_other_critically_ill": "other",
             "5_all_critically_ill": "all"}
    if ward_mode:
        names |= {"6_ward_no_critical_care": "ward_none", "ward_cohort_total": "ward"}
    rows = F.array(*[F.struct(F.lit(k).alias("count_name"), F.col(c).alias("count_value")) for k, c in names.items()])
    return wide.select(F.explode(rows).alias("r")).select("r.*")
