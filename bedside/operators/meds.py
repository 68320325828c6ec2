"""Medication exposure, dose statistics, hourly grids and table reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import attach, any_flag, count_when, hours_between, pct, top_k
from bedside.functions.quantiles import with_quantiles
from bedside.sources.tables import materialise

BLOCK = "encounter_block"
HOURS = 168


def exposure_columns(meds: DataFrame, drugs: list[str], block: str = BLOCK) -> DataFrame:
    """One 0/1 column per tracked drug."""
    d = F.lower("med_category")
    return meds.groupBy(block).agg(*[any_flag(d == m).alias(m) for m in drugs])


def dose_columns(meds: DataFrame, drugs: list[str], block: str = BLOCK, dose: str = "med_dose",
                 status: str | None = "convert_status") -> DataFrame:
    """Median and quartiles of the dose per encounter and drug, one column each."""
    d = meds if status is None else meds.where(F.col(status) == "success")
    d = d.where(F.col("med_category").isin(drugs)).withColumns(
        {f"_{m}": F.when(F.col("med_category") == m, F.col(dose)) for m in drugs})
    return with_quantiles(d, [block], [F.count(F.lit(1)).alias("n_doses")],
                          {f"_{m}": {f"{m}_median": 0.5, f"{m}_q1": 0.25, f"{m}_q3": 0.75} for m in drugs})


def with_icu_hour(meds: DataFrame, icu: DataFrame, block: str = BLOCK) -> DataFrame:
    """Hours since the first ICU entry and their floored bin."""
    j = meds.join(icu.select(block, "first_icu_in_dttm"), block)
    j = j.withColumn("hours_from_icu", hours_between("first_icu_in_dttm", "admin_dttm"))
    return j.withColumns({"hour_bin": F.floor("hours_from_icu").cast("int"), "med_lower": F.lower("med_category")})


def _first_week(m: DataFrame, drugs: list[str]) -> DataFrame:
    return m.where(F.col("med_lower").isin(drugs) & F.col("hour_bin").between(0, HOURS - 1))


def hourly_exposure(m: DataFrame, total: DataFrame, groups: dict[str, list[str]], keys: list[str] | None = None) -> DataFrame:
    """Distinct encounters and share of ICU encounters on a dense hour x drug grid. ``total``
    has the denominator ``n_icu`` (per key)."""
    keys = keys or []
    drugs = [d for ds in groups.values() for d in ds]
    seen = _first_week(m, drugs).select(*keys, "hour_bin", "med_lower", BLOCK).distinct().groupBy(
        *keys, F.col("hour_bin").alias("hour"), F.col("med_lower").alias("medication")).agg(F.count(F.lit(1)).alias("n"))
    grid = total.select(*keys, "n_icu", F.explode(F.sequence(F.lit(0), F.lit(HOURS - 1))).alias("hour"))
    grid = grid.select("*", F.explode(F.array(*[F.lit(d) for d in drugs])).alias("medication"))
    return grid.join(seen, [*keys, "hour", "medication"], "left").fillna(0, ["n"]).withColumn(
        "pct", pct(F.col("n"), F.col("n_icu"))).drop("n_icu")


def hourly_dose(m: DataFrame, drugs: list[str], dose: str = "med_dose") -> DataFrame:
    """Median dose by hour and drug."""
    return with_quantiles(_first_week(m, drugs), ["hour_bin", "med_lower"], [F.count(dose).alias("n")], {dose: {"median_dose": 0.5}})


def drug_summary(m: DataFrame, total: DataFrame, groups: dict[str, list[str]], keys: list[str] | None = None) -> DataFrame:
    """Encounters, share, dose quartiles and most frequent unit (smallest on ties) per drug."""
    keys = keys or []
    member = {d: g for g, ds in groups.items() for d in ds}
    week = _first_week(m, list(member))
    by = [*keys, "med_lower"]
    q = with_quantiles(week, by, [F.countDistinct(BLOCK).alias("n_encounters"), F.count("med_dose").alias("n_admin")],
                       {"med_dose": {"median_dose": 0.5, "q1_dose": 0.25, "q3_dose": 0.75}})
    units = week.where("med_dose_unit is not null").groupBy(*by, "med_dose_unit").agg(F.count(F.lit(1)).alias("_n"))
    mode = units.groupBy(*by).agg(F.min_by("med_dose_unit", F.struct(-F.col("_n"), F.col("med_dose_unit"))).alias("dose_unit"))
    out = q.join(mode, by, "left")
    out = out.join(total, keys) if keys else attach(out, total)
    label = F.create_map(*[F.lit(x) for kv in member.items() for x in kv])
    return out.withColumns({"pct_encounters": pct(F.col("n_encounters"), F.col("n_icu")),
                            "group": F.element_at(label, F.col("med_lower"))}).withColumnRenamed("med_lower", "medication").drop("n_icu")


def group_exposure(meds: DataFrame, ident: str = "hospitalization_id") -> DataFrame:
    """Hospitalizations and rows per drug group and, inside it, per drug (``med_category``
    null is the group row); share of all hospitalizations on the group rows."""
    g = meds.where("med_group is not null").groupingSets(
        [["med_group"], ["med_group", "med_category"]], "med_group", "med_category").agg(
        F.countDistinct(ident).alias("hospitalizations"), F.count(F.lit(1)).alias("administrations"),
        F.grouping("med_category").alias("is_group"))
    g = g.where((F.col("is_group") == 1) | F.col("med_category").isNotNull())
    total = meds.agg(F.countDistinct(ident).alias("_t"))
    return attach(g, total).withColumn("pct", F.when(F.col("is_group") == 1, F.round(
        pct(F.col("hospitalizations"), F.col("_t")), 2))).drop("_t", "is_group")


def dose_distributions(meds: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """Raw and range-cleaned dose statistics per (drug, unit), one pass."""
    v = F.col("med_dose")
    ok = F.lit(True)
    if low is not None:
        ok = ok & (v >= low)
    if high is not None:
        ok = ok & (v <= high)
    d = meds.where("med_dose is not null and med_dose_unit is not null").withColumn("_clean", F.when(ok, v))
    aggs = [a for p, c in (("raw", "med_dose"), ("clean", "_clean")) for a in (
        F.count(c).alias(f"{p}_count"), F.avg(c).alias(f"{p}_mean"), F.stddev_samp(c).alias(f"{p}_std"),
        F.min(c).alias(f"{p}_min"), F.max(c).alias(f"{p}_max"))]
    return with_quantiles(d, ["med_category", "med_dose_unit"], aggs, {
        c: {f"{p}_median": 0.5, f"{p}_q25": 0.25, f"{p}_q75": 0.75} for p, c in (("raw", "med_dose"), ("clean", "_clean"))}
    ).withColumn("outlier_count", F.col("raw_count") - F.col("clean_count"))


def dose_table(meds: DataFrame, minimum: int = 5, digits: int = 2) -> DataFrame:
    """Dose statistics of (drug, unit) groups with enough rows, rounded."""
    d = meds.where("med_dose is not null and med_dose_unit is not null")
    s = with_quantiles(d, ["med_category", "med_dose_unit"], [
        F.count(F.lit(1)).alias("count"), F.min("med_dose").alias("min"), F.max("med_dose").alias("max"),
        F.avg("med_dose").alias("mean"), F.stddev_samp("med_dose").alias("stddev")],
        {"med_dose": {"median": 0.5, "q1": 0.25, "q3": 0.75}}).where(F.col("count") >= minimum)
    return s.withColumns({c: F.round(c, digits) for c in ("min", "max", "mean", "median", "q1", "q3", "stddev")})


def dose_histograms(meds: DataFrame, top: int = 20, bins: int = 50) -> DataFrame:
    """Histogram of doses inside the 1.5 IQR fences for the most frequent (drug, unit)."""
    keys = ["med_category", "med_dose_unit"]
    d = meds.where("med_dose is not null and med_dose_unit is not null")
    counts = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    best = top_k(counts, top, [F.desc("n"), *[F.asc(k) for k in keys]]).select(*keys)
    d = d.join(best, keys, "left_semi")
    q = with_quantiles(d, keys, [F.min("med_dose").alias("_mn"), F.max("med_dose").alias("_mx")], {"med_dose": {"_q1": 0.25, "_q3": 0.75}})
    q = materialise(q, "fences")
    iqr = F.col("_q3") - F.col("_q1")
    f = d.join(q, keys).where(F.col("med_dose").between(F.col("_q1") - 1.5 * iqr, F.col("_q3") + 1.5 * iqr))
    lo = F.greatest(F.col("_mn"), F.col("_q1") - 1.5 * iqr)
    hi = F.least(F.col("_mx"), F.col("_q3") + 1.5 * iqr)
    width = (hi - lo) / bins
    b = F.when(width > 0, F.least(F.floor((F.col("med_dose") - lo) / width), F.lit(bins - 1))).otherwise(0)
    return f.withColumn("bin", b.cast("int")).groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"), F.min("med_dose").alias("bin_min"),
                                                                        F.max("med_dose").alias("bin_max"))


def name_mappings(meds: DataFrame, ident: str = "hospitalization_id") -> DataFrame:
    return meds.where("med_name is not null and med_category is not null").groupBy("med_name", "med_category").agg(
        F.count(F.lit(1)).alias("frequency"), F.countDistinct(ident).alias("unique_hospitalizations"))


def group_administrations(meds: DataFrame, ident: str = "hospitalization_id") -> DataFrame:
    """Administrations per exposed hospitalization by group, and a row with the total."""
    per = meds.where("med_group is not null").groupBy(ident, "med_group").agg(F.count(F.lit(1)).alias("_n"))
    total = meds.agg(F.countDistinct(ident).alias("_t"))
    s = with_quantiles(per, ["med_group"], [F.count(F.lit(1)).alias("exposed_hosps"), F.avg("_n").alias("avg_administrations"),
                                            F.min("_n").alias("min_administrations"), F.max("_n").alias("max_administrations")],
                       {"_n": {"median_administrations": 0.5}})
    s = attach(s, total).withColumn("percentage", F.round(pct(F.col("exposed_hosps"), F.col("_t")), 2)).drop("_t")
    s = s.withColumns({c: F.bround(c, 0).cast("int") for c in ("avg_administrations", "median_administrations")})
    row = total.select(F.lit("TOTAL_HOSPITALIZATIONS").alias("med_group"), F.col("_t").alias("exposed_hosps"), F.lit(100.0).alias("percentage"))
    return s.unionByName(row, allowMissingColumns=True)


def medication_summary(meds: DataFrame, ident: str = "hospitalization_id") -> DataFrame:
    """Counts, three widest groups, five widest drugs and the number of multi-unit drugs as
    (section, item, value) rows."""
    base = meds.agg(F.count(F.lit(1)).alias("total_records"), F.countDistinct(ident).alias("unique_hospitalizations"),
                    F.countDistinct("med_category").alias("unique_categories"), F.countDistinct("med_group").alias("unique_groups"))
    basic = base.select(F.explode(F.array(*[F.struct(F.lit("basic").alias("section"), F.lit(c).alias("item"), F.col(c).alias("value"))
                                            for c in base.columns])).alias("r")).select("r.*")

    def widest(col, k, section):
        c = meds.where(F.col(col).isNotNull()).groupBy(F.col(col).alias("item")).agg(F.countDistinct(ident).alias("value"))
        return top_k(c, k, [F.desc("value"), F.asc("item")]).select(F.lit(section).alias("section"), "item", "value")
    units = (meds.where("med_dose is not null and med_dose_unit is not null").groupBy("med_category")
             .agg(F.countDistinct("med_dose_unit").alias("u")).agg(count_when(F.col("u") > 1).alias("value"))
             .select(F.lit("multi_unit").alias("section"), F.lit("medications").alias("item"), "value"))
    return basic.unionByName(widest("med_group", 3, "top_groups")).unionByName(widest("med_category", 5, "top_medications")).unionByName(units)
