"""Empirical distributions, quantile bins, collection statistics, profiles and tests."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import attach, count_when, entropy_bits, hours_between, norm, pct, top_k, union_all
from bedside.functions.ordered import Ordered, value_slice
from bedside.functions.quantiles import group_quantiles, with_quantiles
from bedside.operators import temporal
from bedside.operators.clean import null_outliers, stack, unit_is, unit_label
from bedside.sources.tables import materialise

PERCENTILES = [5, 10, 25, 50, 75, 90, 95]


def value_counts(df: DataFrame, keys: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Rows per distinct value and group, counted before anything is shuffled by group; ``weight`` names
    the column that says how many rows a row stands for."""
    v = F.col(value).cast("double")
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(v.isNotNull() & ~F.isnan(v)).groupBy(*keys, v.alias(value)).agg(n.alias("n"))


def ranked_counts(counts: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Adds rows up to the value (``upto``) and in the group (``total``)."""
    return Ordered(counts, keys, [value], value_slice(value)).cumsum("upto", "n").total("total", "n").apply()


def ecdf(df: DataFrame, keys: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Distinct values with the share of rows at or below them. Counts are written before they are ordered, so that
    what they are counted from is computed once."""
    r = ranked_counts(materialise(value_counts(df, keys, value, weight), "counted"), keys, value)
    return r.select(*keys, value, (F.col("upto") / F.col("total")).alias("probability"))


def ecdf_summary(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Count, range, mean, population sd and percentiles beside an ECDF; NaN counts as missing in all of them."""
    return with_quantiles(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))), keys, [
        F.count(value).alias("count"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"),
        F.stddev_pop(value).alias("std")], {value: {f"p{p}": p / 100 for p in PERCENTILES}})


def quantile_bins(ranked: DataFrame, keys: list[str], bins: str, value: str = "value") -> DataFrame:
    """Quantile bins of counted values (``n``, ``upto``, ``total``); column ``bins`` is the
    wanted number per group. Equal edges collapse; the first bin is closed, the others open
    on the left. The first left edge is the true minimum. One row per bin, empty ones too."""
    n, b = F.col("total"), F.col(bins)
    first, last = F.col("upto") - F.col("n"), F.col("upto")
    on = lambda r: (r >= first) & (r < last)
    at = lambda i: (n - 1) * i / b
    # only the edge numbers whose neighbouring ranks fall on this value are kept
    mine = F.filter(F.sequence(F.lit(0), b.cast("int")), lambda i: on(F.floor(at(i))) | on(F.ceil(at(i))))
    picks = ranked.select(*keys, value, "n", "upto", "total", bins, F.explode(mine).alias("_i"))
    h = at(F.col("_i"))
    edges = picks.groupBy(*keys, "_i").agg(F.max(F.when(on(F.floor(h)), F.col(value))).alias("_lo"),
                                           F.max(F.when(on(F.ceil(h)), F.col(value))).alias("_hi"), F.max(h - F.floor(h)).alias("_f"))
    # at most bins + 1 edges per group
    edges = edges.groupBy(*keys).agg(F.array_sort(F.collect_set(
        F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_f"))).alias("_e"))
    edges = materialise(edges, "edges")  # read twice below, joined by its known size
    below = F.size(F.filter("_e", lambda e: e < F.col(value)))
    hits = ranked.join(edges, keys).groupBy(*keys, F.greatest(below, F.lit(1)).alias("bin_num")).agg(F.sum("n").alias("count"))
    k = F.greatest(F.size("_e") - 1, F.lit(1))
    frame = edges.select(*keys, "_e", F.explode(F.sequence(F.lit(1), k)).alias("bin_num"))
    frame = frame.select(*keys, "bin_num", F.element_at("_e", F.col("bin_num")).alias("bin_min"),
                         F.element_at("_e", F.least(F.col("bin_num") + 1, F.size("_e"))).alias("bin_max"))
    return frame.join(hits, [*keys, "bin_num"], "left").fillna(0, ["count"])


def interval_text() -> Column:
    body = F.format_string("%.2f, %.2f]", "bin_min", "bin_max")
    return F.concat(F.when(F.col("bin_num") == 1, "[").otherwise("("), body)


def flat_bins(df: DataFrame, keys: list[str], value: str = "value", bins: int = 10, weight: str | None = None) -> DataFrame:
    """Quantile bins without segments; fewer when a group has under two rows per bin."""
    r = ranked_counts(value_counts(df, keys, value, weight), keys, value)
    r = r.withColumn("_b", F.when(F.col("total") < 2 * bins, F.greatest(F.lit(1), F.floor(F.col("total") / 2))).otherwise(bins).cast("int"))
    r = materialise(r, "ranked")
    total = r.groupBy(*keys).agg(F.max("total").alias("_t"))
    return quantile_bins(r, keys, "_b", value).join(total, keys).withColumn("percentage", pct(F.col("count"), F.col("_t"))).drop("_t")


def segment_rows(df: DataFrame, config: DataFrame, keys: list[str], on: list[str], value: str = "value", weight: str | None = None) -> DataFrame:
    """Rows tagged below / normal / above with the number of bins wanted; limits belong to
    both neighbours. ``config`` has one row per metric: normal_lower, normal_upper,
    outlier_min, outlier_max, bins_below, bins_normal, bins_above."""
    v = F.col(value)
    seg = lambda name, lo, hi, b, ok: F.when((v >= lo) & (v <= hi) & (F.col(b) > 0) & ok,
                                             F.struct(F.lit(name).alias("segment"), F.col(b).alias("_want")))
    lo, hi = F.col("normal_lower"), F.col("normal_upper")
    tags = F.array_compact(F.array(
        seg("below", F.col("outlier_min"), lo, "bins_below", F.col("outlier_min") < lo), seg("normal", lo, hi, "bins_normal", F.lit(True)),
        seg("above", hi, F.col("outlier_max"), "bins_above", hi < F.col("outlier_max"))))
    return df.join(config, on).withColumn("_s", F.explode(tags)).select(
        *keys, value, *([weight] if weight else []), "_s.segment", "_s._want")


def segmented_bins(df: DataFrame, config: DataFrame, keys: list[str], on: list[str], value: str = "value",
                   extreme_bins: int = 5, weight: str | None = None) -> DataFrame:
    """Quantile bins per segment; the outermost bin of a several-bin segment is split again
    into ``extreme_bins`` quantiles when it has at least twice as many rows. Percentages are
    of the segment."""
    g = [*keys, "segment"]
    rows = segment_rows(df, config, keys, on, value, weight)
    # the wanted number depends on the group, so it can ride along as a key
    gw = [*g, "_want"]
    r = ranked_counts(value_counts(rows, gw, value, weight), gw, value)
    r = r.withColumn("_b", F.when(F.col("total") < 2 * F.col("_want"), 1).otherwise(F.col("_want")).cast("int"))
    # the ranked values feed six steps below and are far fewer than the rows
    r = materialise(r.drop("_want"), "ranked")
    total = r.groupBy(*g).agg(F.max("total").alias("_t"), F.max("_b").alias("_b"))
    base = materialise(quantile_bins(r, g, "_b", value), "bins")
    # single-bin segments are never split
    ends = base.groupBy(*g).agg(F.max("bin_num").alias("_k"), F.max_by("bin_min", "bin_num").alias("_last_left"),
                                F.min_by("bin_max", "bin_num").alias("_first_right")).join(total, g)
    can = (F.col("_b") > 1) & F.col("segment").isin("below", "above")
    tail = r.select(*g, value, "n").join(ends.where(can), g).where(
        F.when(F.col("segment") == "below", F.col(value) <= F.col("_first_right"))
        .otherwise(F.col(value) >= F.col("_last_left"))).select(*g, value, "n")
    tr = ranked_counts(tail, g, value).where(F.col("total") >= 2 * extreme_bins).withColumn("_b", F.lit(extreme_bins))
    extra = materialise(quantile_bins(tr, g, "_b", value), "tails")
    split = extra.groupBy(*g).agg(F.max("bin_num").alias("_x"))
    main = base.join(ends.select(*g, "_k"), g).join(split, g, "left")
    is_end = F.col("bin_num") == F.when(F.col("segment") == "below", 1).otherwise(F.col("_k"))
    main = main.where(F.col("_x").isNull() | ~is_end).withColumn("bin_num", F.when(
        F.col("_x").isNotNull() & (F.col("segment") == "below"), F.col("bin_num") + F.col("_x") - 1).otherwise(F.col("bin_num")))
    extra = extra.join(ends.select(*g, "_k"), g).withColumn("bin_num", F.when(
        F.col("segment") == "above", F.col("bin_num") + F.col("_k") - 1).otherwise(F.col("bin_num")))
    out = main.drop("_x").unionByName(extra).drop("_k").join(total.drop("_b"), g)
    return out.withColumn("percentage", pct(F.col("count"), F.col("_t"))).drop("_t")


def segment_statistics(df: DataFrame, config: DataFrame, keys: list[str], on: list[str], value: str = "value") -> DataFrame:
    rows = segment_rows(df, config, keys, on, value)
    return with_quantiles(rows, [*keys, "segment"], [
        F.count(value).alias("count"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max")], {value: {"median": 0.5}})


def category_units(labs: DataFrame, category: str = "lab_category", unit: str = "reference_unit") -> DataFrame:
    """(category, unit) pairs with row counts, normalised."""
    return labs.where(F.col(category).isNotNull()).groupBy(F.lower(F.trim(category)).alias("category"), unit_label(unit).alias("unit")).agg(
        F.count(F.lit(1)).alias("n"))


def classify_units(pairs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """ok / unit_mismatch / not_in_spec with the canonical unit. ``vocabulary`` has
    (category, canonical_unit, allowed_variant) rows."""
    v = vocabulary.select(F.lower(F.trim("category")).alias("category"), "canonical_unit", F.lower(F.trim("allowed_variant")).alias("unit"))
    known = v.groupBy("category").agg(F.min("canonical_unit").alias("canonical_unit"))
    ok = v.select("category", "unit").distinct().withColumn("_ok", F.lit(1))
    out = pairs.join(known, "category", "left").join(ok, ["category", "unit"], "left")
    status = F.when(F.col("canonical_unit").isNull(), "not_in_spec").when(F.col("_ok") == 1, "ok").otherwise("unit_mismatch")
    rank = F.when(F.col("status") == "ok", 0).when(F.col("status") == "unit_mismatch", 1).otherwise(2)
    return out.withColumn("status", status).withColumn("status_rank", rank).drop("_ok")


def unit_issues(classified: DataFrame, binned: DataFrame, ranged: DataFrame) -> DataFrame:
    """Mismatches and coverage gaps as one table: unit_mismatch, not_in_spec, no_bin_config
    and no_outlier_range."""
    c = classified.select("category", "unit", "n", "status")
    ok = c.where("status = 'ok'")
    gap = lambda other, name: ok.join(other.select(F.lower(F.trim("category")).alias("category")).distinct(), "category",
                                      "left_anti").select("category", "unit", "n", F.lit(name).alias("issue"))
    return union_all([c.where("status <> 'ok'").select("category", "unit", "n", F.col("status").alias("issue")),
                      gap(binned, "no_bin_config"), gap(ranged, "no_outlier_range")])


def measurement_stream(labs: DataFrame, vitals: DataFrame, resp: DataFrame, units: dict[str, list[str]], settings: list[str], ident: str,
                       ts: str, category: str = "category", value: str = "value", unit: str = "reference_unit") -> DataFrame:
    """Laboratory values in a wanted unit, vital signs and respiratory settings as one stream (id, time, metric, value).
    A metric carries its source, as in ``labs/lactate``; each source is read once. ``units`` has the units per
    laboratory category; categories without units are left out."""
    wanted = F.lit(False)
    for name, allowed in units.items():
        wanted = wanted | ((norm(category) == name.lower()) & unit_is(unit, allowed))
    name = lambda source, c: F.concat(F.lit(f"{source}/"), F.lower(F.trim(c))).alias("metric")
    one = lambda df, source: df.select(ident, ts, name(source, F.col(category)), F.col(value).cast("double").alias("value"))
    wide = stack(resp, [ident, ts], settings).select(ident, ts, name("resp", F.col("metric")), "value")
    return union_all([one(labs.where(wanted), "labs"), one(vitals, "vitals"), wide]).where("metric is not null and value is not null")


def windowed_metrics(values: DataFrame, windows: DataFrame, ranges: DataFrame, ident: str, ts: str, metric: str = "metric",
                     count_once: bool = False) -> DataFrame:
    """Values of every metric inside every stratum's windows, outliers removed: one join for
    all strata and metrics. ``windows`` is (stratum, id, start_dttm, end_dttm), ``ranges``
    is (metric, outlier_min, outlier_max). A value counts once per window that holds it; with ``count_once`` it counts
    once per stratum, found by a sweep that forms no (value, window) pair, and the windows' columns are left out."""
    ranged = lambda v: v.join(ranges.select(metric, "outlier_min", "outlier_max"), metric).where(
        F.col("value").between(F.col("outlier_min"), F.col("outlier_max"))).drop("outlier_min", "outlier_max")
    if count_once:
        strata = windows.select(ident, "stratum").distinct()
        return temporal.covered_events(ranged(values).join(strata, ident), windows, ["stratum", ident], ts, "start_dttm", "end_dttm")
    return ranged(temporal.interval_join(values, windows, [ident], ts, "start_dttm", "end_dttm"))


def metric_panels(values: DataFrame, config: DataFrame, keys: list[str], on: list[str], bins: int = 10) -> DataFrame:
    """ECDF and bins of every group in one table: ``kind`` is 'ecdf' (value, probability), 'bins' (by segment,
    for the metrics of ``config``) or 'flat' (plain quantile bins, for all others). The values are counted once; curves
    and bins start from the written counts, which are far fewer than the rows."""
    c = materialise(value_counts(values, keys), "counts")
    others = c.join(config.select(*on).distinct(), on, "left_anti")
    kinds = {"ecdf": ecdf(c, keys, weight="n"), "bins": segmented_bins(c, config, keys, on, weight="n"),
             "flat": flat_bins(others, keys, bins=bins, weight="n")}
    return union_all([df.withColumn("kind", F.lit(k)) for k, df in kinds.items()])


def collection_statistics(values: DataFrame, windows: DataFrame, ident: str, ts: str, keys: list[str],
                          start: str = "start_dttm", end: str = "end_dttm") -> DataFrame:
    """Observations per stay (whole, first 24 / 48 / 72 h): mean, median, IQR; stays,
    observations, distinct observations and mean window length."""
    m = temporal.interval_join(values, windows, [ident], ts, start, end).withColumn("_h", hours_between(start, ts))
    spans = {"whole_stay": None, "first_24hr": 24, "first_48hr": 48, "first_72hr": 72}
    per = m.groupBy(*keys, ident).agg(
        *[(F.count(F.lit(1)) if h is None else count_when(F.col("_h") <= h)).alias(s) for s, h in spans.items()],
        F.countDistinct(ts, "value").alias("_d"), F.min(start).alias("_s"), F.max(end).alias("_e"))
    per = per.withColumn("_los", hours_between("_s", "_e"))
    q = with_quantiles(per, keys, [
        F.count(F.lit(1)).alias("total_number_of_stays"), F.sum("whole_stay").alias("total_observations"),
        F.sum("_d").alias("distinct_observations"), F.avg("_los").alias("mean_los_hours"),
        *[F.avg(s).alias(f"{s}_mean") for s in spans]],
        {s: {f"{s}_median": 0.5, f"_{s}_q1": 0.25, f"_{s}_q3": 0.75} for s in spans})
    q = q.withColumns({f"{s}_iqr": F.col(f"_{s}_q3") - F.col(f"_{s}_q1") for s in spans})
    return q.drop(*[f"_{s}_{x}" for s in spans for x in ("q1", "q3")])


def combination_counts(df: DataFrame, cols: list[str]) -> DataFrame:
    """Rows per combination of the columns that exist."""
    return df.groupBy(*[c for c in cols if c in df.columns]).agg(F.count(F.lit(1)).alias("n"))


# Column combinations counted per table.
COMBINATIONS = {
    "patient": [["race_name", "race_category"], ["ethnicity_name", "ethnicity_category"], ["language_name", "language_category"]],
    "hospitalization": [["admission_type_name", "admission_type_category"], ["discharge_name", "discharge_category"]],
    "adt": [["location_name", "location_category", "location_type"]],
    "labs": [["lab_name", "lab_category", "lab_loinc_code"], ["lab_specimen_name", "lab_specimen_category"],
             ["lab_order_name", "lab_order_category"]],
    "vitals": [["vital_name", "vital_category"]],
    "medication_admin_continuous": [["med_name", "med_category"], ["med_route_name", "med_route_category"],
                                    ["mar_action_name", "mar_action_category"]],
    "medication_admin_intermittent": [["med_name", "med_category"], ["med_route_name", "med_route_category"],
                                      ["mar_action_name", "mar_action_category"]],
    "crrt_therapy": [["crrt_mode_name", "crrt_mode_category"]],
    "ecmo_mcs": [["device_name", "device_category"]],
    "code_status": [["code_status_name", "code_status_category"]],
    "microbiology_culture": [["fluid_name", "fluid_category", "lab_loinc_code"], ["method_name", "method_category"],
                             ["organism_name", "organism_category"]],
    "microbiology_nonculture": [["fluid_name", "fluid_category", "lab_loinc_code"], ["method_name", "method_category"],
                                ["organism_name", "organism_category"], ["micro_order_name"]],
    "microbiology_susceptibility": [["organism_name", "organism_category"]],
    "patient_assessments": [["assessment_name", "assessment_category", "assessment_group"]],
    "patient_procedures": [["procedure_name", "procedure_category"]],
    "position": [["position_name", "position_category"]],
    "hospital_diagnosis": [["diagnosis_code", "diagnosis_code_type", "diagnosis_type", "poc_flag"]],
    "respiratory_support": [["device_name", "device_category"], ["mode_name", "mode_category"]],
}
# Columns profiled per table, categorical then numeric.
PROFILES = {
    "patient": (["sex_category", "race_category", "ethnicity_category", "language_category"], []),
    "hospitalization": (["discharge_category", "admission_type_category"], []),
    "adt": (["location_category", "location_type", "hospital_type"], []),
    "code_status": (["code_status_category"], []),
    "crrt_therapy": (["crrt_mode_category"], ["blood_flow_rate", "pre_filter_replacement_fluid_rate",
                                              "post_filter_replacement_fluid_rate", "dialysate_flow_rate", "ultrafiltration_out"]),
    "ecmo_mcs": (["device_category", "mcs_group"], ["device_rate", "sweep", "flow", "fdO2"]),
    "labs": (["lab_order_category", "lab_category", "lab_specimen_category"], []),
    "position": (["position_category"], []),
    "respiratory_support": (["device_category", "mode_category", "tracheostomy"], []),
    "vitals": (["vital_category"], []),
    "hospital_diagnosis": (["diagnosis_code_format"], []),
}


def profile_table(df: DataFrame, table: str, profiles: dict | None = None) -> DataFrame:
    """Categorical levels and numeric figures of the columns profiled for a table, stacked."""
    cat, num = (profiles or PROFILES).get(table, ([], []))
    parts = [categorical_profile(df, c).withColumn("column", F.lit(c)) for c in cat if c in df.columns]
    present = [c for c in num if c in df.columns]
    if present:
        parts.append(numeric_summary(df, [], present, "linear").withColumnsRenamed({"variable": "column", "n": "count"}))
    return union_all(parts)


def table_combinations(df: DataFrame, table: str, combinations: dict | None = None) -> DataFrame:
    """All combinations of one table stacked: (combination, values, n)."""
    parts = []
    for cols in (combinations or COMBINATIONS).get(table, []):
        present = [c for c in cols if c in df.columns]
        if present:
            c = combination_counts(df, present)
            parts.append(c.select(F.lit("+".join(present)).alias("combination"), F.concat_ws(
                " | ", *[F.coalesce(F.col(x).cast("string"), F.lit("Missing")) for x in present]).alias("values"), "n"))
    return union_all(parts)


def numeric_summary(df: DataFrame, keys: list[str], cols: list[str], interpolation: str = "nearest") -> DataFrame:
    """total, n, missing, range, mean, sd, median and quartiles per group and column, long.
    Quartiles take the nearest rank unless told otherwise; the median always averages."""
    present = [c for c in cols if c in df.columns]
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_x")) for c in present]))
    long = df.select(*keys, e.alias("_e")).select(*keys, "_e.variable", "_e._x")
    g = [*keys, "variable"]
    base = with_quantiles(long, g, [
        F.count(F.lit(1)).alias("total_obs"), F.count("_x").alias("n"), count_when(F.col("_x").isNull()).alias("missing"),
        F.min("_x").alias("min"), F.max("_x").alias("max"), F.avg("_x").alias("mean"), F.stddev_samp("_x").alias("sd")],
        {"_x": {"median": 0.5} | ({} if interpolation == "nearest" else {"q1": 0.25, "q3": 0.75})})
    if interpolation == "nearest":
        q = group_quantiles(long, g, {"_x": {"q1": 0.25, "q3": 0.75}}, "nearest")
        base = base.alias("a").join(q.alias("b"), F.struct(*[F.col(f"a.{k}") for k in g]) == F.struct(*[F.col(f"b.{k}") for k in g]),
                                    "left").drop(*[F.col(f"b.{k}") for k in g])
    return base


def numeric_summary_with_total(df: DataFrame, category: str, cols: list[str], interpolation: str = "linear") -> DataFrame:
    """Numeric summary per category level and for 'All'."""
    both = df.withColumn("level", F.explode(F.array(F.lit("All"), F.coalesce(F.col(category).cast("string"), F.lit("Missing")))))
    return numeric_summary(both, ["level"], cols, interpolation)


def categorical_profile(df: DataFrame, col: str, top: int | None = None, keys: list[str] | None = None) -> DataFrame:
    """Counts and percentages of the levels; beyond ``top`` levels the rest is 'Other'."""
    keys = keys or []
    c = df.groupBy(*keys, F.coalesce(F.col(col).cast("string"), F.lit("Missing")).alias("value")).agg(F.count(F.lit(1)).alias("count"))
    if top is not None:
        # the head of the ranking is short; everything else is an anti join away from it
        head = top_k(c, top, [F.desc("count"), F.asc("value")], keys).select(*keys, "value").withColumn("_top", F.lit(1))
        c = c.join(head, [*keys, "value"], "left").withColumn(
            "value", F.when(F.col("_top") == 1, F.col("value")).otherwise("Other")).groupBy(*keys, "value").agg(F.sum("count").alias("count"))
    t = c.groupBy(*keys).agg(F.sum("count").alias("_t"))
    c = c.join(t, keys) if keys else attach(c, t)
    return c.withColumn("percentage", F.bround(pct(F.col("count"), F.col("_t")), 2)).drop("_t")


def categorical_summary(df: DataFrame, col: str) -> DataFrame:
    """Rows, distinct levels, missing share, most frequent level and entropy, one row."""
    c = df.groupBy(F.col(col).cast("string").alias("v")).agg(F.count(F.lit(1)).alias("n")).withColumn("_k", F.lit(0))
    known = F.col("v").isNotNull()
    s = c.groupBy("_k").agg(
        F.sum("n").alias("total_rows"), count_when(known).alias("unique_values"),
        F.coalesce(F.sum(F.when(~known, F.col("n"))), F.lit(0)).alias("missing_count"),
        F.min_by("v", F.when(known, F.struct(-F.col("n"), F.col("v")))).alias("mode"))
    e = entropy_bits(c, ["_k"])
    return s.join(e, "_k").drop("_k").select(F.lit(col).alias("column"), "*", F.bround(
        pct(F.col("missing_count"), F.col("total_rows")), 2).alias("missing_percentage"))


def numeric_profile(df: DataFrame, cols: list[str], multiplier: float = 1.5) -> DataFrame:
    """Full numeric profile per column: moments with sample-bias correction, quartiles and
    outliers outside the IQR fences."""
    s = numeric_summary(df, [], cols, "linear")
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(c).cast("double").alias("_x")) for c in cols]))
    long = df.select(e.alias("_e")).select("_e.variable", "_e._x")
    n, g1, g2 = F.col("n"), F.col("_sk"), F.col("_ku")
    m = long.groupBy("variable").agg(F.skewness("_x").alias("_sk"), F.kurtosis("_x").alias("_ku"))
    iqr = F.col("q3") - F.col("q1")
    # the fences are scalars here, so the rows are not shuffled by column name
    lim = attach(df, group_quantiles(df, [], {c: {f"_{i}q1": 0.25, f"_{i}q3": 0.75} for i, c in enumerate(cols)}))
    fence = lambda i, side: F.col(f"_{i}{side}") + (multiplier if side == "q3" else -multiplier) * (F.col(f"_{i}q3") - F.col(f"_{i}q1"))
    lim = lim.agg(*[count_when((F.col(c) < fence(i, "q1")) | (F.col(c) > fence(i, "q3"))).alias(f"o{i}") for i, c in enumerate(cols)])
    out = lim.select(F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"o{i}").alias("outlier_count")) for i, c in enumerate(cols)])).alias("r")).select("r.*")
    s = s.join(m, "variable").join(out, "variable")
    return s.withColumns({
        "missing_percentage": F.bround(pct(F.col("missing"), F.col("total_obs")), 2), "iqr": iqr, "range": F.col("max") - F.col("min"),
        "cv": F.when(F.col("mean") != 0, F.col("sd") / F.col("mean") * 100),
        "skewness": F.when(n > 2, g1 * F.sqrt(n * (n - 1)) / (n - 2)),
        "kurtosis": F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)),
        "outlier_percentage": F.bround(pct(F.col("outlier_count"), n), 2)}).drop("_sk", "_ku")


def iqr_outliers(df: DataFrame, keys: list[str], value: str, multiplier: float = 1.5) -> DataFrame:
    """Rows outside the IQR fences of their group."""
    q = group_quantiles(df, keys, {value: {"_q1": 0.25, "_q3": 0.75}})
    iqr = F.col("_q3") - F.col("_q1")
    j = df.join(materialise(q, "fences"), keys) if keys else attach(df, q)
    return j.where((F.col(value) < F.col("_q1") - multiplier * iqr) | (F.col(value) > F.col("_q3") + multiplier * iqr)).drop("_q1", "_q3")


def count_entropy(df: DataFrame, cols: list[str]) -> DataFrame:
    """Entropy of the level counts of each column."""
    e = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit("Missing")).alias("v")) for c in cols]))
    return entropy_bits(df.select(e.alias("_e")).select("_e.*").groupBy("column", "v").agg(F.count(F.lit(1)).alias("n")), ["column"])


def normal_tail(z: Column) -> Column:
    """Upper tail of the standard normal: the series of positive terms of erf for small arguments, the
    continued fraction of erfc for large ones."""
    x = F.abs(z.cast("double")) / F.sqrt(F.lit(2.0))
    near = F.least(x, F.lit(3.0))
    terms = F.aggregate(F.sequence(F.lit(1), F.lit(80)), F.struct(near.alias("t"), near.alias("s")), lambda a, n: F.struct(
        (a["t"] * 2 * near * near / (2 * n + 1)).alias("t"), (a["s"] + a["t"] * 2 * near * near / (2 * n + 1)).alias("s")))["s"]
    far = F.greatest(x, F.lit(2.0))
    fraction = F.aggregate(F.sequence(F.lit(80), F.lit(1), F.lit(-1)), far, lambda a, k: far + k / F.lit(2.0) / a)
    root = F.lit(math.sqrt(math.pi))
    tail = F.when(x < 2.5, 0.5 - terms * F.exp(-near * near) / root).when(x.isNotNull(), F.exp(-far * far) / root / fraction / 2)
    return F.when(z >= 0, tail).otherwise(1 - tail)


# Sizes up to which small samples get exact p-values: cells of the lattice and arrangements that doubles count exactly.
EXACT_CELLS, EXACT_COUNT = 1_000_000, float(1 << 50)


def _running(values: Column, step: Column, width: Column) -> Column:
    """Running sums of an array over every ``step``-th element, by doubling."""
    doublings = F.sequence(F.lit(0), F.ceil(F.log2(F.greatest(width / step, F.lit(1.0)) + 1)).cast("int"))
    return F.aggregate(doublings, values, lambda a, k: F.transform(
        a, lambda x, j: x + F.coalesce(F.get(a, j - (step * F.pow(F.lit(2.0), k)).cast("int")), F.lit(0.0))))


def ks_exact(n1: Column, n2: Column, statistic: Column) -> Column:
    """P(D >= statistic) of equal distributions, for samples of any size: share of the lattice paths from (0, 0) to (n1, n2)
    that leave the band |i / n1 - j / n2| < statistic. A fold goes from one diagonal i + j = t to the next; its array has the
    diagonal's cells in the band, each with the chance that a walk with steps in the ratio n1 : n2 is there and has left the band
    before, and a cell on either side with its whole binomial term, carried as a logarithm. Terms are only added, so small
    shares keep their digits. It visits 2 * statistic * n1 * n2 cells and holds those of one diagonal. Where Serfling's
    bound, summed over the diagonals, puts the share below half of the least double, it is 0."""
    n1, n2 = n1.cast("long"), n2.cast("long")
    both, zero, never = n1 + n2, F.lit(0).cast("long"), F.lit(float("-inf"))
    gap = F.round(statistic * n1 * n2).cast("long")
    edge = F.greatest(gap, zero + 1)
    p, q = n1 / both, n2 / both
    whole = lambda x: F.call_function("div", x, both)
    let = lambda value, body: F.get(F.transform(F.array(value), body), 0)

    def term(i, t, before, moved):
        """Logarithm of the binomial term of cell i on diagonal t; ``before`` is that of the last diagonal, at i - 1 if moved."""
        step = F.when(moved, F.log(t / i * p)).otherwise(F.log(t / (t - i) * q))
        return F.when((i < 0) | (i > t), never).when(i == 0, t * F.log(q)).when(i == t, t * F.log(p)).otherwise(before + step)

    def onward(a, t):
        first = F.greatest(whole(F.greatest(t * n1 - edge + both, zero)), t - n2)
        last = F.least(whole(t * n1 + edge - 1), n1, t)

        def diagonal(d):
            skip, cells = (d["first"] - a["first"]).cast("int") + 1, (d["last"] - d["first"] + 1).cast("int")
            left = F.zip_with(F.slice(a["left"], skip, cells), F.slice(a["left"], skip + 1, cells), lambda x, y: x * d["p"] + y * d["q"])
            return F.struct(d["first"].alias("first"), d["last"].alias("last"), d["low"].alias("low"), d["high"].alias("high"),
                            F.concat(F.array(F.exp(d["low"])), left, F.array(F.exp(d["high"]))).alias("left"))

        return let(F.struct(first.alias("first"), last.alias("last")), lambda d: let(F.struct(
            d["first"].alias("first"), d["last"].alias("last"), p.alias("p"), q.alias("q"),
            term(d["first"] - 1, t, a["low"], d["first"] > a["first"]).alias("low"),
            term(d["last"] + 1, t, a["high"], d["last"] > a["last"]).alias("high")), diagonal))

    start = F.struct(zero.alias("first"), zero.alias("last"), never.alias("low"), never.alias("high"),
                     F.array(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("left"))
    # the last diagonal has one cell in the band, (n1, n2); its binomial term follows from that of its neighbour
    share = let(F.aggregate(F.sequence(zero + 1, both), start, onward), lambda a: F.get(a["left"], 1) * F.exp(-a["low"]) * n2 / (n2 + 1))
    far = 2.0 * edge * edge / both / n1 / (n2 + 1) > 746 + F.log(2.0 * both)
    return F.when(gap <= 0, 1.0).when(far, 0.0).otherwise(F.least(F.lit(1.0), share))


def mann_whitney_exact(n1: Column, n2: Column, u: Column) -> Column:
    """Two-sided p-value of U without ties: numbers of arrangements per U are the coefficients of the Gaussian binomial,
    built by one factor (1 - q^(large + i)) / (1 - q^i) after the other."""
    few, many = F.least(n1, n2).cast("int"), F.greatest(n1, n2).cast("int")
    top = few * many
    one = F.transform(F.sequence(F.lit(0), top), lambda j: F.when(j == 0, 1.0).otherwise(0.0))

    def factor(a, i):
        up = F.transform(a, lambda x, j: x - F.coalesce(F.get(a, j - many - i), F.lit(0.0)))
        return _running(up, i, top.cast("double"))

    ways = F.aggregate(F.sequence(F.lit(1), few), one, factor)
    least = F.least(u, top - u)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    low = total(F.filter(ways, lambda x, j: j <= least))
    return F.least(F.lit(1.0), 2 * low / total(ways))


def arrangements(n1: Column, n2: Column) -> Column:
    """Ways to choose the places of the smaller sample among all, infinite where they pass what is asked for."""
    few, many = F.least(n1, n2), F.greatest(n1, n2)
    steps = F.sequence(F.lit(1).cast("long"), F.greatest(F.least(few, F.lit(1000)), F.lit(1)).cast("long"))
    return F.aggregate(steps, F.lit(1.0), lambda s, i: s * (many + i) / i)


def _two_samples(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    both = a.select(value, F.lit(0).alias("_g")).unionByName(b.select(value, F.lit(1).alias("_g")))
    return both.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("v")).agg(
        count_when(F.col("_g") == 0).alias("n1"), count_when(F.col("_g") == 1).alias("n2")).withColumn("_k", F.lit(0))


def ks_test(a: DataFrame, b: DataFrame, value: str, exact_cells: int | None = 0) -> DataFrame:
    """Largest gap of the two ECDFs; large-sample p-value, or the exact one where n1 * n2 is at most ``exact_cells``
    (0: never, None: whatever the sizes). The alternating series serves large
    arguments, its theta form small ones, where the former needs ever more terms; equal samples have
    p = 1, an empty sample null."""
    if exact_cells is not None and exact_cells > EXACT_CELLS:
        raise ValueError(f"exact_cells is at most {EXACT_CELLS}, or None for all sizes")
    c = _two_samples(a.withColumn(value, F.col(value).cast("double")), b.withColumn(value, F.col(value).cast("double")), value)
    r = (Ordered(c, ["_k"], ["v"], value_slice("v")).cumsum("c1", "n1").cumsum("c2", "n2").total("t1", "n1").total("t2", "n2").apply())
    d = r.groupBy("_k").agg(F.max("t1").alias("n1"), F.max("t2").alias("n2"), F.max(F.abs(
        F.try_divide("c1", "t1") - F.try_divide("c2", "t2"))).alias("statistic")).drop("_k")
    x = F.sqrt(F.col("n1") * F.col("n2") / (F.col("n1") + F.col("n2"))) * F.col("statistic")
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), lambda s, k: s + F.when(k % 2 == 1, 1.0).otherwise(-1.0)
                         * F.exp(-2 * k * k * x * x))
    theta = F.aggregate(F.sequence(F.lit(1), F.lit(20)), F.lit(0.0), lambda s, k: s + F.exp(
        -(2 * k - 1) * (2 * k - 1) * F.lit(math.pi ** 2) / (8 * x * x)))
    p = F.when(x == 0, 1.0).when(x < 1, 1 - F.lit(math.sqrt(2 * math.pi)) / x * theta).when(x.isNotNull(), 2 * series)
    p = F.when(p.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))
    if exact_cells is None or exact_cells:
        exact = (F.col("n1") > 0) & (F.col("n2") > 0)
        if exact_cells is not None:
            exact &= F.col("n1") * F.col("n2") <= exact_cells
        size = lambda c: F.when(exact, F.col(c)).otherwise(1)
        p = F.when(exact, ks_exact(size("n1"), size("n2"), F.col("statistic"))).otherwise(p)
    return d.withColumn("p_value", p)


def mann_whitney(a: DataFrame, b: DataFrame, value: str, exact: int = 0) -> DataFrame:
    """U of the first sample with tie-averaged ranks; normal approximation with tie and
    continuity correction, or the exact p-value where the smaller sample has at most ``exact`` values (0: never), none
    is tied, and the arrangements are few enough to be counted exactly (2^50, n1 * n2 up to a million)."""
    c = _two_samples(a.withColumn(value, F.col(value).cast("double")), b.withColumn(value, F.col(value).cast("double")), value)
    c = c.withColumn("t", F.col("n1") + F.col("n2"))
    r = Ordered(c, ["_k"], ["v"], value_slice("v")).cumsum("_c", "t").apply()
    rank = F.col("_c") - F.col("t") + (F.col("t") + 1) / 2
    t = F.col("t").cast("double")
    s = r.agg(F.sum("n1").alias("n1"), F.sum("n2").alias("n2"), F.sum(F.col("n1") * rank).alias("_r1"), F.sum(t * t * t - t).alias("_tie"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("_r1") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * ((n + 1) - F.try_divide(F.col("_tie"), n * (n - 1))))
    z = F.try_divide(F.greatest(u, n1 * n2 - u) - n1 * n2 / 2 - 0.5, sd)  # null where all values are tied, which tells nothing: p = 1
    p = F.least(F.lit(1.0), 2 * normal_tail(z))
    if exact:
        a1, a2 = F.col("n1"), F.col("n2")
        small = ((F.least(a1, a2) > 0) & (F.least(a1, a2) <= exact) & (F.col("_tie") == 0) & (n1 * n2 <= EXACT_CELLS)
                 & (arrangements(a1, a2) < EXACT_COUNT))
        size = lambda c: F.when(small, c).otherwise(1)
        p = F.when(small, mann_whitney_exact(size(a1), size(a2), u)).otherwise(p)
    return s.withColumns({"statistic": u, "p_value": p}).drop("_r1", "_tie")


def chi_square(a: DataFrame, b: DataFrame, value: str) -> DataFrame:
    """Chi-square of two samples over their categories (Yates correction for two
    categories); the p-value is the closed form for whole degrees of freedom."""
    c = _two_samples(a, b, value).drop("_k")
    t = c.agg(F.sum("n1").alias("t1"), F.sum("n2").alias("t2"), (F.count(F.lit(1)) - 1).cast("int").alias("dof"))
    row = F.col("n1") + F.col("n2")
    term = lambda o, tot: _chi_term(F.col(o), row * F.col(tot) / (F.col("t1") + F.col("t2")))
    s = attach(c, t).groupBy("t1", "t2", "dof").agg(F.sum(term("n1", "t1") + term("n2", "t2")).alias("statistic"))
    half, d = F.col("statistic") / 2, F.col("dof")
    # sum of half^j / Gamma(j + 1), j from 0 or 1/2 in whole steps, by running products
    start = F.when(d % 2 == 0, F.lit(1.0)).otherwise(2 * F.sqrt(half / F.lit(3.141592653589793)))
    base = F.when(d % 2 == 0, 0.0).otherwise(0.5)
    steps = F.when(d >= 2, F.sequence(F.lit(1), F.greatest(F.floor(d / 2).cast("int"), F.lit(1)))).otherwise(F.array().cast("array<int>"))
    acc = F.aggregate(steps, F.struct(F.lit(0.0).alias("s"), start.alias("t")), lambda z, j: F.struct(
        (z["s"] + z["t"]).alias("s"), (z["t"] * half / (j + base)).alias("t")))
    tail = F.when(d % 2 == 0, 0.0).otherwise(2 * normal_tail(F.sqrt(F.col("statistic"))))
    return s.withColumn("p_value", F.when(d > 0, tail + F.exp(-half) * acc["s"]).otherwise(1.0)).select(
        F.col("t1").alias("n1"), F.col("t2").alias("n2"), "dof", "statistic", "p_value")


def _chi_term(o: Column, e: Column) -> Column:
    diff = F.abs(o - e)
    diff = F.when(F.col("dof") == 1, diff - F.least(F.lit(0.5), diff)).otherwise(diff)
    return diff * diff / e


def auto_profile(df: DataFrame, categorical: list[str] | None = None, numeric: list[str] | None = None) -> DataFrame:
    """Kind, rows and headline figures of every column; kind from the type unless given."""
    numbers = ("int", "bigint", "smallint", "tinyint", "double", "float", "decimal")
    num = numeric if numeric is not None else [c for c, t in df.dtypes if t.startswith(numbers)]
    cat = categorical if categorical is not None else [c for c, t in df.dtypes if t == "string" and c not in num]
    parts = []
    if num:
        p = numeric_summary(df, [], num, "linear")
        parts.append(p.select(F.lit("numeric").alias("kind"), F.col("variable").alias("column"), "n", "missing", "mean", "median"))
    if cat:
        c = df.agg(*[x for k in cat for x in (F.count(k).alias(f"{k}__n"), F.countDistinct(k).alias(f"{k}__d"))], F.count(F.lit(1)).alias("_t"))
        parts.append(c.select(F.explode(F.array(*[F.struct(
            F.lit("categorical").alias("kind"), F.lit(k).alias("column"), F.col(f"{k}__n").alias("n"), (F.col("_t") - F.col(f"{k}__n")).alias("missing"),
            F.col(f"{k}__d").alias("levels")) for k in cat])).alias("r")).select("r.*"))
    return union_all(parts)


def missingness(df: DataFrame) -> DataFrame:
    """Missing and complete count per column, one pass."""
    w = df.agg(F.count(F.lit(1)).alias("_t"), *[F.count(F.col(c)).alias(c) for c in df.columns])
    rows = F.array(*[F.struct(F.lit(c).alias("column"), (F.col("_t") - F.col(c)).alias("missing_count"), F.col(c).alias("complete_count"),
                              F.bround(pct(F.col("_t") - F.col(c), F.col("_t")), 2).alias("missing_percent")) for c in df.columns])
    return w.select(F.explode(rows).alias("r")).select("r.*")


def missingness_overview(df: DataFrame) -> DataFrame:
    """Cells and rows: complete, partial and empty."""
    k = len(df.columns)
    miss = sum((F.when(F.col(c).isNull(), 1).otherwise(0) for c in df.columns), F.lit(0))
    r = df.select(miss.alias("_m")).agg(
        F.count(F.lit(1)).alias("total_rows"), F.coalesce(F.sum("_m"), F.lit(0)).alias("missing_cells"), count_when(F.col("_m") == 0).alias("complete_rows"),
        count_when((F.col("_m") > 0) & (F.col("_m") < k)).alias("partial_rows"), count_when(F.col("_m") == k).alias("empty_rows"))
    cells = F.col("total_rows") * k
    return r.withColumns({"total_columns": F.lit(k), "total_cells": cells, "overall_missing_percentage": F.bround(
        F.coalesce(pct(F.col("missing_cells"), cells), F.lit(0.0)), 2)})


def high_missingness(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    m = missingness(df)
    p = pct(F.col("missing_count"), F.col("missing_count") + F.col("complete_count"))
    return m.where(p > threshold).select("column", "missing_count", "missing_percent", F.bround(p - threshold, 2).alias("threshold_exceeded_by"))


def co_missing_pairs(df: DataFrame, minimum: float = 0.8, top: int = 10) -> DataFrame:
    """Column pairs whose missing rows overlap (Jaccard above the minimum). Rows are counted per
    pattern of missing columns first; pairs are made of the patterns, which are few."""
    cols = df.columns
    names = F.array(*[F.lit(c) for c in cols])
    missing = F.array_compact(F.array(*[F.when(F.col(f"`{c}`").isNull(), F.lit(i)) for i, c in enumerate(cols)]))
    patterns = df.groupBy(missing.alias("_p")).agg(F.count(F.lit(1)).alias("n"))
    single = patterns.select(F.explode("_p").alias("i"), "n").groupBy("i").agg(F.sum("n").alias("n"))
    two = F.flatten(F.transform("_p", lambda x: F.transform(F.filter("_p", lambda y: y > x), lambda y: F.struct(x.alias("a"), y.alias("b")))))
    both = patterns.select(F.explode(two).alias("_q"), "n").groupBy("_q.a", "_q.b").agg(F.sum("n").alias("both_missing_count"))
    out = (both.join(single.select(F.col("i").alias("a"), F.col("n").alias("_na")), "a")
           .join(single.select(F.col("i").alias("b"), F.col("n").alias("_nb")), "b")
           .withColumn("jaccard", F.col("both_missing_count") / (F.col("_na") + F.col("_nb") - F.col("both_missing_count")))
           .where(F.col("jaccard") > minimum)
           .select(F.element_at(names, F.col("a") + 1).alias("column1"), F.element_at(names, F.col("b") + 1).alias("column2"), "jaccard",
                   "both_missing_count"))
    return top_k(out.withColumn("jaccard", F.bround("jaccard", 3)), top, [F.desc("jaccard"), F.asc("column1"), F.asc("column2")])


def raw_and_clean(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Numeric summary of each column before and after its outlier range."""
    cols = [c for c in ranges if c in df.columns]
    raw = df.select(F.lit("raw").alias("stage"), *cols)
    clean = null_outliers(df, ranges).select(F.lit("clean").alias("stage"), *cols)
    return numeric_summary(raw.unionByName(clean), ["stage"], cols, "linear")


def by_time_part(df: DataFrame, ts: str, part: str) -> DataFrame:
    """Rows per year or hour of day."""
    f = {"year": F.year, "hour": F.hour}[part]
    return df.where(F.col(ts).isNotNull()).groupBy(f(ts).alias(part)).agg(F.count(F.lit(1)).alias("n"))


def table_info(df: DataFrame, idents: list[str], categories: list[str], ts: str | None = None) -> DataFrame:
    """Rows, columns, distinct ids and categories, first and last year."""
    aggs = [F.count(F.lit(1)).alias("n_rows"), F.lit(len(df.columns)).alias("n_columns")]
    aggs += [F.countDistinct(c).alias(f"unique_{c}") for c in [*idents, *categories] if c in df.columns]
    if ts:
        aggs += [F.year(F.min(ts)).alias("first_year"), F.year(F.max(ts)).alias("last_year")]
    return df.agg(*aggs)


def panel(bins: DataFrame, curves: DataFrame, metric: str, stratum: str) -> DataFrame:
    """Bins and ECDF of one metric for a stratum and its sub-strata, stacked with a kind."""
    mine = (F.col("metric") == metric) & ((F.col("stratum") == stratum) | F.col("stratum").startswith(f"{stratum}/"))
    return union_all([bins.where(mine).withColumn("kind", F.lit("bins")), curves.where(mine).withColumn("kind", F.lit("ecdf"))])
