"""Respiratory support: inference, fills, ventilation features, ratios and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import (attach, Z95, any_flag, count_when, days_between, first_by, flag, hours_between, lookup,
                                    micros, norm, pct, union_all)
from bedside.functions.ordered import Ordered, value_slice
from bedside.functions.quantiles import with_quantiles
from bedside.operators import temporal
from bedside.operators.clean import mode_group, stack
from bedside.sources.tables import materialise
from bedside.operators.cohort import ALWAYS_DEVICES, FLOW_MIN, support_rule

BLOCK = "encounter_block"
# Device severity, 1 is worst; unknown devices rank 9.
DEVICE_RANK = {"imv": 1, "nippv": 2, "cpap": 3, "high flow nc": 4, "face mask": 5, "trach collar": 6,
               "nasal cannula": 7, "other": 8, "room air": 9}
# Inspired oxygen by nasal cannula flow (litres per minute).
CANNULA_FIO2 = {1: 0.24, 2: 0.28, 3: 0.32, 4: 0.36, 5: 0.40, 6: 0.44, 7: 0.48, 8: 0.52, 9: 0.56, 10: 0.60}
# Mode patterns that imply a device, and limits of the ratios.
IMV_MODES = "(assist control-volume control|simv|pressure control)"
PF_CAP, SPO2_LOW, SPO2_HIGH, FIO2_LOW, FIO2_HIGH = 600.0, 50.0, 97.0, 0.21, 1.0
VOLUME_MODES = ["assist control-volume control", "pressure-regulated volume control"]


def infer_device(resp: DataFrame) -> DataFrame:
    """Missing device from the mode; missing FiO2 from room air or cannula flow."""
    mode = F.lower(F.col("mode_category"))
    device = (F.when(F.col("device_category").isNull() & mode.rlike(IMV_MODES), "imv")
              .when(F.col("device_category").isNull() & mode.contains("pressure support") & ~mode.contains("cpap"), "nippv")
              .otherwise(F.col("device_category")))
    out = resp.withColumn("device_category", device)
    d = norm("device_category")
    fio2 = F.when(F.col("fio2_set").isNull() & (d == "room air"), F.lit(0.21))
    if "lpm_set" in resp.columns:
        flow = F.bround(F.col("lpm_set"), 0).cast("int")
        fio2 = fio2.when(F.col("fio2_set").isNull() & (d == "nasal cannula"), lookup(flow, CANNULA_FIO2))
    return out.withColumn("fio2_set", fio2.otherwise(F.col("fio2_set")))


def fill_and_number(resp: DataFrame, order: list[str], keys: list[str] | None = None) -> DataFrame:
    """Device and mode carried forward, then nested device / mode episode numbers."""
    return waterfall(resp, order, [], keys, infer=False)


def waterfall(resp: DataFrame, order: list[str], cols: list[str], keys: list[str] | None = None, infer: bool = True) -> DataFrame:
    """Inference, device/mode fill, episode numbers and settings carried forward inside the
    mode episode. Two ordered passes: the first sees each row's own and previous filled
    device and mode, the second numbers the changes and fills the settings, where a change
    row without a value resets the fill."""
    keys = keys or [BLOCK]
    src = infer_device(resp) if infer else resp
    d, m = "device_category", "mode_category"
    p = (Ordered(src, keys, order).fill("_d", d).fill("_m", m).fill_before("_pd", d).fill_before("_pm", m).row_number("_n").apply())
    p = materialise(p.withColumns({d: F.col("_d"), m: F.col("_m")}).drop("_d", "_m"), "filled")
    # an unknown device or mode becoming known is no change
    differs = lambda a, b: F.coalesce(F.col(a) != F.col(b), F.lit(False))
    device = (F.col("_n") == 1) | differs(d, "_pd")
    mode = device | differs(m, "_pm")
    o = Ordered(p, keys, order).cumsum("device_cat_id", device.cast("long")).cumsum("mode_cat_id", mode.cast("long"))
    for c in cols:
        o.fill(f"_f_{c}", F.when(F.col(c).isNotNull() | mode, F.struct(F.col(c).alias("v"))))
    out = o.apply()
    return out.withColumns({c: F.col(f"_f_{c}.v") for c in cols}).drop("_pd", "_pm", "_n", *[f"_f_{c}" for c in cols])


def windowed_fio2(resp: DataFrame, windows: DataFrame, order: list[str], lookback_hours: float = 24,
                  start: str = "start_dttm", end: str = "end_dttm") -> DataFrame:
    """Fill with a look-back before each window, then cut to the window itself."""
    wide = windows.withColumn("_from", F.timestamp_micros(micros(start) - F.lit(int(lookback_hours * 3_600_000_000))))
    rows = temporal.interval_join(resp, wide, [BLOCK], order[0], "_from", end)
    filled = waterfall(rows, order, ["fio2_set"], [BLOCK, start])
    return filled.where(F.col(order[0]) >= F.col(start)).drop("_from")


def qualifying_encounters(resp: DataFrame, block: str = BLOCK) -> DataFrame:
    """Encounters with an advanced device or a mode that implies one."""
    cond = norm("device_category").isin([*ALWAYS_DEVICES, "high flow nc"])
    if "mode_category" in resp.columns:
        cond = cond | F.coalesce(F.lower("mode_category").rlike(IMV_MODES), F.lit(False))
    return resp.where(cond).select(block).distinct()


def device_rank(device: str) -> Column:
    return lookup(norm(device), DEVICE_RANK, 9)


def is_imv(device: str = "device_category") -> Column:
    return F.coalesce(F.lower(F.col(device)).contains("imv"), F.lit(False))


def vent_span(resp: DataFrame, block: str = BLOCK, threshold: float = FLOW_MIN) -> DataFrame:
    """Ventilation start / end, on_vent and the first non-invasive device."""
    ts = F.col("recorded_dttm")
    ni = support_rule(resp, ["nippv", "cpap"], threshold=threshold)
    return resp.groupBy(block).agg(
        F.min(F.when(is_imv(), ts)).alias("vent_start_time"), F.max(F.when(is_imv(), ts)).alias("vent_end_time"),
        any_flag(is_imv()).alias("on_vent"), F.min(F.when(ni, ts)).alias("ni_device_start_dttm"))


def imv_hours(resp: DataFrame, order: list[str], block: str = BLOCK) -> DataFrame:
    """Hours on IMV: a row's device holds until the next row."""
    r = Ordered(resp, [block], order).lead("_next", "recorded_dttm").apply()
    return r.where(is_imv()).groupBy(block).agg(
        F.coalesce(F.sum(hours_between("recorded_dttm", "_next")), F.lit(0.0)).alias("vent_duration_hours"))


def initial_mode(resp: DataFrame, order: list[str], block: str = BLOCK) -> DataFrame:
    """First known mode at or after ventilation start, else 'Missing'."""
    start = resp.where(is_imv()).groupBy(block).agg(F.min("recorded_dttm").alias("_start"))
    rows = resp.join(start, block).where(F.col("recorded_dttm") >= F.col("_start"))
    known = F.col("mode_category").isNotNull()
    key = F.when(known, F.struct(*order))
    return rows.groupBy(block).agg(F.coalesce(F.min_by("mode_category", key), F.lit("Missing")).alias("initial_mode_category"))


def after_vent_start(resp: DataFrame, block: str = BLOCK) -> DataFrame:
    """IMV rows with hours since ventilation start, never before it."""
    start = resp.where(is_imv()).groupBy(block).agg(F.min("recorded_dttm").alias("vent_start_time"))
    r = resp.where(is_imv()).join(start, block).withColumn(
        "hours_from_vent_start", hours_between("vent_start_time", "recorded_dttm"))
    return r.where("hours_from_vent_start >= 0")


def tube_events(resp: DataFrame, order: list[str], block: str = BLOCK) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(intubations, extubations, first row per ventilated encounter). An intubation is two
    rows off, this row on, two rows on; an extubation is the mirror and is timed at the next
    row. A missing neighbour never matches."""
    r = resp.select(block, *order, "device_category").withColumn("_on", is_imv().cast("int"))
    r = (Ordered(r, [block], order).lag("_b2", "_on", 2).lag("_b1", "_on").lead("_a1", "_on").lead("_a2", "_on", 2)
         .lead("_next", "recorded_dttm").apply())
    r = materialise(r.drop("device_category"), "tube")
    ventilated = r.where("_on = 1").select(block).distinct()
    up = r.where("_b2 = 0 and _b1 = 0 and _on = 1 and _a1 = 1 and _a2 = 1").select(
        block, F.col("recorded_dttm").alias("intubation_start_dttm"), F.col(order[-1]).alias("_tie"))
    down = r.where("_b2 = 1 and _b1 = 1 and _on = 1 and _a1 = 0 and _a2 = 0").select(
        block, F.col("_next").alias("extubation_end_dttm"), F.col(order[-1]).alias("_tie"))
    first = first_by(r, [block], order, ["recorded_dttm", "_on", order[-1]]).join(ventilated, block, "left_semi")
    return up, down, first.select(block, F.col("recorded_dttm").alias("first_dttm"), F.col("_on").alias("first_is_imv"),
                                  F.col(order[-1]).alias("_tie"))


def pair_next_after(starts: DataFrame, ends: DataFrame, keys: list[str], start: str, end: str, tie: str) -> DataFrame:
    """``starts`` with the first later end, in one ordered pass over both. A start that another start follows
    before any end was never seen to end and gets null; an end that no open start precedes is left out, so one
    missed event touches one pair only. At one instant ends come first: an end is later than its start."""
    s = starts.select(*keys, F.col(start).alias("_t"), F.lit(1).alias("_side"), F.col(tie).alias("_u"),
                      F.struct(*[F.col(c) for c in starts.columns if c not in keys]).alias("_s"))
    e = ends.select(*keys, F.col(end).alias("_t"), F.lit(0).alias("_side"), F.col(tie).alias("_u"))
    both = s.unionByName(e, allowMissingColumns=True)
    rows = Ordered(both, keys, ["_t", "_side", "_u"]).lead("_next", F.struct("_side", "_t")).apply().where("_side = 1")
    return rows.select(*keys, "_s.*", F.when(F.col("_next._side") == 0, F.col("_next._t")).alias(end))


def imv_episodes(resp: DataFrame, order: list[str], block: str = BLOCK, failed_minutes: float = 5, events: tuple | None = None,
                 pairing: str = "ordinal") -> DataFrame:
    """All ventilation attempts: n-th intubation with n-th extubation, or with ``pairing='next_after'`` each
    intubation with the extubation that follows it. An encounter that
    begins on IMV gets a start at its first row when no intubation was seen or an extubation
    comes first. Failed attempts are flagged and the real ones renumbered (0 for failed)."""
    if pairing not in ("ordinal", "next_after"):
        raise ValueError(f"unknown pairing {pairing}")
    up, down, first = events or tube_events(resp, order, block)
    fu = up.groupBy(block).agg(F.min("intubation_start_dttm").alias("_fu"))
    fd = down.groupBy(block).agg(F.min("extubation_end_dttm").alias("_fd"))
    synth = (first.where("first_is_imv = 1").join(fu, block, "left").join(fd, block, "left")
             .where(F.col("_fu").isNull() | (F.col("_fd") <= F.col("_fu")))
             .select(block, F.col("first_dttm").alias("intubation_start_dttm"), "_tie", F.lit(True).alias("is_synthetic")))
    starts = up.withColumn("is_synthetic", F.lit(False)).unionByName(synth)
    if pairing == "next_after":
        ep = pair_next_after(starts, down, [block], "intubation_start_dttm", "extubation_end_dttm", "_tie").withColumnRenamed("_tie", "_n")
    else:
        starts = Ordered(starts, [block], ["intubation_start_dttm", "_tie"]).row_number("_n").apply().drop("_tie")
        ends = Ordered(down, [block], ["extubation_end_dttm", "_tie"]).row_number("_n").apply().drop("_tie")
        ep = starts.join(ends, [block, "_n"], "left")
    ep = ep.withColumn("episode_duration_hours", hours_between("intubation_start_dttm", "extubation_end_dttm"))
    ep = ep.withColumn("is_failed_attempt", F.coalesce(F.col("episode_duration_hours") * 60 < failed_minutes, F.lit(False)))
    real = F.when(~F.col("is_failed_attempt"), F.lit(1).cast("long"))
    ep = materialise(ep, "episodes")
    ep = Ordered(ep, [block], ["intubation_start_dttm", "_n"]).cumsum("episode_n", real).apply()
    return ep.withColumn("episode_n", F.when(F.col("is_failed_attempt"), 0).otherwise(F.col("episode_n"))).drop("_n")


def extubation_summary(resp: DataFrame, enc: DataFrame, order: list[str], block: str = BLOCK,
                       failed_minutes: float = 5, admit_hours: float = 24, pairing: str = "ordinal", events: tuple | None = None) -> DataFrame:
    """One row per ventilated encounter: first episode, reintubation, 48 h failure, status. ``events`` are those of
    ``tube_events``, where they are there already."""
    events = events or tube_events(resp, order, block)
    ep = imv_episodes(resp, order, block, failed_minutes, events, pairing)
    nth = lambda n, c: F.max(F.when(F.col("episode_n") == n, F.col(c)))
    per = ep.groupBy(block).agg(
        nth(1, "intubation_start_dttm").alias("intubation_start_dttm"), nth(1, "extubation_end_dttm").alias("extubation_end_dttm"),
        nth(2, "intubation_start_dttm").alias("reintubation_dttm"),
        count_when(F.col("episode_n") > 0).alias("imv_episodes_n"), any_flag(F.col("is_failed_attempt")).alias("_failed"))
    first = events[2]
    info = first_by(enc, [block], ["admission_dttm"], ["admission_dttm", "discharge_dttm", "death_enc"])
    d = first.join(per, block, "left").join(info, block, "left")
    out = F.col("extubation_end_dttm")
    pre = F.col("first_is_imv")
    re_h = hours_between(out, "reintubation_dttm")
    adm_h = hours_between("admission_dttm", "intubation_start_dttm")
    n = F.coalesce(F.col("imv_episodes_n"), F.lit(0))
    status = (F.when((n == 0) & (F.col("_failed") == 1), "failed_attempt")
              .when(out.isNotNull(), "extubated").when(F.col("death_enc") == 1, "death_on_imv")
              .when(F.col("discharge_dttm").isNotNull(), "discharged_on_imv").otherwise("unknown"))
    return d.select(
        block, "intubation_start_dttm", "extubation_end_dttm",
        F.when(pre == 0, hours_between("intubation_start_dttm", out)).alias("time_to_extubation_hours"),
        "reintubation_dttm", re_h.alias("time_to_reintubation_hours"),
        F.when(out.isNotNull(), flag(re_h <= 48)).alias("extubation_failure_48hr"),
        n.alias("imv_episodes_n"), pre.alias("pre_admission_imv"),
        flag((pre == 0) & (adm_h <= admit_hours) & (adm_h >= -1)).alias("intubated_within_24hr_admit"),
        status.alias("extubation_status"))


def window_end(start: str, days: int) -> Column:
    return F.timestamp_micros(micros(start) + F.lit((days - 1) * 86_400_000_000))


def device_cover(resp: DataFrame, enc: DataFrame, on: Column, start: str, order: list[str], block: str = BLOCK, days: int = 28) -> DataFrame:
    """Time on a device inside the window per encounter: runs, hours, and the end of the last run. A row holds until the next
    row, the last one until discharge; what reaches over the window is clipped to it and overlapping pieces are
    merged, so a device that is on at the window's border is on, with or without a row behind it."""
    e = enc.where(F.col(start).isNotNull()).select(block, "discharge_dttm", F.col(start).alias("_wstart"), window_end(start, days).alias("_wend"))
    r = resp.withColumn("_on", flag(on)).select(block, *order, "_on")
    r = Ordered(r, [block], order).lead("_next", "recorded_dttm").apply().where("_on = 1").join(e, block)
    held = F.greatest("recorded_dttm", F.coalesce("_next", "discharge_dttm", "recorded_dttm"))
    r = r.select(block, F.greatest("recorded_dttm", "_wstart").alias("_from"), F.least(held, F.col("_wend")).alias("_to"))
    runs = temporal.interval_union(r, [block], "_from", "_to")
    return runs.groupBy(block).agg(F.count(F.lit(1)).alias("device_runs"), F.sum(hours_between("_from", "_to")).alias("device_hours"),
                                   F.max("_to").alias("last_device_end"))


def device_free_days(resp: DataFrame, enc: DataFrame, on: Column, start: str, order: list[str], out: str,
                     block: str = BLOCK, days: int = 28, interval_mode: bool = False) -> DataFrame:
    """Free days in a window that opens at the first device row. Death in the window gives
    0, no device end in the window gives all days, still on at its end gives 0, otherwise
    whole calendar days from the last device end. An episode ends where the next row is off
    the device; a run with no end seen inside the window is not counted (known limitation,
    kept on purpose). ``interval_mode`` takes the last end from ``device_cover`` instead, which has that run."""
    e = enc.where(F.col(start).isNotNull()).withColumn("_wend", window_end(start, days))
    if interval_mode:
        last = device_cover(resp, enc, on, start, order, block, days).select(block, F.col("last_device_end").alias("_last"))
    else:
        r = resp.withColumn("_on", flag(on))
        r = Ordered(r, [block], order).lead("_next_on", "_on").lead("_next", "recorded_dttm").apply()
        ends = r.where((F.col("_on") == 1) & (F.coalesce(F.col("_next_on"), F.lit(0)) == 0)).select(block, "recorded_dttm", "_next")
        ends = ends.join(e.select(block, "discharge_dttm", "_wend"), block).where(F.col("recorded_dttm") <= F.col("_wend"))
        last = ends.groupBy(block).agg(F.max(F.least(F.coalesce("_next", "discharge_dttm", "recorded_dttm"), "_wend")).alias("_last"))
    death = F.coalesce(F.col("death_dttm"), F.when(F.col("death_enc") == 1, F.col("discharge_dttm")))
    value = (F.when(death <= F.col("_wend"), 0).when(F.col("_last").isNull(), days).when(F.col("_last") >= F.col("_wend"), 0)
             .otherwise(F.datediff("_wend", "_last")))
    return e.join(last, block, "left").select(block, value.alias(out))


def ventilator_free_days(resp: DataFrame, enc: DataFrame, order: list[str], block: str = BLOCK, interval_mode: bool = False) -> DataFrame:
    return device_free_days(resp, enc.where("on_vent = 1"), is_imv(), "vent_start_dttm", order, "vfd_28", block, interval_mode=interval_mode)


def noninvasive_free_days(resp: DataFrame, enc: DataFrame, order: list[str], block: str = BLOCK,
                          threshold: float = FLOW_MIN, devices: list[str] | None = None, interval_mode: bool = False) -> DataFrame:
    on = support_rule(resp, ["nippv", "cpap"] if devices is None else [d.lower() for d in devices], threshold=threshold)
    return device_free_days(resp, enc.where("nippv_hfnc_enc = 1"), on, "ni_device_start_dttm", order, "nidfd_28", block, interval_mode=interval_mode)


def kaplan_meier(subjects: DataFrame, stratum: str = "stratum", duration: str = "duration", event: str = "event",
                 limit: float | None = None) -> DataFrame:
    """Survival curve per stratum with the 95 % log-log Greenwood band. Durations beyond
    ``limit`` are censored there; time 0 is always present; bounds are 1 while S = 1 and 0
    once S = 0."""
    d, e = F.col(duration).cast("double"), F.col(event).cast("long")
    s = subjects.where(d.isNotNull() & (d >= 0))
    if limit is not None:
        s = s.withColumns({event: F.when(d > limit, 0).otherwise(e), duration: F.least(d, F.lit(float(limit)))})
    per = s.groupBy(stratum, F.col(duration).cast("double").alias("t")).agg(
        F.sum(F.col(event).cast("long")).alias("d"), F.count(F.lit(1)).alias("x"))
    zero = per.select(stratum).distinct().select(stratum, F.lit(0.0).alias("t"), F.lit(0).cast("long").alias("d"),
                                                 F.lit(0).cast("long").alias("x"))
    per = materialise(per.unionByName(zero).groupBy(stratum, "t").agg(F.sum("d").alias("d"), F.sum("x").alias("x")), "exits")
    c = Ordered(per, [stratum], ["t"], value_slice("t")).cumsum("_gone", "x").total("_n", "x").apply()
    n = F.col("_n") - F.col("_gone") + F.col("x")
    c = c.withColumns({"at_risk": n,
                       "_log": F.when(F.col("d") < n, F.log(1 - F.col("d") / n)).otherwise(F.lit(0.0)),
                       "_var": F.when(F.col("d") < n, F.col("d") / (n * (n - F.col("d")))).otherwise(F.lit(0.0)),
                       "_dead": flag((F.col("d") >= n) & (F.col("d") > 0)).cast("long")})
    c = Ordered(materialise(c, "risk"), [stratum], ["t"], value_slice("t")).cumsum("_ls", "_log").cumsum("_v", "_var").cumsum("_z", "_dead").apply()
    theta = F.lit(Z95) * F.sqrt("_v") / F.col("_ls")
    bound = lambda sign: (F.when(F.col("_z") > 0, 0.0).when(F.col("_ls") == 0, 1.0)
                          .otherwise(F.exp(-F.exp(F.log(-F.col("_ls")) - sign * theta))))
    return c.select(stratum, F.col("t").alias("timeline"), F.when(F.col("_z") > 0, 0.0).otherwise(F.exp("_ls")).alias("survival_prob"),
                    bound(1).alias("ci_lower"), bound(-1).alias("ci_upper"), "at_risk", F.col("d").alias("observed_events"))


def time_to_extubation_subjects(per_enc: DataFrame, max_days: float = 28) -> DataFrame:
    """Survival input per stratum: hours to extubation, censored at death or discharge;
    encounters ventilated before admission are left out."""
    d = per_enc.where((F.col("pre_admission_imv") == 0) & F.col("intubation_start_dttm").isNotNull())
    ev = flag(F.col("extubation_status") == "extubated")
    end = F.when(ev == 1, F.col("extubation_end_dttm")).otherwise(F.coalesce("death_dttm", "discharge_dttm"))
    d = d.withColumns({"event": ev, "duration": days_between("intubation_start_dttm", end)})
    d = d.where(F.col("duration") >= 0).withColumns({
        "event": F.when(F.col("duration") > max_days, 0).otherwise(F.col("event")),
        "duration": F.least(F.col("duration"), F.lit(float(max_days)))})
    strata = F.array(F.lit("overall"), F.when(F.col("high_support_icu_enc") == 1, "icu"),
                     F.when(F.col("high_support_no_icu_enc") == 1, "no_icu"))
    return d.withColumn("stratum", F.explode(F.array_compact(strata)))


def concurrent_ratio(measures: DataFrame, resp: DataFrame, keys: list[str], value: str, measure_ts: str, out: str,
                     resp_ts: str = "recorded_dttm", tolerance_minutes: float = 240, carry: list[str] | None = None,
                     fio2_range: tuple[float, float] | None = None) -> DataFrame:
    """value / FiO2 with the latest respiratory row at or before the measurement, within the
    tolerance. A latest row without a usable FiO2 gives no ratio; an older one isn't used instead."""
    cols = ["fio2_set", *(["device_category"] if carry is None else carry)]
    right = resp.select(*keys, F.col(resp_ts).alias("_resp_ts"), *cols)
    j = temporal.asof_join(measures, right, keys, measure_ts, "_resp_ts", cols, tolerance_minutes)
    usable = F.col("fio2_set") > 0 if fio2_range is None else F.col("fio2_set").between(*fio2_range)
    return j.withColumn(out, F.when(usable, F.try_divide(F.col(value), F.col("fio2_set")))).where(F.col(out).isNotNull())


def pf_ratio(labs: DataFrame, resp: DataFrame, keys: list[str], ts: str, po2: str = "po2_arterial") -> DataFrame:
    return concurrent_ratio(labs, resp, keys, po2, ts, "concurrent_pf")


def sf_ratio(vitals: DataFrame, resp: DataFrame, keys: list[str], ts: str, spo2: str = "spo2") -> DataFrame:
    """SpO2 / FiO2 for SpO2 50-97 and FiO2 0.21-1.0 only."""
    ok = F.col(spo2).between(SPO2_LOW, SPO2_HIGH)
    return concurrent_ratio(vitals.where(ok), resp, keys, spo2, ts, "concurrent_sf", fio2_range=(FIO2_LOW, FIO2_HIGH))


def failure_onset(resp: DataFrame, cohort: DataFrame | None = None, block: str = BLOCK, tie: str = "event_id",
                  carry: list[str] | None = None) -> DataFrame:
    """Earliest qualifying device row per encounter."""
    r = resp if cohort is None else resp.join(cohort.select(block).distinct(), block, "left_semi")
    cols = ["recorded_dttm", "device_category", *(carry or [])]
    q = first_by(r.where(support_rule(r, ALWAYS_DEVICES)), [block], ["recorded_dttm", tie], cols)
    return q.withColumnsRenamed({"recorded_dttm": "onset_dttm", "device_category": "onset_device"})


def _worst(df, block, ratio, ts, stem, tie):
    key = F.struct(ratio, ts, tie)
    return with_quantiles(df, [block], [
        F.min(ratio).alias(f"{stem}_24_min"), F.avg(ratio).alias(f"{stem}_24_mean"), F.count(ratio).alias(f"n_{stem}_measurements"),
        F.min_by("device_category", key).alias(f"device_at_worst_{stem}"),
        F.min_by("hours_from_onset", key).alias(f"hours_to_worst_{stem}"), F.min_by(ts, key).alias(f"_worst_{stem}_dttm")],
        {ratio: {f"{stem}_24_median": 0.5}})


def oxygenation_summary(onset: DataFrame, pf: DataFrame, sf: DataFrame, pf_ts: str, sf_ts: str, block: str = BLOCK,
                        hours: float = 24, near_hours: float = 4, tie: str = "event_id") -> DataFrame:
    """First-day P/F and S/F per encounter after onset. P/F of 600 and more is dropped."""
    def day_one(d, ts):
        d = d.join(onset.select(block, "onset_dttm"), block).withColumn("hours_from_onset", hours_between("onset_dttm", ts))
        return d.where(F.col("hours_from_onset").between(0, hours))
    # both feed several aggregates; the as-of joins behind them run once
    p = materialise(day_one(pf, pf_ts).where(F.col("concurrent_pf") < PF_CAP), "pf")
    s = materialise(day_one(sf, sf_ts), "sf")
    pa, sa = _worst(p, block, "concurrent_pf", pf_ts, "pf", tie), _worst(s, block, "concurrent_sf", sf_ts, "sf", tie)
    near = s.join(pa.select(block, "_worst_pf_dttm"), block).withColumn("_gap", F.abs(micros(sf_ts) - micros("_worst_pf_dttm")))
    near = first_by(near.where(F.col("_gap") <= F.lit(int(near_hours * 3_600_000_000))), [block], ["_gap", sf_ts, tie],
                    ["concurrent_sf", "spo2", "fio2_set"])
    near = near.withColumnsRenamed({"concurrent_sf": "sf_contemporary_to_pf", "spo2": "sf_contemporary_spo2",
                                    "fio2_set": "sf_contemporary_fio2"})
    out = (onset.join(pa.drop("_worst_pf_dttm"), block, "left").join(sa.drop("_worst_sf_dttm"), block, "left")
           .join(near, block, "left"))
    has_p, has_s = F.col("pf_24_min").isNotNull(), F.col("sf_24_min").isNotNull()
    return out.withColumn("exposure_group", F.when(has_p & has_s, "sf_pf").when(has_p, "pf_only").when(has_s, "sf_only")
                          .otherwise("undefined_oxygenation"))


OXY_METRICS = ["pf_24_min", "pf_24_mean", "pf_24_median", "sf_24_min", "sf_24_mean", "sf_24_median", "sf_contemporary_to_pf",
               "hours_to_worst_pf", "hours_to_worst_sf"]


def oxygenation_statistics(per_enc: DataFrame, metrics: list[str] | None = None, device: str = "onset_device") -> DataFrame:
    """n, mean, sd and quartiles per metric, overall and per onset device, plus group sizes."""
    both = per_enc.withColumn("stratum", F.explode(F.array(F.lit("Overall"), F.concat(F.lit("device:"), F.col(device)))))
    long = stack(both.where("stratum is not null"), ["stratum"], metrics or OXY_METRICS, "variable")
    stats = with_quantiles(long, ["variable", "stratum"], [
        F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd")],
        {"value": {"median": 0.5, "q25": 0.25, "q75": 0.75}})
    groups = per_enc.groupBy(F.lit("exposure_group_count").alias("variable"), F.col("exposure_group").alias("stratum")).agg(
        F.count(F.lit(1)).alias("n"))
    return union_all([stats, groups])


def daily_minimum(ratios: DataFrame, starts: DataFrame, keys: list[str], ratio: str, ts: str, start: str, days: int = 28,
                  cap: float | None = None) -> DataFrame:
    """Lowest ratio per encounter and day after intubation, then its quartiles per day. The
    cap clips (it does not drop)."""
    v = F.least(F.col(ratio), F.lit(float(cap))) if cap is not None else F.col(ratio)
    day = F.floor(days_between(start, ts)).cast("int")
    m = ratios.where(F.col(ratio).isNotNull()).join(starts.select(*keys, start), keys).withColumns({"day": day, "_v": v})
    daily = m.where((F.col("day") >= 0) & (F.col("day") < days)).groupBy(*keys, "day").agg(F.min("_v").alias("_v"))
    daily = materialise(daily, "daily")
    return with_quantiles(daily, ["day"], [F.count("_v").alias("n")], {"_v": {"median": 0.5, "q1": 0.25, "q3": 0.75}})


def setting_statistics(resp: DataFrame, settings: list[str], keys: list[str]) -> DataFrame:
    """Median, quartiles, mean, sd and count of every setting per group; groups with a null
    key are left out."""
    present = [s for s in settings if s in resp.columns]
    known = resp
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    aggs = [a for s in present for a in (F.avg(s).alias(f"{s}_mean"), F.stddev_samp(s).alias(f"{s}_sd"), F.count(s).alias(f"{s}_n"))]
    return with_quantiles(known, keys, aggs, {s: {f"{s}_median": 0.5, f"{s}_q1": 0.25, f"{s}_q3": 0.75} for s in present})


def setting_text(stats: DataFrame, settings: list[str], keys: list[str]) -> DataFrame:
    """Cells like '5.0 (4.0-8.0)', one decimal, half to even."""
    one = lambda c: F.format_string("%.1f", F.bround(F.col(c), 1))
    return stats.select(*keys, *[F.when(F.col(f"{s}_median").isNotNull(), F.concat(
        one(f"{s}_median"), F.lit(" ("), one(f"{s}_q1"), F.lit("-"), one(f"{s}_q3"), F.lit(")"))).alias(s) for s in settings])


def observation_share(resp: DataFrame, settings: list[str]) -> DataFrame:
    """Share of all observations in each device x mode x setting cell."""
    keys = ["device_category", "mode_category"]
    valid = resp.where("device_category is not null and mode_category is not null")
    counts = valid.groupBy(*keys).agg(*[F.count(s).alias(s) for s in settings], F.count(F.lit(1)).alias("_rows"))
    cells = stack(counts, keys, settings, "setting", "n").withColumn("n", F.col("n").cast("long"))
    total = counts.agg(F.sum("_rows").alias("total"))
    return attach(cells, total).withColumn("pct", pct(F.col("n"), F.col("total")))


def hourly_setting(post_start: DataFrame, setting: str, modes: list[str], max_hour: int = 168, minimum: int = 10,
                   keys: list[str] | None = None) -> DataFrame:
    """Setting by rounded hour since ventilation start, hours with enough values."""
    d = (post_start.where(F.col("mode_category").isin(modes))
         .withColumn("hour_bin", F.bround("hours_from_vent_start", 0).cast("int")).where(F.col("hour_bin") <= max_hour))
    s = with_quantiles(d, [*(keys or []), "hour_bin"], [F.avg(setting).alias("mean"), F.stddev_samp(setting).alias("std"),
                                         F.count(setting).alias("count")],
                       {setting: {"median": 0.5, "q25": 0.25, "q75": 0.75}})
    return s.where(F.col("count") >= minimum)


def mode_proportions(post_start: DataFrame, hours: float = 24, keys: list[str] | None = None) -> DataFrame:
    """Share of each mode group in the first hours of ventilation."""
    keys = keys or []
    d = post_start.where(F.col("hours_from_vent_start").between(0, hours)).withColumn("mode_group", mode_group("mode_category"))
    c = d.groupBy(*keys, "mode_group").agg(F.count(F.lit(1)).alias("count"))
    t = c.groupBy(*keys).agg(F.sum("count").alias("_t"))
    c = c.join(t, keys) if keys else attach(c, t)
    return c.withColumn("proportion", F.col("count") / F.col("_t")).drop("_t")


def device_stay(enc: DataFrame, onset: DataFrame, keys: list[str] | None = None, block: str = BLOCK) -> DataFrame:
    """Encounters with a device onset and the stay before and after it."""
    keys = keys or []
    d = enc.join(onset.select(block, "onset_dttm"), block, "left").withColumns({
        "pre": days_between("admission_dttm", "onset_dttm"), "post": days_between("onset_dttm", "discharge_dttm")})
    return with_quantiles(d, keys, [F.count(F.lit(1)).alias("n_total"), F.count("onset_dttm").alias("n_onset")], {
        "pre": {"pre_median": 0.5, "pre_q1": 0.25, "pre_q3": 0.75}, "post": {"post_median": 0.5, "post_q1": 0.25, "post_q3": 0.75}})


def time_to_target(df: DataFrame, block: str = BLOCK, flag_col: str = "vaso_ed_icu_enc", pressor: str = "first_pressor_admin_dttm",
                   target: str = "first_icu_in_dttm", out: str = "time_to_icu_hours") -> DataFrame:
    """Hours from the first vasopressor to the target location; both times needed, negative
    values stay."""
    return df.where((F.col(flag_col) == 1) & F.col(pressor).isNotNull() & F.col(target).isNotNull()).select(
        block, hours_between(pressor, target).alias(out))


def summarize_hours(df: DataFrame, value: str = "time_to_icu_hours", keys: list[str] | None = None) -> DataFrame:
    return with_quantiles(df, keys or [], [
        F.count(value).alias("n"), count_when(F.col(value) < 0).alias("n_negative"), F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("sd")], {value: {"median": 0.5, "q1": 0.25, "q3": 0.75}})
