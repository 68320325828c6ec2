"""Locations over time: length of stay, ICU episodes, journeys, dwell and capture."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import attach, any_flag, days_between, flag, hours_between, norm, pct
from bedside.functions.ordered import Ordered
from bedside.functions.quantiles import group_quantiles, with_quantiles
from bedside.operators import temporal
from bedside.operators.clean import simple_location
from bedside.sources.tables import materialise

BLOCK = "encounter_block"
# Locations between two ICU rows that make the second a new episode.
NEW_EPISODE = ["ward", "stepdown", "l&d", "hospice", "psych", "rehab", "other"]


def hospital_stay(adt: DataFrame, block: str = BLOCK, location: str = "location_category", start: str = "in_dttm",
                  end: str = "out_dttm", tie: str | None = None) -> DataFrame:
    """Length of stay in days and the earliest location."""
    key = F.struct(*[c for c in (start, tie) if c])
    return adt.groupBy(block).agg(
        F.min(start).alias("first_in_dttm"), F.max(end).alias("last_out_dttm"),
        F.min_by(location, key).alias("first_location")).withColumn(
        "hospital_los_days", days_between("first_in_dttm", "last_out_dttm"))


def first_icu_stay(adt: DataFrame, block: str = BLOCK, location: str = "location_category", start: str = "in_dttm",
                   end: str = "out_dttm") -> DataFrame:
    icu = adt.where(norm(location) == "icu")
    return (icu.groupBy(block).agg(F.min(start).alias("first_icu_in_dttm"),
                                   F.min_by(end, F.struct(start, end)).alias("first_icu_out_dttm"))
            .withColumn("first_icu_los_days", days_between("first_icu_in_dttm", "first_icu_out_dttm")))


def icu_episodes(adt: DataFrame, order: list[str], block: str = BLOCK, location: str = "location_category") -> DataFrame:
    """ICU episodes per encounter. A row that opens new episodes between two ICU rows
    splits them; emergency and procedural rows do not."""
    loc = norm(location)
    d = adt.withColumn("_trig", flag(loc.isin(NEW_EPISODE)).cast("long"))
    d = Ordered(d, [block], order).cumsum("_run", "_trig").apply().where(loc == "icu")
    # ICU rows of one run number are one episode
    return d.groupBy(block).agg(F.countDistinct("_run").alias("icu_episodes"))


def journey_steps(adt: DataFrame, order: list[str], block: str = BLOCK, location: str = "location_category",
                  max_steps: int = 7) -> DataFrame:
    """First N simplified locations per encounter; a return to the ED from ICU, ward or
    procedural is left out."""
    d = adt.withColumn("location", simple_location(location))
    d = Ordered(d, [block], order).lag("_prev", "location").apply()
    back = (F.col("location") == "ED") & F.coalesce(F.col("_prev").isin("ICU", "Ward", "Procedural"), F.lit(False))
    d = materialise(d.where(~back).select(block, *order, "location"), "journeys")
    d = Ordered(d, [block], order).row_number("step").apply()
    return d.where(F.col("step") <= max_steps).select(block, "step", "location")


def journey_wide(steps: DataFrame, deaths: DataFrame, block: str = BLOCK, max_steps: int = 7) -> DataFrame:
    """One column per step; steps after the last location carry the outcome."""
    wide = steps.groupBy(block).agg(*[F.max(F.when(F.col("step") == i, F.col("location"))).alias(f"loc_{i}")
                                      for i in range(1, max_steps + 1)])
    end = F.when(F.coalesce(F.col("death_enc"), F.lit(0)) == 1, "Died").otherwise("Discharged")
    return wide.join(deaths.select(block, "death_enc"), block, "left").select(
        block, *[F.coalesce(F.col(f"loc_{i}"), end).alias(f"loc_{i}") for i in range(1, max_steps + 1)], "death_enc")


def propagate_death(wide: DataFrame, max_steps: int = 7) -> DataFrame:
    """Once a step is Died every later step is Died."""
    died, out = F.lit(False), {}
    for i in range(1, max_steps + 1):
        died = died | (F.col(f"loc_{i}") == "Died")
        out[f"loc_{i}"] = F.when(died, "Died").otherwise(F.col(f"loc_{i}"))
    return wide.withColumns(out)


def flow_table(wide: DataFrame, max_steps: int = 7) -> DataFrame:
    """Encounters per (step, from, to); terminal rows do not flow on."""
    pairs = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"loc_{i}").alias("source"),
                               F.col(f"loc_{i + 1}").alias("target")) for i in range(1, max_steps)])
    return wide.select(F.explode(pairs).alias("p")).select("p.*").groupBy("step", "source", "target").agg(
        F.count(F.lit(1)).alias("n"))


def node_sizes(wide: DataFrame, max_steps: int = 7) -> DataFrame:
    nodes = F.array(*[F.struct(F.lit(i).alias("step"), F.col(f"loc_{i}").alias("location"))
                      for i in range(1, max_steps + 1)])
    return wide.select(F.explode(nodes).alias("p")).select("p.*").groupBy("step", "location").agg(
        F.count(F.lit(1)).alias("n"))


def restrict_journey(steps: DataFrame, ids: DataFrame | None = None, starts: list[str] | None = None,
                     block: str = BLOCK) -> DataFrame:
    """Journeys of a flag cohort, or of encounters that begin in given locations."""
    if ids is not None:
        steps = steps.join(ids.select(block).distinct(), block, "left_semi")
    if starts is not None:
        first = steps.where((F.col("step") == 1) & F.col("location").isin(starts)).select(block)
        steps = steps.join(first, block, "left_semi")
    return steps


def complete_stays(adt: DataFrame, location: str = "location_category", start: str = "in_dttm",
                   end: str = "out_dttm") -> DataFrame:
    return adt.where(F.col(location).isNotNull() & (F.col(end) > F.col(start))).withColumn(
        "stay_hours", hours_between(start, end))


def dwell_summary(adt: DataFrame, ident: str = BLOCK, location: str = "location_category", start: str = "in_dttm",
                  end: str = "out_dttm") -> DataFrame:
    """Hours, days, median, nearest-rank quartiles, encounters and stays per location."""
    s = complete_stays(adt, location, start, end)
    base = with_quantiles(s, [location], [F.sum("stay_hours").alias("total_hours"), F.count(F.lit(1)).alias("n_stays")],
                          {"stay_hours": {"q1_stay_hours": 0.25, "q3_stay_hours": 0.75}}, "nearest")
    med = with_quantiles(s, [location], [F.countDistinct(ident).alias("distinct_encounters")],
                         {"stay_hours": {"median_stay_hours": 0.5}})
    return base.join(med, location).withColumn("total_days", F.col("total_hours") / 24)


def capture_by_location(events: DataFrame, adt: DataFrame, keys: list[str], ts: str, label: str,
                        location: str = "location_category", start: str = "in_dttm", end: str = "out_dttm") -> DataFrame:
    """Events per location with share of the table and events per location hour; events
    outside every stay keep a row with no rate."""
    stays = complete_stays(adt, location, start, end)
    placed = temporal.assign_location(events, stays, keys, ts, location, start, end)
    per = placed.groupBy(location).agg(F.count(F.lit(1)).alias("n_events"))
    total = per.agg(F.sum("n_events").alias("_total"))
    hours = stays.groupBy(location).agg(F.sum("stay_hours").alias("total_hours"))
    return (attach(per, total).join(hours, location, "left")
            .withColumns({"pct_events": pct(F.col("n_events"), F.col("_total")), "table": F.lit(label),
                          "events_per_hour": F.when((F.col(location) != temporal.NO_MATCH) & (F.col("total_hours") > 0),
                                                    F.col("n_events") / F.col("total_hours"))}).drop("_total"))


def stay_box(adt: DataFrame, location: str = "location_category", start: str = "in_dttm", end: str = "out_dttm") -> DataFrame:
    """Quartiles (nearest rank) and fences at 1.5 IQR, clipped to the data."""
    s = complete_stays(adt, location, start, end)
    b = with_quantiles(s, [location], [F.min("stay_hours").alias("min_h"), F.max("stay_hours").alias("max_h"),
                                       F.count(F.lit(1)).alias("n")],
                       {"stay_hours": {"q1": 0.25, "q3": 0.75}}, "nearest")
    iqr = F.col("q3") - F.col("q1")
    m = group_quantiles(s, [location], {"stay_hours": {"median": 0.5}})
    b = b.join(m, location)
    return b.withColumns({"lower_fence": F.greatest(F.col("min_h"), F.col("q1") - 1.5 * iqr),
                       "upper_fence": F.least(F.col("max_h"), F.col("q3") + 1.5 * iqr)})


def encounter_categories(adt: DataFrame, ident: str = "hospitalization_id", location: str = "location_category") -> DataFrame:
    """Hospitalizations with any ICU, and with only ICU / only ED / only ward rows."""
    loc = F.col(location)
    per = adt.where(loc.isNotNull()).groupBy(ident).agg(
        any_flag(loc == "icu").alias("icu"), any_flag(loc == "ed").alias("ed"), any_flag(loc == "ward").alias("ward"),
        any_flag(~loc.isin("icu", "ed", "ward")).alias("oth"))
    only = lambda c: F.coalesce(F.sum(flag((F.col(c) == 1) & (F.col("icu") + F.col("ed") + F.col("ward")
                                                              + F.col("oth") == 1))), F.lit(0))
    return per.agg(F.coalesce(F.sum("icu"), F.lit(0)).alias("icu_hospitalizations"),
                   only("icu").alias("icu_only_hospitalizations"), only("ed").alias("ed_only_hospitalizations"),
                   only("ward").alias("ward_only_hospitalizations"), F.count(F.lit(1)).alias("total_hospitalizations"))


def duration_statistics(adt: DataFrame, start: str = "in_dttm", end: str = "out_dttm", keys: list[str] | None = None) -> DataFrame:
    d = adt.where(F.col(start).isNotNull() & F.col(end).isNotNull()).withColumn("_h", hours_between(start, end))
    return with_quantiles(d, keys or [], [
        F.count(F.lit(1)).alias("count"), F.avg("_h").alias("mean_hours"), F.stddev_samp("_h").alias("std_hours"),
        F.min("_h").alias("min_hours"), F.max("_h").alias("max_hours")],
        {"_h": {"q1_hours": 0.25, "median_hours": 0.5, "q3_hours": 0.75}})


def icu_stay_counts(adt: DataFrame, ident: str = "hospitalization_id", location: str = "location_category",
                    kind: str = "location_type") -> DataFrame:
    """ICU events and distinct ICU hospitalizations, overall and per ICU type."""
    icu = adt.where(F.col(location) == "icu")
    g = icu.cube(kind) if kind in adt.columns else icu.groupBy(F.lit(None).cast("string").alias(kind))
    return g.agg(F.count(F.lit(1)).alias("icu_events"), F.countDistinct(ident).alias("icu_hospitalizations"))
