"""Encounter stitching, as-of / interval / nearest joins, fills and time windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import attach, count_when, first_by, micros, norm, union_all
from bedside.functions.ordered import Ordered
from bedside.sources.tables import materialise


def stitch_encounters(hosp: DataFrame, gap_hours: float = 6, patient: str = "patient_id",
                      hosp_id: str = "hospitalization_id", start: str = "admission_dttm",
                      end: str = "discharge_dttm", block: str = "encounter_block") -> DataFrame:
    """Adds the encounter block: the first hospitalization of a run whose gaps (to the
    latest discharge so far, so nested stays join) are at most ``gap_hours``."""
    order = [start, hosp_id]
    marked = Ordered(hosp, [patient], order).cummax_before("_prev_end", end).apply()
    gap = F.lit(int(gap_hours * 3_600_000_000))
    marked = materialise(marked, "stays")
    fresh = F.col("_prev_end").isNull() | (micros(start) - micros("_prev_end") > gap)
    return (Ordered(marked, [patient], order)
            .fill(block, F.when(fresh, F.col(hosp_id))).apply().drop("_prev_end"))


def stitch_statistics(stitched: DataFrame, block: str = "encounter_block") -> DataFrame:
    """Before, after, linked, blocks with more than one stay, longest block."""
    per = stitched.groupBy(block).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("before"), F.count(F.lit(1)).alias("after"),
                   (F.coalesce(F.sum("n"), F.lit(0)) - F.count(F.lit(1))).alias("linked"),
                   count_when(F.col("n") > 1).alias("multi_blocks"),
                   F.max("n").alias("max_per_block"))


def encounter_mapping(stitched: DataFrame, hosp_id: str = "hospitalization_id",
                      start: str = "admission_dttm", block: str = "encounter_block") -> DataFrame:
    """(hospitalization, block, admission year of the block's first stay; 0 unknown)."""
    years = stitched.groupBy(block).agg(
        F.coalesce(F.year(F.min(start)), F.lit(0)).alias("admission_year"))
    return stitched.select(hosp_id, block).distinct().join(years, block)


def _merge_sides(left, right, keys, left_ts, right_ts, right_cols):
    lcols = [F.col(k) for k in keys]
    tie = F.struct(*[F.col(c) for c in right_cols])
    a = left.select(*lcols, F.col(left_ts).alias("_t"), F.lit(1).alias("_side"),
                    F.struct(*left.columns).alias("_l"),
                    F.lit(None).cast(right.select(tie.alias("x")).schema["x"].dataType).alias("_r"),
                    F.lit(None).cast("timestamp").alias("_rt"))
    b = right.select(*lcols, F.col(right_ts).alias("_t"), F.lit(0).alias("_side"),
                     F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType)
                     .alias("_l"), tie.alias("_r"), F.col(right_ts).alias("_rt"))
    return a.unionByName(b).where(F.col("_t").isNotNull())


def _with_untimed(matched: DataFrame, left: DataFrame, left_ts: str) -> DataFrame:
    """Left rows without a time can't match, but a left join keeps them: they come back with
    the matched columns null."""
    untimed = left.where(F.col(left_ts).isNull())
    empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in matched.schema.fields[len(left.columns):]]
    return matched.unionByName(untimed.select(*left.columns, *empty))


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
              right_cols: list[str], tolerance_minutes: float | None = None,
              ts_out: str = "matched_ts") -> DataFrame:
    """Latest right row at or before each left row. Both sides meet in one ordered pass,
    so no pair is ever formed. At one instant right rows come first; among right rows of
    one instant the largest by ``right_cols`` wins."""
    both = _merge_sides(left, right, keys, left_ts, right_ts, right_cols)
    hit = F.when(F.col("_side") == 0, F.struct("_rt", "_r"))
    rows = Ordered(both, keys, ["_t", "_side", "_r"]).fill("_m", hit).apply().where("_side = 1")
    ok = F.lit(True)
    if tolerance_minutes is not None:
        ok = micros("_t") - micros("_m._rt") <= F.lit(int(tolerance_minutes * 60_000_000))
    matched = rows.select("_l.*", F.when(ok, F.col("_m._rt")).alias(ts_out),
                          *[F.when(ok, F.col(f"_m._r.{c}")).alias(c) for c in right_cols])
    return _with_untimed(matched, left, left_ts)


def nearest_join(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                 right_cols: list[str], within_hours: float | None = None,
                 ts_out: str = "matched_ts") -> DataFrame:
    """Right row closest in time to each left row; the earlier one on equal distance."""
    both = _merge_sides(left, right, keys, left_ts, right_ts, right_cols)
    hit = F.when(F.col("_side") == 0, F.struct("_rt", "_r"))
    rows = (Ordered(both, keys, ["_t", "_side", "_r"])
            .fill("_p", hit).fill_back("_n", hit).apply().where("_side = 1"))
    dp, dn = micros("_t") - micros("_p._rt"), micros("_n._rt") - micros("_t")
    best = (F.when(F.col("_n").isNull() | (dp <= dn), F.col("_p")).otherwise(F.col("_n")))
    rows = rows.withColumn("_m", best)
    ok = F.lit(True)
    if within_hours is not None:
        ok = F.abs(micros("_t") - micros("_m._rt")) <= F.lit(int(within_hours * 3_600_000_000))
    matched = rows.select("_l.*", F.when(ok, F.col("_m._rt")).alias(ts_out),
                          *[F.when(ok, F.col(f"_m._r.{c}")).alias(c) for c in right_cols])
    return _with_untimed(matched, left, left_ts)


def interval_join(events: DataFrame, windows: DataFrame, keys: list[str], ts: str,
                  start: str, end: str, closed: str = "both", bucket_hours: float = 24) -> DataFrame:
    """Events inside windows of the same key, once per containing window.

    Windows are cut at bucket borders and joined on (key, bucket), so the pairs looked
    at are those of one bucket and a key with very many rows spreads over its buckets.
    ``closed`` is 'both' or 'left' (end excluded).
    """
    width = F.lit(int(bucket_hours * 3_600_000_000))
    bucket = lambda c: F.floor(micros(c) / width)
    extra = [c for c in windows.columns if c not in keys]
    ev = events.withColumn("_b", bucket(ts))
    # a window reaches no further than the events do, however far its ends lie
    span = events.agg(F.min(ts).alias("_first_event"), F.max(ts).alias("_last_event"))
    win = attach(windows.where(F.col(start) <= F.col(end)), span)
    first, last = F.greatest(start, "_first_event"), F.least(end, "_last_event")
    win = win.where(first <= last).withColumn("_b", F.explode(F.sequence(bucket(first), bucket(last))))
    upper = (F.col(ts) <= F.col(end)) if closed == "both" else (F.col(ts) < F.col(end))
    return (ev.join(win.select(*keys, "_b", *extra), [*keys, "_b"])
            .where((F.col(ts) >= F.col(start)) & upper).drop("_b"))


def _marks(windows: DataFrame, keys: list[str], start: str, end: str, closed: str) -> DataFrame:
    """Window ends as steps of a running count, combined per key and instant: +1 before the events of the
    start's instant, -1 after those of the end's (before them where the end is excluded)."""
    w = windows.na.drop(subset=keys).where(F.col(start) <= F.col(end))
    after = 2 if closed == "both" else 0
    steps = F.explode(F.array(F.struct(F.col(start).alias("_t"), F.lit(0).alias("_side"), F.lit(1).cast("long").alias("_d")),
                              F.struct(F.col(end).alias("_t"), F.lit(after).alias("_side"), F.lit(-1).cast("long").alias("_d"))))
    return w.select(*keys, steps.alias("_s")).select(*keys, "_s.*").groupBy(*keys, "_t", "_side").agg(F.sum("_d").alias("_d"))


def window_depth(events: DataFrame, windows: DataFrame, keys: list[str], ts: str, start: str, end: str,
                 closed: str = "both", out: str = "n_windows") -> DataFrame:
    """Every event with the number of windows of its key that hold it, by a sweep: window ends and events meet in
    one ordered pass and a running sum counts the open windows, so no (event, window) pair is formed however
    many windows overlap. Events without a time or key lie in no window. ``closed`` as in ``interval_join``."""
    at = lambda c: F.lit(None).cast("long") if c is None else F.xxhash64(c)
    row = F.struct(*[F.col(f"`{c}`") for c in events.columns]).alias("_e")
    timed = F.col(ts).isNotNull()
    for k in keys:
        timed = timed & F.col(k).isNotNull()
    ev = events.where(timed).select(*keys, F.col(ts).alias("_t"), F.lit(1).alias("_side"), F.lit(0).cast("long").alias("_d"), row)
    both = _marks(windows, keys, start, end, closed).unionByName(ev, allowMissingColumns=True).withColumn(
        "_tie", F.when(F.col("_side") == 1, at("_e")).otherwise(F.lit(0).cast("long")))
    rows = Ordered(both, keys, ["_t", "_side", "_tie"]).cumsum("_open", "_d").apply().where("_side = 1")
    return rows.select("_e.*", F.col("_open").alias(out)).unionByName(
        events.where(~timed).withColumn(out, F.lit(0).cast("long")))


def covered_events(events: DataFrame, windows: DataFrame, keys: list[str], ts: str, start: str, end: str,
                   closed: str = "both") -> DataFrame:
    """Events inside at least one window of their key, each once."""
    depth = window_depth(events, windows, keys, ts, start, end, closed, "_depth")
    return depth.where("_depth > 0").drop("_depth")


def interval_union(intervals: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Intervals of a key merged where they overlap or touch: (keys, start, end), disjoint. Those without
    an end or ending before their start are left out; null keys are one key."""
    rows = intervals.where(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))
    rows = Ordered(rows, keys, [start]).cummax_before("_reach", end).apply(keep_slice=True)
    opens = F.col("_reach").isNull() | (F.col(start) > F.col("_reach"))
    rows = materialise(rows.withColumn("_opens", F.when(opens, F.col(start))), "intervals")
    rows = Ordered(rows, keys, [start]).fill("_first", "_opens").apply()
    return rows.groupBy(*keys, F.col("_first").alias(start)).agg(F.max(end).alias(end))


NO_MATCH = "__no_adt_match__"


def assign_location(events: DataFrame, adt: DataFrame, keys: list[str], ts: str,
                    location: str = "location_category", start: str = "in_dttm",
                    end: str = "out_dttm") -> DataFrame:
    """Location whose stay ``[in, out)`` holds the event; the last stay begun decides."""
    right = adt.select(*keys, start, F.struct(F.col(end).alias("_out"), F.col(location).alias("_loc"))
                       .alias("_stay"))
    hit = asof_join(events, right, keys, ts, start, ["_stay"], ts_out="_in")
    inside = F.col("_stay").isNotNull() & (F.col(ts) < F.col("_stay._out"))
    return hit.withColumn(location, F.when(inside, F.col("_stay._loc")).otherwise(NO_MATCH)).drop(
        "_stay", "_in")


def first_event_in_window(events: DataFrame, windows: DataFrame, keys: list[str], ts: str,
                          start: str, end: str) -> DataFrame:
    """Earliest event inside a half-open window, one row per key. The event itself must
    be the key's first; later events do not count."""
    firsts = events.groupBy(*keys).agg(F.min(ts).alias(ts))
    hits = interval_join(firsts, windows, keys, ts, start, end, closed="left")
    return first_by(hits, keys, [start, end], [ts, start, end])


def icu_windows(adt: DataFrame, keys: list[str], location: str = "location_category",
                start: str = "in_dttm", end: str = "out_dttm", match: str = "equals",
                value: str = "icu") -> DataFrame:
    """Stay rows of the wanted location with both ends known."""
    loc = F.lower(F.col(location))
    cond = (loc == value) if match == "equals" else loc.contains(value)
    return adt.where(cond & F.col(start).isNotNull() & F.col(end).isNotNull()).select(
        *keys, F.col(start).alias("start_dttm"), F.col(end).alias("end_dttm"))


def event_windows(events: DataFrame, ends: DataFrame, keys: list[str], ts: str,
                  category: str, wanted: list[str], end: str = "discharge_dttm",
                  extra: Column | None = None) -> DataFrame:
    """First qualifying event to discharge. ``extra`` narrows the rule (for example a
    flow threshold on one device)."""
    cond = norm(category).isin([w.lower() for w in wanted])
    if extra is not None:
        cond = cond & extra
    first = events.where(cond).groupBy(*keys).agg(F.min(ts).alias("start_dttm"))
    return (first.join(ends.groupBy(*keys).agg(F.max(end).alias("end_dttm")), keys)
            .where(F.col("end_dttm").isNotNull() & (F.col("start_dttm") < F.col("end_dttm"))))


# The window family of each stratum.
STRATUM_WINDOW = {
    "icu": "icu", "deaths": "icu",
    "vaso": "vaso", "vaso/icu": "vaso", "vaso/no_icu": "vaso",
    "vaso/ed_icu": "vaso", "vaso/ed_ward": "vaso",
    "advanced_resp": "resp", "advanced_resp/icu": "resp", "advanced_resp/no_icu": "resp",
    "nippv_hfnc": "nippv_hfnc", "nippv_hfnc/icu": "nippv_hfnc", "nippv_hfnc/no_icu": "nippv_hfnc",
    "no_imv": "icu", "no_imv/icu": "icu", "no_imv/no_icu": "icu",
}


def stratum_windows(members: DataFrame, families: dict[str, DataFrame], keys: list[str],
                    mapping: dict[str, str] | None = None) -> DataFrame:
    """(stratum, key, start, end) for all strata in one join on (family, key)."""
    mapping = STRATUM_WINDOW if mapping is None else mapping
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    fam = F.element_at(F.create_map(*pairs), F.col("stratum"))
    windows = union_all([w.select(*keys, "start_dttm", "end_dttm").withColumn("_family", F.lit(f))
                         for f, w in families.items()])
    return (members.select("stratum", *keys).withColumn("_family", fam)
            .join(windows, ["_family", *keys]).drop("_family"))


def forward_fill(df: DataFrame, keys: list[str], order: list[str], cols: list[str]) -> DataFrame:
    o = Ordered(df, keys, order)
    for c in cols:
        o.fill(f"_f_{c}", c)
    out = o.apply()
    return out.select(*[F.col(f"_f_{c}").alias(c) if c in cols else F.col(c) for c in df.columns])


def change_ids(df: DataFrame, keys: list[str], order: list[str], levels: list[tuple[str, str]]) -> DataFrame:
    """Nested run numbers: each level starts a new run when its column or any outer
    level changes. ``levels`` is [(column, output id), ...] outermost first."""
    o = Ordered(df, keys, order)
    for c, _ in levels:
        o.lag(f"_p_{c}", F.struct(F.col(c).alias("v")))
    out, changed, flags = materialise(o.apply(), "runs"), F.lit(False), {}
    for c, name in levels:
        changed = changed | F.col(f"_p_{c}").isNull() | ~F.col(c).eqNullSafe(F.col(f"_p_{c}.v"))
        flags[f"_x_{name}"] = changed.cast("long")
    out = out.withColumns(flags)
    o = Ordered(out, keys, order)
    for _, name in levels:
        o.cumsum(name, f"_x_{name}")
    return o.apply().drop(*flags, *[f"_p_{c}" for c, _ in levels])


def side_by_side(left: DataFrame, right: DataFrame, key: str, order: str) -> DataFrame:
    """Two result tables joined on the row label, left order first, blanks for missing."""
    lcols = [c for c in left.columns if c not in (key, order)]
    rcols = [c for c in right.columns if c not in (key, order)]
    a = left.withColumnRenamed(order, "_lo")
    b = right.withColumnRenamed(order, "_ro")
    return (a.join(b, key, "full_outer")
            .select(key, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in lcols + rcols],
                    F.struct(F.col("_lo").isNull().cast("int").alias("side"),
                             F.coalesce("_lo", "_ro").alias("pos")).alias(order)))


def join_on(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi join; the strategy is Spark's choice from measured sizes."""
    return left.join(right, keys, how)


def id_difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Ids only on one side, with the side that has them."""
    left = a.select(key).distinct().join(b.select(key), key, "left_anti").withColumn("only_in", F.lit("left"))
    right = b.select(key).distinct().join(a.select(key), key, "left_anti").withColumn("only_in", F.lit("right"))
    return left.unionByName(right)


def event_union(sources: dict[str, DataFrame]) -> DataFrame:
    """Diagonal union of event sources with a source name; absent columns are null."""
    return union_all([d.withColumn("source", F.lit(n)) for n, d in sources.items()])


