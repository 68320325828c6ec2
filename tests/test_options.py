"""Options beside the pinned defaults: windows counted once, merged intervals, next-after pairs."""

import random
from datetime import datetime, timedelta

import pytest

from bedside.operators import resp as R
from bedside.operators import temporal
from test_free_days import CASES, run

T0 = datetime(2024, 3, 1, 8)
ORDER = ["recorded_dttm", "i"]


def at(hours):
    return T0 + timedelta(hours=hours)


def spans(rng, n, keys="abc"):
    out = []
    for i in range(n):
        s = rng.randrange(200)
        out.append((rng.choice(keys), at(s), at(s + rng.randrange(-2, 60))))
    return out + [("a", at(5), None), (None, at(1), at(9)), ("d", at(3), at(3))]


@pytest.mark.parametrize("closed", ["both", "left"])
@pytest.mark.parametrize("slice_rows", [None, 20])
def test_window_depth_against_pairs(spark, closed, slice_rows):
    rng = random.Random(7)
    windows = spans(rng, 60)
    events = [(i, rng.choice("abcd"), at(rng.randrange(220))) for i in range(300)]
    events += [(900, "a", None), (901, None, at(4)), (902, "e", at(4)), (903, "d", at(3)), (903, "d", at(3))]
    ev = spark.createDataFrame(events, "i int, k string, ts timestamp")
    win = spark.createDataFrame(windows, "k string, s timestamp, e timestamp")
    if slice_rows:
        spark.conf.set("spark.bedside.slice.rows", str(slice_rows))
    try:
        got = sorted((r.i, r.n_windows) for r in temporal.window_depth(ev, win, ["k"], "ts", "s", "e", closed).collect())
        once = sorted(r.i for r in temporal.covered_events(ev, win, ["k"], "ts", "s", "e", closed).collect())
    finally:
        spark.conf.unset("spark.bedside.slice.rows")
    inside = lambda t, s, e: e is not None and s <= t and (t <= e if closed == "both" else t < e)
    want = sorted((i, sum(k is not None and t is not None and k == wk and inside(t, s, e) for wk, s, e in windows)) for i, k, t in events)
    assert got == want
    assert once == sorted(i for i, n in want if n)
    pairs = temporal.interval_join(ev, win, ["k"], "ts", "s", "e", closed)
    assert sum(n for _, n in got) == pairs.count()


def test_interval_union_against_sweep(spark):
    rng = random.Random(3)
    rows = spans(rng, 80)
    got = sorted((r.k or "", r.s, r.e) for r in temporal.interval_union(
        spark.createDataFrame(rows, "k string, s timestamp, e timestamp"), ["k"], "s", "e").collect())
    want = []
    for k in ("a", "b", "c", "d", None):
        mine = []
        for s, e in sorted((s, e) for q, s, e in rows if q == k and e is not None and s <= e):
            if mine and s <= mine[-1][1]:
                mine[-1][1] = max(mine[-1][1], e)
            else:
                mine.append([s, e])
        want += [(k or "", s, e) for s, e in mine]
    assert got == sorted(want)
    empty = spark.createDataFrame([], "k string, s timestamp, e timestamp")
    assert temporal.interval_union(empty, ["k"], "s", "e").count() == 0


#: What the merged intervals change: the run that crosses the border is seen.
INTERVAL = {"continuous across the border": 0}


@pytest.mark.parametrize("device", ["nippv", "imv"])
@pytest.mark.parametrize("name,rows,opts,want", CASES, ids=[c[0] for c in CASES])
def test_interval_mode(spark, monkeypatch, device, name, rows, opts, want):
    whole = R.device_free_days
    monkeypatch.setattr(R, "device_free_days", lambda *a, **k: whole(*a, **(k | {"interval_mode": True})))
    rows = [(d, device.upper() if dev == "D" else dev) for d, dev in rows]
    assert run(spark, rows, device, **opts) == INTERVAL.get(name, want)


def test_device_cover(spark):
    rows = [("e", at(24 * d), i, dev) for i, (d, dev) in enumerate([(0, "imv"), (1, "imv"), (2, "x"), (4, "imv"), (4, "x"), (20, "imv"), (40, "x")])]
    resp = spark.createDataFrame(rows, "encounter_block string, recorded_dttm timestamp, i int, device_category string")
    enc = spark.createDataFrame([("e", T0, at(24 * 50)), ("f", None, None)], "encounter_block string, start timestamp, discharge_dttm timestamp")
    got = R.device_cover(resp, enc, R.is_imv(), "start", ORDER).collect()
    # day 0 to 2, the instant on day 4, day 20 to the border on day 27
    assert [(r.encounter_block, r.device_runs, r.device_hours, r.last_device_end) for r in got] == [("e", 3, 9 * 24.0, at(24 * 27))]


def episodes(spark, text, pairing):
    """Hours of starts and ends; one letter an hour, I is on the ventilator."""
    rows = [("e", at(h), h, "imv" if c == "I" else "room air") for h, c in enumerate(text)]
    resp = spark.createDataFrame(rows, "encounter_block string, recorded_dttm timestamp, i int, device_category string")
    hour = lambda t: None if t is None else int((t - T0).total_seconds() // 3600)
    return sorted((hour(r.intubation_start_dttm), hour(r.extubation_end_dttm), r.episode_n)
                  for r in R.imv_episodes(resp, ORDER, pairing=pairing).collect())


def test_pairs_agree_when_nothing_is_missed(spark):
    text = "..III..IIII...III.."
    assert episodes(spark, text, "ordinal") == episodes(spark, text, "next_after") == [(2, 5, 1), (7, 11, 2), (14, 17, 3)]


def test_one_missed_extubation_shifts_no_later_pair(spark):
    # one row off, then off and on: the end at hour 5 is no extubation, both later ones are
    text = "..III.I..IIII..IIII.."
    assert [e for _, e, _ in episodes(spark, text, "ordinal")] == [13, 19, None]
    assert episodes(spark, text, "next_after") == [(2, None, 1), (9, 13, 2), (15, 19, 3)]


def test_first_rows_on_the_ventilator_pair_with_the_first_end(spark):
    assert episodes(spark, "III...III..", "next_after") == [(0, 3, 1), (6, 9, 2)]
    with pytest.raises(ValueError):
        episodes(spark, "III", "nearest")
