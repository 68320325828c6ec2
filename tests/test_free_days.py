"""28-day device-free days, one encounter per rule; both devices share the cases."""

from datetime import datetime, timedelta

import pytest

from bedside.operators import resp as R

T0 = datetime(2024, 3, 1, 8)


def run(spark, rows, device="nippv", death=None, death_enc=0, discharge_day=40, start_day=0, lpm=None, **opts):
    day = lambda d: T0 + timedelta(days=d)
    resp = spark.createDataFrame([("e", day(d), i, dev, lpm) for i, (d, dev) in enumerate(rows)],
                                 "encounter_block string, recorded_dttm timestamp, i int, device_category string, lpm_set double")
    enc = spark.createDataFrame([("e", 1, 1, day(start_day), day(start_day), day(discharge_day), day(death) if death is not None else None, death_enc)],
                                "encounter_block string, on_vent int, nippv_hfnc_enc int, vent_start_dttm timestamp, ni_device_start_dttm timestamp, "
                                "discharge_dttm timestamp, death_dttm timestamp, death_enc int")
    order = ["recorded_dttm", "i"]
    if device == "imv":
        return R.ventilator_free_days(resp, enc, order).collect()[0]["vfd_28"]
    return R.noninvasive_free_days(resp, enc, order, **opts).collect()[0]["nidfd_28"]


CASES = [
    ("death in window", [(0, "D"), (3, "room air")], dict(death=10), 0),
    ("death after window", [(0, "D"), (3, "room air")], dict(death=30), 24),
    ("death by discharge without time", [(0, "D"), (3, "room air")], dict(death_enc=1, discharge_day=5), 0),
    ("death by discharge after window", [(0, "D"), (3, "room air")], dict(death_enc=1, discharge_day=29), 24),
    ("no rows in window", [(-5, "room air")], dict(), 28),
    ("still on at the end", [(0, "D"), (20, "D"), (28, "room air")], dict(), 0),
    ("last row, still on until discharge", [(0, "D"), (5, "D")], dict(discharge_day=10), 17),
    ("last row, discharge after window", [(0, "D"), (5, "D")], dict(discharge_day=35), 0),
    ("reapplied: the last end counts", [(0, "D"), (2, "room air"), (6, "D"), (9, "room air")], dict(), 18),
    # known limitation: the run that crosses the window border has no end row inside it
    ("continuous across the border", [(0, "D"), (30, "D"), (31, "room air")], dict(), 28),
]


@pytest.mark.parametrize("device", ["nippv", "imv"])
@pytest.mark.parametrize("name,rows,opts,want", CASES, ids=[c[0] for c in CASES])
def test_rules(spark, device, name, rows, opts, want):
    rows = [(d, device.upper() if dev == "D" else dev) for d, dev in rows]
    assert run(spark, rows, device, **opts) == want


def test_flow_threshold(spark):
    rows = [(0, "high flow nc"), (4, "room air")]
    assert run(spark, rows, lpm=29.0) == 28
    assert run(spark, rows, lpm=30.0) == 23
    assert run(spark, rows, lpm=25.0, threshold=20) == 23


def test_cpap_counts_and_imv_does_not(spark):
    assert run(spark, [(0, "CPAP"), (4, "room air")]) == 23
    assert run(spark, [(0, "imv"), (4, "room air")]) == 28
    assert run(spark, [(0, "imv"), (4, "room air")], devices=["IMV"]) == 23
