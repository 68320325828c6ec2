"""Merging and small-cell suppression."""

import pytest

from bedside.operators import disclosure as X

RACE = [("Race: White", "120 (60.0%)"), ("Race: Asian", "9 (4.5%)"), ("Race: Other", "3 (1.5%)"), ("Race: Unknown", "68 (34.0%)"), ("N: Hospitals", "2"),
        ("Age, median [Q1, Q3]", "60 [41, 72]"), ("ICU, n (%)", "5 (2.5%)"), ("Vaso, n (%)", "1,150 (57.5%)"), ("Race: None", "0 (0.0%)"), ("Blank", "")]


@pytest.fixture
def table(spark):
    return spark.createDataFrame([("t", i, lab, "Overall", c) for i, (lab, c) in enumerate(RACE)], "`table` string, pos int, label string, `column` string, cell string")


@pytest.fixture
def rules(spark):
    return spark.createDataFrame([("Race", "Other", v) for v in ("Other", "Unknown", "Asian")], "variable string, merged_label string, source_value string")


def cells(df):
    return {r["label"]: r["cell"] for r in df.collect()}


def test_parse(table):
    got = {r["label"]: (r["variable"], r["value"], r["n"], r["pct"]) for r in X.parsed(table).collect()}
    assert got["Race: White"] == ("Race", "White", 120, 60.0)
    assert got["Vaso, n (%)"] == ("", "Vaso, n (%)", 1150, 57.5)
    assert got["Age, median [Q1, Q3]"][2] is None and got["Blank"][2] is None and got["N: Hospitals"][2:] == (2, None)


def test_merge(table, rules):
    got = cells(X.merge_levels(table, rules))
    assert got["Race: Other"] == "80 (40.0%)" and "Race: Asian" not in got and len(got) == 8
    assert cells(X.merge_levels(table, rules, recompute=False))["Race: Other"] == "80"
    pos = {r["label"]: r["pos"] for r in X.merge_levels(table, rules).collect()}
    assert pos["Race: Other"] == 1  # place of its first source


def test_suppress_small_only(table):
    got = cells(X.suppress(table))
    assert got["Race: Asian"] == got["Race: Other"] == got["ICU, n (%)"] == "<10"
    assert got["Race: White"] == "120 (60.0%)" and got["Race: None"] == "0 (0.0%)" and got["N: Hospitals"] == "2"


def test_idempotent_and_nothing_small_left(table):
    once = X.suppress(table)
    assert cells(X.suppress(once)) == cells(once)
    left = X.parsed(once).where("variable <> 'N' and n between 1 and 9").count()
    assert left == 0


@pytest.mark.parametrize("n,hidden", [(0, False), (1, True), (9, True), (10, False)])
def test_threshold_border(spark, n, hidden):
    d = spark.createDataFrame([("t", 0, "A: x", "O", str(n)), ("t", 1, "A: y", "O", "50")], "`table` string, pos int, label string, `column` string, cell string")
    assert (cells(X.suppress(d))["A: x"] == "<10") is hidden


def test_whole_group_and_complementary(spark):
    schema = "`table` string, pos int, label string, `column` string, cell string"
    d = spark.createDataFrame([("t", 0, "A: x", "O", "4"), ("t", 1, "A: y", "O", "5"), ("t", 2, "A: z", "O", "0")], schema)
    assert set(cells(X.suppress(d)).values()) == {"<10"}
    d = spark.createDataFrame([("t", 0, "A: x", "O", "4"), ("t", 1, "A: y", "O", "50"), ("t", 2, "A: z", "O", "30")], schema)
    assert cells(X.suppress(d, complementary=True)) == {"A: x": "<10", "A: y": "50", "A: z": "<10"}
    assert cells(X.suppress(d)) == {"A: x": "<10", "A: y": "50", "A: z": "30"}


def test_scan(table, rules):
    got = {r["row"]: r for r in X.small_cells(table, rules, complementary=True).collect()}
    assert set(got) == {"ICU, n (%)"}
    assert got["ICU, n (%)"]["raw_n"] == 5 and got["ICU, n (%)"]["complementary_target"] == "Vaso, n (%)" and got["ICU, n (%)"]["status"] == "still_small"
