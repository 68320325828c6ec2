"""Keys small enough for one task are ordered by plain windows; steps before them are computed once."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from bedside.functions import slices
from bedside.functions.ordered import Ordered
from bedside.operators import dist as D
from bedside.operators import severity as S

T0 = datetime(2024, 1, 1, 23)


def test_small_keys_take_one_shuffle(spark):
    df = spark.range(5000).select((F.col("id") % 40).alias("k"), "id", F.timestamp_micros(F.col("id") * 3_600_000_000).alias("t"))
    out = Ordered(df, ["k"], ["t", "id"]).lag("p", "id").cumsum("s", "id").apply().groupBy("k").agg(F.max("s"))
    assert str(out._jdf.queryExecution().optimizedPlan()).count("Join") == 0
    assert str(out._jdf.queryExecution().sparkPlan()).count("Window") == 1
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan[:plan.find("Initial Plan") if "Initial Plan" in plan else None].count("Exchange hashpartitioning") == 1


def test_both_ways_agree(spark):
    rng = random.Random(5)
    rows = [(rng.choice(["hot", "hot", "a", None]), T0 + timedelta(hours=rng.randrange(200)), i, rng.choice([None, i % 9])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t timestamp, i int, x int")

    def run():
        o = Ordered(df, ["k"], ["t", "i"]).lag("a", "x").lag("b", "x", 2).lead("c", "x").lead("d", "x", 2).fill("e", "x").fill_before("f", "x")
        o.fill_back("g", "x").cumsum("h", "x").total("j", "x").cummax("l", "x").cummax_before("m", "x").row_number("n")
        return sorted(map(repr, map(tuple, o.apply().collect())))
    whole = run()
    spark.conf.set(slices.ROWS_CONF, "30")
    try:
        assert not slices.shallow(df, ["k"])
        assert run() == whole
    finally:
        spark.conf.unset(slices.ROWS_CONF)


def test_rows_of_equal_order_after_a_day(frame):
    """The row before two that are equal in order leads to the first of them, also where a day begins with them."""
    df = frame([("a", "2024-01-01 23:00:00", 1, 1), ("a", "2024-01-02 00:00:00", 2, 2), ("a", "2024-01-02 00:00:00", 2, 3)], "k string, t ts, i int, v int")
    rows = sorted(Ordered(df, ["k"], ["t", "i"]).lead("n", "v").row_number("r").apply().collect(), key=lambda r: r.r)
    assert [r.n for r in rows] == [r.v for r in rows[1:]] + [None]


def test_a_deep_key_is_cut(spark):
    df = spark.range(3000).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    spark.conf.set(slices.ROWS_CONF, "500")
    try:
        assert not slices.shallow(df, ["k"]) and slices.shallow(df.where("k != 'hot'"), ["k"])
    finally:
        spark.conf.unset(slices.ROWS_CONF)


def test_charlson_by_prefix(spark):
    rng = random.Random(6)
    prefixes = [p for _, text in S.CHARLSON.values() for p in text.split()]
    rows = [(rng.choice([None, *range(30)]), rng.choice([None, "z99", rng.choice(prefixes).lower() + rng.choice(["", ".1", "7.2"]), "C.77"]), rng.choice(["ICD10CM", "icd-10-cm", "ICD9CM", None]))
            for _ in range(400)]
    df = spark.createDataFrame(rows, "h int, diagnosis_code string, diagnosis_code_format string")
    want = {}
    for h, code, kind in rows:
        if kind in ("ICD10CM", "icd-10-cm"):
            have = want.setdefault(h, set())
            c = (code or "").upper().replace(".", "")
            have |= {n for n, (_, text) in S.CHARLSON.items() if h is not None and c and any(c[:k] in text.split() for k in (2, 3, 4))}
    out = S.charlson(df, ["h"], hierarchy=False)
    assert {r.h: {n for n in S.CHARLSON if r[n]} for r in out.collect()} == want
    assert all(r.cci_score == sum(S.CHARLSON[n][0] for n in want[r.h]) for r in out.collect())
    # codes meet the prefixes where they are: nothing is shuffled by prefix
    assert "hashpartitioning(prefix" not in out._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("value", [1.0, None])
def test_ecdf_counts_once(spark, value):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", value)], "k string, value double")
    out = D.ecdf(df, ["k"])
    assert out.inputFiles() and all("counted" in f for f in out.inputFiles())
    assert {tuple(r) for r in out.collect()} == {("a", 1.0, 0.5), ("a", 2.0, 1.0)} | ({("b", 1.0, 1.0)} if value else set())
