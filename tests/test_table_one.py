"""Table One by masks against the plain form, feature assembly, and that every line is filled."""

import os
import random

import pytest
from pyspark.sql import functions as F

from bedside.operators import report as T
from bedside.operators import rollup
from bedside.operators.assemble import assemble

SF = "/root/testdata/sf0.001"
ROWS = [T.Row("N", "count"), T.Row("Patients", "distinct", "patient_id"), T.Row("Age", "median", "age"), T.Row("Race", "levels", "race", patient=True),
        T.Row("Head", "header"), T.Row("ICU", "flag", "icu"), T.Row("ICU in vent", "flag", "icu", "vent"), T.Row("Hours", "sum", "hours"),
        T.Row("Place", "levels", "place"), T.Row("Mode in vent", "levels", "place", "vent"), T.Row("Dose in vent", "median", "dose", "vent")]


def frame(spark, seed, n=400):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        p = rng.choice([None, *range(1, 90)])
        race = "mixed" if p and p % 9 == 0 and rng.random() < 0.5 else f"r{(p or 0) % 3}" if (p or 0) % 5 else None
        rows.append((k, p, rng.choice([1.0, 2.0, 2.0, None, rng.random() * 100]), race, rng.choice([0, 1, None]), rng.choice([0, 1]), rng.random(),
                     rng.choice(["a", "b", None]), rng.choice([None, rng.lognormvariate(0, 3)]), rng.choice([2020, 2021, None]), *[rng.choice([0, 1]) for _ in range(3)]))
    return spark.createDataFrame(rows, "encounter_block int, patient_id int, age double, race string, icu int, vent int, hours double, place string, dose double, year int, s0 int, s1 int, s2 int")


def cells(df):
    r = lambda v: None if v is None else round(v, 9)
    return sorted((repr((x.stratum, x.col, x.pos, x.label, x.kind, r(x.n), r(x.denom), r(x.median), r(x.q1), r(x.q3))) for x in df.collect()))


@pytest.mark.parametrize("seed", [0, 1])
def test_masks_give_the_plain_table(spark, seed):
    e, strata = frame(spark, seed), {"first": "s0", "second/x": "s1", "third": "s2"}
    parts = [e.where(f"{c} = 1").withColumn("stratum", F.lit(s)) for s, c in strata.items()]
    members = parts[0].unionByName(parts[1]).unionByName(parts[2])
    # the plain form joins on its keys: a null year gets a name
    named = members.withColumn("year", F.coalesce(F.col("year").cast("string"), F.lit("none")))
    want = cells(T.table_one(T.with_overall(named, "year", "col"), ROWS, ["stratum", "col"]))
    got = rollup.table_one(e, ROWS, strata, "year")
    assert cells(got.withColumn("col", F.coalesce("col", F.lit("none")))) == want
    plain = cells(T.table_one(members.withColumn("col", F.lit("Overall")), ROWS, ["stratum", "col"]))
    assert cells(rollup.table_one(e, ROWS, strata)) == plain


def test_no_encounters_and_absent_columns(spark):
    e = frame(spark, 0, 5)
    assert rollup.table_one(e.limit(0), ROWS, {"a": "s0"}, "year").count() == 0
    with pytest.raises(ValueError, match="dose, vent"):
        rollup.table_one(e.drop("vent", "dose"), ROWS, {"a": "s0"})
    with pytest.raises(ValueError, match="s9"):
        rollup.table_one(e, ROWS, {"a": "s9"})


def test_more_strata_shuffle_no_more_rows(spark):
    e = frame(spark, 3)
    for i in range(3, 16):
        e = e.withColumn(f"s{i}", F.lit(1))
    few, many = ({f"x{i}": f"s{i}" for i in range(3, 3 + n)} for n in (1, 13))
    flags = [F.col(c) for c in many.values()]
    assert e.select(*flags).distinct().count() == 1
    counts = [e.withColumn("_mask", rollup.strata_mask(s)).groupBy("_mask", "year").count().count() for s in (few, many)]
    assert counts[0] == counts[1]
    assert rollup.table_one(e, ROWS, many).count() == 13 * rollup.table_one(e, ROWS, few).count()


def test_assembly_shuffles_once(spark):
    base = spark.range(50).select(F.col("id").alias("encounter_block"), F.lit(1).alias("a"))
    parts = {f"f{i}": spark.range(0, 50, i + 2).select(F.col("id").alias("encounter_block"), F.lit(i).alias(f"c{i}")) for i in range(4)}
    out = assemble(base, parts, ["a", "c0", "c3"])
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("FileScan") == 5
    assert out.count() == 50 and out.where("c1 = 1").count() == 17
    with pytest.raises(ValueError, match="no feature has z"):
        assemble(base, parts, ["z"])
    with pytest.raises(ValueError, match="brings columns that are there already: a"):
        assemble(base, {"x": base}, [])
    twice = assemble(base, {"x": parts["f0"].union(parts["f0"])}, [])
    with pytest.raises(Exception, match="x has an encounter twice"):
        twice.collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_every_line_is_filled_from_the_features(spark):
    from bedside.plans import cases
    e = cases.encounters(spark, SF)
    assert e.count() == e.select("encounter_block").distinct().count() > 50
    for ward in (False, True):
        rows = T.table_one_rows(ward)
        got = rollup.table_one(e, rows, {"all": "ward_enc" if ward else "cohort_enc"})
        found = {(r.pos, r.kind): r for r in got.collect()}
        for i, r in enumerate(rows):
            kind = {"levels": "flag", "distinct": "count"}.get(r.kind, r.kind)
            assert (i, kind) in found, r.label
            assert kind == "header" or found[i, kind].n is not None, r.label
    extra = rollup.table_one(e, T.EXTRA_ROWS, {"all": "cohort_enc"})
    assert {r.pos for r in extra.collect()} == set(range(len(T.EXTRA_ROWS)))
