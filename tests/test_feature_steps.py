"""The features' shared steps: side by side, merged in blocks, codes and units without patterns per row."""

import re
import threading

import pytest
from pyspark.sql import functions as F

from bedside.operators import severity as S
from bedside.operators.assemble import assemble, together

BLOCK = "encounter_block"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_steps_run_side_by_side(spark):
    meet = threading.Barrier(3, timeout=30)
    out = together(spark, {n: lambda n=n: (meet.wait(), spark.range(n).count())[1] for n in (1, 2, 3)})
    assert out == {1: 1, 2: 2, 3: 3}
    with pytest.raises(ZeroDivisionError):
        together(spark, {"a": lambda: 1 / 0, "b": lambda: 1})


def test_many_tables_are_merged_in_blocks(spark):
    base = spark.range(40).select(F.col("id").alias(BLOCK), F.lit("x").alias("a"))
    parts = {f"f{i}": spark.range(0, 60, i + 1).select(F.col("id").alias(BLOCK), F.when(F.col("id") % 5 != 0, F.col("id") + i).alias(f"c{i}"))
             for i in range(13)}
    out = assemble(base, parts, ["a", "c12"])
    plan = plan_of(out)
    assert plan.count("Exchange ") == 1 and "Join" not in plan and plan.count("FileScan") == 3
    assert out.columns == [BLOCK, "a", *[f"c{i}" for i in range(13)]]
    rows = {r[BLOCK]: r for r in out.collect()}
    assert sorted(rows) == list(range(40))
    for k, r in rows.items():
        assert [r[f"c{i}"] for i in range(13)] == [k + i if k % (i + 1) == 0 and k % 5 else None for i in range(13)]
    with pytest.raises(Exception, match="f9 has an encounter twice"):
        assemble(base, {**parts, "f9": parts["f9"].union(parts["f9"])}, []).collect()
    for some in (parts, {"f1": parts["f1"]}):
        again = assemble(base.union(base.where(f"{BLOCK} = 4")), some, [])
        assert sorted(r[BLOCK] for r in again.collect()) == [k for k in range(40) if k != 4]


def test_codes_are_matched_one_row_each(frame):
    rows = [(1, "i21.0", "ICD10CM"), (1, "E10.2", "icd-10-cm"), (1, "E10.0", "ICD10"), (2, "C01", "ICD10CM"), (2, "C77.1", "Icd10CM"),
            (3, "I21", "ICD9CM"), (4, None, "ICD10CM"), (5, "I21", None), (None, "I21", "ICD10CM"), (6, "I13.2", "ICD 10 CM")]
    d = frame(rows, "k int, diagnosis_code string, diagnosis_code_format string")
    out = S.charlson(d, ["k"])
    assert "Generate" not in plan_of(out)
    got = {r.k: ({c for c in S.CHARLSON if r[c]}, r.cci_score) for r in out.collect()}
    assert got == {1: ({"myocardial_infarction", "diabetes_with_complications"}, 1), 2: ({"metastatic_cancer"}, 6), 4: (set(), 0),
                   None: (set(), 0), 6: ({"congestive_heart_failure"}, 2)}


def test_mass_rates_stay_as_the_patterns_leave_them(frame):
    def by_patterns(u):
        u = re.sub(r"\s+", "", u).lower()
        for pattern, plain in S.UNIT_PATTERNS:
            u = re.sub(pattern, plain, u)
        return u

    texts = [*S.MASS_RATES, *[u.upper() for u in S.MASS_RATES], "MCG / kg / Hour", "units/min", "µg/kg/minute", "milli-grams/hr", "ml/hr", "mg", "mg/kg", "/hr", ""]
    out = frame([(u,) for u in texts] + [(None,)], "u string").select("u", S.clean_unit("u").alias("c")).collect()
    assert {r.u: r.c for r in out} == {None: None, **{u: by_patterns(u) for u in texts}}
    dosed = frame([(u, 120.0) for u in texts], "med_dose_unit string, med_dose double").withColumns({"weight_kg": F.lit(60.0), "med_category": F.lit("a")})
    d = dosed.withColumn("dose_unit_clean", S.clean_unit("med_dose_unit")).withColumn("dose_mcg_kg_min", S._convert(F.col("med_dose"), F.col("dose_unit_clean"), F.col("weight_kg")))
    got = {r.dose_unit_clean: (r.convert_status, r.dose_converted) for r in S.to_preferred_unit(d, ["a"]).collect()}
    assert got["mg/hr"] == ("success", pytest.approx(120_000 / 60 / 60)) and got["ng/kg/min"] == ("success", pytest.approx(0.12))
    assert got["g/lb/hr"] == ("success", pytest.approx(120e6 / 60 * S.LB_PER_KG)) and got["mcg/min"] == ("success", pytest.approx(2.0))
    assert got["u/min"][0] == "unrecognized_unit" and got["ml/hr"][0] == "unrecognized_unit" and got[""][0] == "missing_unit"


def test_signature_lists_files_and_reads_no_row(spark, tmp_path):
    from bedside.sources.tables import source_signature
    where = str(tmp_path / "a b [1] 50%25")
    spark.range(100).repartition(3).write.parquet(where)
    escaped = lambda p: re.sub(r"([\[\]])", r"\\\1", p)
    first = source_signature(spark.read.parquet(escaped(where)))
    assert first[0] == 3 and first[1] == sum(f.stat().st_size for f in (tmp_path / "a b [1] 50%25").glob("*.parquet"))
    assert source_signature(spark.read.parquet(escaped(where))) == first
    spark.range(7).coalesce(1).write.mode("append").parquet(where)
    assert source_signature(spark.read.parquet(escaped(where)))[0] == 4
    (tmp_path / "broken").mkdir()
    (tmp_path / "broken" / "x.parquet").write_bytes(b"no parquet")
    assert source_signature(spark.read.schema("id long").parquet(str(tmp_path / "broken")))[:2] == [1, 10]
