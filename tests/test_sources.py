"""Typed loading, daylight saving, cohort subsets and their reuse."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from bedside.operators import clean as C
from bedside.sources import tables as S


def test_spring_gap_is_null_and_overlap_is_earlier(spark):
    d = spark.sql("select i, cast(t as timestamp_ntz) as ts from values (1,'2018-03-11 01:30:00'),(2,'2018-03-11 02:00:00'),(3,'2018-03-11 03:00:00'),(4,'2018-11-04 01:30:00') as v(i, t)")
    got = {r["i"]: r["ts"] for r in C.standardize_times(d, "US/Central").collect()}
    assert got == {1: datetime(2018, 3, 11, 7, 30), 2: None, 3: datetime(2018, 3, 11, 8), 4: datetime(2018, 11, 4, 6, 30)}


def test_zoned_times_stay(spark):
    d = spark.sql("select timestamp'2018-03-11 02:00:00' as ts")
    assert C.standardize_times(d, "US/Central").collect()[0]["ts"] == datetime(2018, 3, 11, 2)


def test_conform(spark):
    d = spark.createDataFrame([(7, "  ICU ", "x")], "hospitalization_id int, location_category string, note string")
    r = S.conform(d).collect()[0]
    assert r["hospitalization_id"] == "7" and r["location_category"] == "icu" and r["note"] == "x"


@pytest.fixture
def source(spark, tmp_path):
    path = str(tmp_path / "labs.parquet")
    spark.range(50).select(F.format_string("H%05d", "id").alias("hospitalization_id"), F.explode(F.array(*[F.lit(float(i)) for i in range(3)])).alias("lab_value")).repartition(3).write.parquet(path)
    return spark.read.parquet(path)


def ids(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "hospitalization_id string")


def test_subset(spark, source, tmp_path):
    out = str(tmp_path / "out")
    assert S.subset_to_cohort(source, ids(spark, "H00001", "H00002", "H00002", "nobody"), "hospitalization_id", out) == (150, 6)
    assert spark.read.parquet(out).select("hospitalization_id").distinct().count() == 2


def test_subset_projection_keeps_id(spark, source, tmp_path):
    out = str(tmp_path / "out")
    S.subset_to_cohort(source, ids(spark, "H00001"), "hospitalization_id", out, ["no_such", "lab_value"])
    assert spark.read.parquet(out).columns == ["hospitalization_id", "lab_value"]


def test_empty_subset_has_schema(spark, source, tmp_path):
    out = str(tmp_path / "out")
    assert S.subset_to_cohort(source, ids(spark, "x").limit(0), "hospitalization_id", out) == (150, 0)
    assert spark.read.parquet(out).schema == source.schema and spark.read.parquet(out).count() == 0


def test_missing_id_column(spark, source, tmp_path):
    with pytest.raises(ValueError):
        S.subset_to_cohort(source, ids(spark, "x"), "encounter_id", str(tmp_path / "o"))


def test_missing_file_is_none(spark, tmp_path):
    assert S.find_table(spark, str(tmp_path), "labs") is None


def test_definition_hash():
    a = S.definition_hash("1", {"x": 1, "y": [1, 2]})
    assert a == S.definition_hash("1", {"y": [1, 2], "x": 1})
    assert len({a, S.definition_hash("2", {"x": 1, "y": [1, 2]}), S.definition_hash("1", {"x": 2, "y": [1, 2]})}) == 3


def test_cache(spark, source, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return ids(spark, "H00003")
    out = str(tmp_path / "cache")
    run = lambda **k: S.cached_subset(spark, source, make, "hospitalization_id", out, "1", {"a": 1}, **k)[1]
    assert [run(), run(), run(force_refresh=True)] == [False, True, False] and len(calls) == 2
    source.limit(3).write.mode("append").parquet(str(tmp_path / "labs.parquet"))
    again = spark.read.parquet(str(tmp_path / "labs.parquet"))
    assert S.cached_subset(spark, again, make, "hospitalization_id", out, "1", {"a": 1})[1] is False
