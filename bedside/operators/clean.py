"""Filters, outlier rules, unit rules and category grouping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.functions.expr import count_when, first_by, lookup, norm, pct
from bedside.sources.tables import to_utc

# Ventilator mode groups.
MODE_GROUPS = {
    "assist control-volume control": "Assist Control-Volume Control",
    "pressure-regulated volume control": "Pressure-Regulated Volume Control",
    "simv": "SIMV",
    "pressure support/cpap": "Pressure Support/CPAP",
    "pressure support": "Pressure Support/CPAP",
    "cpap": "Pressure Support/CPAP",
    "pressure control": "Pressure Control",
}
# Simplified locations.
LOCATIONS = {"icu": "ICU", "ward": "Ward", "ed": "ED", "procedural": "Procedural"}
NO_UNITS = "(no units)"


def adults(df: DataFrame, age: str = "age_at_admission", minimum: int = 18) -> DataFrame:
    return df.where(F.col(age).isNotNull() & (F.col(age) >= minimum))


def standardize_times(df: DataFrame, timezone: str, cols: list[str] | None = None) -> DataFrame:
    """Naive wall times are read in the site zone (gap -> null, overlap -> earlier);
    zoned instants stay as they are. All come out as UTC instants."""
    picked = [c for c, t in df.dtypes if t == "timestamp_ntz" and (cols is None or c in cols)]
    return df.withColumns({c: to_utc(F.col(c), timezone) for c in picked})


def in_range(c: str, low, high) -> Column:
    cond = F.lit(True)
    if low is not None:
        cond = cond & (F.col(c) >= F.lit(low))
    if high is not None:
        cond = cond & (F.col(c) <= F.lit(high))
    return cond


def null_outliers(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Values outside their column's inclusive range become null."""
    return df.withColumns({c: F.when(in_range(c, lo, hi), F.col(c))
                           for c, (lo, hi) in ranges.items() if c in df.columns})


def outlier_statistics(df: DataFrame, ranges: dict[str, tuple]) -> DataFrame:
    """Valid and outlier counts per column, all columns in one pass."""
    present = {c: r for c, r in ranges.items() if c in df.columns}
    wide = df.agg(*[x for c, (lo, hi) in present.items() for x in (
        F.count(c).alias(f"{c}__n"), count_when(~in_range(c, lo, hi)).alias(f"{c}__o"))])
    rows = F.array(*[F.struct(
        F.lit(c).alias("column"), F.col(f"{c}__n").alias("valid_count"), F.col(f"{c}__o").alias("outlier_count"),
        F.lit(lo).cast("double").alias("min_threshold"), F.lit(hi).cast("double").alias("max_threshold"))
        for c, (lo, hi) in present.items()])
    return wide.select(F.explode(rows).alias("r")).select("r.*").withColumn(
        "outlier_pct", F.round(F.coalesce(pct(F.col("outlier_count"), F.col("valid_count")), F.lit(0.0)), 2))


def range_table(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    """(category, unit, low, high) rules; unit null means any unit."""
    return spark.createDataFrame(rows, "category string, unit string, low double, high double")


def null_outliers_by_category(df: DataFrame, rules: DataFrame, value: str, category: str,
                              unit: str | None = None) -> DataFrame:
    """Outlier rule looked up by category, or by category and unit; a rule for the unit goes
    before one for any unit. Rows without a rule keep their value, and no row is doubled: of several
    rules for one category and unit (or, without ``unit``, for one category) the widest range counts."""
    r = rules.select(F.lower(F.trim("category")).alias("_rc"), F.lower(F.trim("unit")).alias("_ru"), "low", "high")

    def widest(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
        every = F.count(F.lit(1))  # an open end of any rule stays open
        return rows.groupBy(*keys).agg(F.struct(F.when(F.count("low") == every, F.min("low")).alias("low"),
                                                F.when(F.count("high") == every, F.max("high")).alias("high")).alias(name))

    if unit is None:
        j = df.join(widest(r, ["_rc"], "_rule"), norm(category) == F.col("_rc"), "left").drop("_rc")
    else:
        special = widest(r.where("_ru IS NOT NULL"), ["_rc", "_ru"], "_special")
        general = widest(r.where("_ru IS NULL"), ["_rc"], "_general")
        j = (df.join(special, (norm(category) == F.col("_rc")) & (norm(unit) == F.col("_ru")), "left").drop("_rc", "_ru")
             .join(general, norm(category) == F.col("_rc"), "left").drop("_rc")
             .withColumn("_rule", F.coalesce("_special", "_general")).drop("_special", "_general"))
    keep = F.col("_rule").isNull() | ((F.col("_rule.low").isNull() | (F.col(value) >= F.col("_rule.low")))
                                      & (F.col("_rule.high").isNull() | (F.col(value) <= F.col("_rule.high"))))
    return j.withColumn(value, F.when(keep, F.col(value))).drop("_rule")


def remove_outliers(df: DataFrame, value: str, low: float, high: float) -> DataFrame:
    return df.where(F.col(value).between(low, high))


def removal_counts(df: DataFrame, value: str, low: float, high: float, keys: list[str]) -> DataFrame:
    """Rows before, removed and left when values outside the range are dropped."""
    kept = count_when(F.col(value).between(low, high))
    n = F.count(F.lit(1))
    return df.where(F.col(value).isNotNull()).groupBy(*keys).agg(
        n.alias("original"), (n - kept).alias("removed"), kept.alias("remaining"))


def unit_label(unit: str) -> Column:
    """Normalised unit; null and blank read as '(no units)'."""
    u = norm(unit)
    return F.when(u.isNull() | (u == ""), NO_UNITS).otherwise(u)


def unit_is(unit: str, wanted: list[str]) -> Column:
    return unit_label(unit).isin([w.strip().lower() for w in wanted])


def simple_location(location: str) -> Column:
    return lookup(F.lower(F.col(location)), LOCATIONS, "Other")


def mode_group(mode: str) -> Column:
    return lookup(F.lower(F.col(mode)), MODE_GROUPS, "Other")


def admission_years(df: DataFrame, keys: list[str], start: str = "admission_dttm") -> DataFrame:
    """Year of the earliest admission; 0 when unknown."""
    return df.groupBy(*keys).agg(F.coalesce(F.year(F.min(start)), F.lit(0)).alias("admission_year"))


def drop_small_years(df: DataFrame, year: str, encounter: str, minimum: int = 10) -> DataFrame:
    per = df.select(year, encounter).distinct().groupBy(year).agg(F.count(F.lit(1)).alias("_n"))
    return df.join(per.where(F.col("_n") >= minimum).select(year), year, "left_semi")


def first_row(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the first by ``order``."""
    return first_by(df, keys, order)


def duplicate_count(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that repeat an earlier row's key."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                   F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"))


def value_from_text(number: str, text: str) -> Column:
    """Number column, else the text column read as a number."""
    return F.coalesce(F.col(number), F.expr(f"try_cast(`{text}` AS double)"))


def stack(df: DataFrame, keys: list[str], cols: list[str], name: str = "metric",
          value: str = "value") -> DataFrame:
    """Wide measurement columns to (keys, metric, value) without nulls."""
    e = F.explode(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias(value)) for c in cols]))
    return df.select(*keys, e.alias("_e")).select(*keys, f"_e.{name}", f"_e.{value}").where(
        F.col(value).isNotNull())
