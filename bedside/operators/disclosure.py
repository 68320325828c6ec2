"""Small-cell disclosure control on result tables.

A result table is long: (table, pos, label, column, cell). ``table`` names the output,
``pos`` is the row position, ``column`` the stratum column and ``cell`` the shown text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bedside.functions.expr import as_col, count_when

# Shape of a count cell, default threshold and token, exempt variables.
COUNT_CELL = r"^\s*(\d[\d,]*)\s*(?:\(([\d.]+)\s*%\))?\s*$"
THRESHOLD, TOKEN, EXEMPT = 10, "<10", ["N"]
GROUP = ["table", "column", "variable"]


def cell_count(cell) -> Column:
    """Count of a cell like '1,234 (5.6%)'; null when it is not a count."""
    n = F.regexp_extract(as_col(cell), COUNT_CELL, 1)
    return F.when(n != "", F.regexp_replace(n, ",", "").cast("long"))


def cell_percent(cell) -> Column:
    p = F.regexp_extract(as_col(cell), COUNT_CELL, 2)
    return F.when(p != "", p.cast("double"))


def label_variable(label) -> Column:
    """'Race' of 'Race: White'; '' when the label has no prefix."""
    c = as_col(label)
    return F.when(c.contains(": "), F.trim(F.substring_index(c, ": ", 1))).otherwise("")


def label_value(label) -> Column:
    c = as_col(label)
    return F.when(c.contains(": "), F.trim(F.expr("substring(`{0}`, instr(`{0}`, ': ') + 2)".format(label)))).otherwise(c)


def count_text(n, pct=None) -> Column:
    """'1,234' or '1,234 (5.6%)'."""
    text = F.format_number(as_col(n), 0)
    if pct is None:
        return text
    p = as_col(pct)
    return F.when(p.isNull(), text).otherwise(F.concat(text, F.format_string(" (%.1f%%)", F.bround(p, 1))))


def parsed(table: DataFrame) -> DataFrame:
    return table.withColumns({"variable": label_variable("label"), "value": label_value("label"),
                              "n": cell_count("cell"), "pct": cell_percent("cell")})


def merge_levels(table: DataFrame, rules: DataFrame, recompute: bool = True) -> DataFrame:
    """Listed levels of a variable become one row at the place of the first of them. Counts
    add up; the percentage is rebuilt from the first source row that shows one. Without
    any count the merged cell is blank. ``rules`` is (variable, merged_label, source_value)."""
    r = rules.select("variable", F.col("source_value").alias("value"), "merged_label")
    p = parsed(table).join(r, ["variable", "value"], "left")
    keep = p.where("merged_label is null").select("table", "pos", "label", "column", "cell", "n", "pct")
    g = p.where("merged_label is not null").groupBy("table", "column", "variable", "merged_label").agg(
        F.min("pos").alias("pos"), F.sum("n").alias("n"), F.min_by(F.struct("n", "pct"), F.when(F.col("pct").isNotNull(), F.col("pos"))).alias("_s"))
    # the merged row sits where its first source sat in any column
    at = p.where("merged_label is not null").groupBy("table", "variable", "merged_label").agg(F.min("pos").alias("_p"))
    total = F.when(F.col("_s.pct") > 0, F.col("_s.n") / F.col("_s.pct") * 100)
    pct = F.col("n") / total * 100 if recompute else F.lit(None).cast("double")
    merged = g.drop("pos").join(at, ["table", "variable", "merged_label"]).withColumn("pct", pct).select(
        "table", F.col("_p").alias("pos"), F.concat("variable", F.lit(": "), "merged_label").alias("label"), "column",
        F.when(F.col("n").isNull(), "").otherwise(count_text("n", "pct")).alias("cell"), "n", "pct")
    return keep.unionByName(merged)


def suppression_plan(table: DataFrame, threshold: int = THRESHOLD, complementary: bool = False) -> DataFrame:
    """Every cell with its reason: 'small', 'group' (whole group below the threshold),
    'complementary' (smallest sibling of a lone small cell) or null. Unprefixed rows of a
    table form one group; rows of the exempt variables are left alone."""
    p = parsed(table.select("table", "pos", "label", "column", "cell"))
    small = (F.col("n") > 0) & (F.col("n") < threshold)
    g = p.where(F.col("n").isNotNull()).groupBy(*GROUP).agg(
        F.sum("n").alias("_total"), count_when(small).alias("_small"), F.min_by("pos", F.when(small, F.struct("n", "pos"))).alias("_victim"),
        F.min_by("pos", F.when(~small, F.struct("n", "pos"))).alias("_sibling"))
    j = p.join(g, GROUP, "left")
    whole = (F.col("_total") > 0) & (F.col("_total") < threshold)
    lone = (F.col("_small") == 1) & F.lit(complementary)
    reason = (F.when(F.col("variable").isin(EXEMPT) | F.col("n").isNull() | (F.coalesce(F.col("_small"), F.lit(0)) == 0), F.lit(None))
              .when(whole, "group").when(small, "small").when(lone & (F.col("pos") == F.col("_sibling")), "complementary"))
    target = F.when((reason == "small") & lone, F.col("_sibling")).when(reason == "complementary", F.col("_victim"))
    return j.withColumns({"reason": reason, "partner_pos": target}).drop("_total", "_small", "_victim", "_sibling")


def suppress(table: DataFrame, threshold: int = THRESHOLD, token: str = TOKEN, complementary: bool = False) -> DataFrame:
    p = suppression_plan(table, threshold, complementary)
    return p.select("table", "pos", "label", "column", F.when(F.col("reason").isNotNull(), token).otherwise(F.col("cell")).alias("cell"))


def merge_and_suppress(table: DataFrame, rules: DataFrame, threshold: int = THRESHOLD, token: str = TOKEN,
                       complementary: bool = False, recompute: bool = True) -> DataFrame:
    return suppress(merge_levels(table, rules, recompute), threshold, token, complementary)


def small_cells(table: DataFrame, rules: DataFrame, threshold: int = THRESHOLD, complementary: bool = False) -> DataFrame:
    """Cells still small after merging: raw and merged count, status and the sibling that
    complementary suppression would hide."""
    merged = merge_levels(table, rules)
    plan = suppression_plan(merged, threshold, complementary)
    raw = parsed(table).where(F.col("n").isNotNull()).groupBy("table", "column", "variable", "value").agg(F.max("n").alias("_raw"))
    hit = plan.where(F.col("reason").isin("small", "group") & (F.col("n") > 0) & (F.col("n") < threshold))
    j = hit.join(raw, ["table", "column", "variable", "value"], "left")
    labels = merged.select("table", F.col("pos").alias("partner_pos"), F.col("label").alias("complementary_target")).distinct()
    j = j.join(labels, ["table", "partner_pos"], "left")
    return j.select("table", "column", "variable", F.col("value").alias("row"), F.coalesce("_raw", "n").alias("raw_n"),
                    F.when(F.col("_raw").isNotNull(), F.col("n")).alias("merged_n"), F.when(F.col("_raw").isNull(), F.col("label")).alias("merged_label"),
                    F.when(F.col("reason") == "group", "group_suppressed").otherwise("still_small").alias("status"), "complementary_target")


def suppress_all(tables: DataFrame, rules: DataFrame, **options) -> DataFrame:
    """All result tables of a run in one job; every table keeps its layout."""
    return merge_and_suppress(tables, rules, **options)
