"""Pooling of result tables from several sites.

Inputs are long: one row per site and value. The pooled value of a metric follows a rule
that its name suggests.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bedside.functions.expr import attach, count_when, flag, pct
from bedside.functions.quantiles import with_quantiles
from bedside.operators.disclosure import count_text
from bedside.sources.tables import exists

# Name patterns of the pooling rules and order of the weight columns.
COUNT_NAME = (r"^(n|count|total_obs|total_observations|total_distinct_observations|total_number_of_stays|total_encounters|total_days|"
              r"total_hours|n_patients|n_encounters|n_deaths|n_stays|n_events|n_missing|distinct_encounters|missing|at_risk|"
              r"observed_events|expired_count|hospice_count|hospice_or_expired_count|hospice_or_expired|hospice|expired|count_value)$")
COUNT_SUFFIX = r"(_n|_count|_obs|_events|_stays|_encounters)$"
RATE_NAME = (r"(mean|pct|percent|percentage|proportion|rate|prevalence|per_1000|survival_prob|prob|events_per_hour|ci_lower|ci_upper|"
             r"ci_margin|capture_rate|combined_eol|hospice_among_eol|mortality)")
WEIGHTS = ["n", "n_encounters", "total_obs", "total_number_of_stays", "total_encounters", "count", "n_patients", "n_stays",
           "distinct_encounters", "total_observations"]
# Shapes of display cells and labels.
NUMBER = r"[-+]?[\d,]*\.?\d+"
CELL_N_PCT = rf"^\s*({NUMBER})\s*\(\s*({NUMBER})\s*%\s*\)\s*$"
CELL_MEDIAN = rf"^\s*({NUMBER})\s*\[\s*({NUMBER})\s*,\s*({NUMBER})\s*\]\s*$"
CELL_PLAIN = rf"^\s*({NUMBER})\s*$"
PATIENT_LABEL = r"(?i)^\s*(race|ethnicity|sex|gender|primary\s+language|language|insurance|payer)\b"
SIZE_LABEL = r"(?i)^(\s*n\b|.*\bunique patients\b|.*encounter blocks)"
SUM_LABEL = r"(?i)^\s*(total\b|number\b|count\b)|^_count\b"
DENOMINATOR_TOLERANCE = 0.05


def number(text) -> Column:
    """Number of a text cell with thousands separators."""
    return F.expr(f"try_cast(trim(replace({text}, ',', '')) AS double)")


def metric_rule(name) -> Column:
    """Pooling rule of a metric name; DEFAULT when the name says nothing."""
    n = F.lower(F.trim(name))
    return (F.when((n == "min") | n.endswith("_min") | n.startswith("min_"), "MIN")
            .when((n == "max") | n.endswith("_max") | n.startswith("max_"), "MAX")
            .when(n.rlike(r"(^|_)(q1|q25|q_1)$") | n.isin("q1_dose", "q1_stay_hours"), "QLOW")
            .when(n.rlike(r"(^|_)(q3|q75|q_3)$") | n.isin("q3_dose", "q3_stay_hours"), "QHIGH")
            .when(n.contains("median"), "MEDIAN").when(n.isin("sd", "std"), "SDW").when((n == "iqr") | n.endswith("_iqr"), "IQRW")
            .when(n.rlike(COUNT_NAME) | n.rlike(COUNT_SUFFIX), "SUM").when(n.rlike(RATE_NAME), "MEANW").otherwise("DEFAULT"))


def metric_rules(long: DataFrame) -> DataFrame:
    """Per metric: share of numeric cells, whether it is a value column (at least half
    numeric) and the rule, where DEFAULT and MEANW turn to SUM when every value is whole."""
    x = long.withColumn("_v", number("value"))
    m = x.groupBy("metric").agg(F.count("value").alias("n_cells"), F.count("_v").alias("n_numeric"),
                                F.coalesce(F.min(flag(F.col("_v") == F.bround("_v", 0)) + flag(F.col("_v").isNull())), F.lit(0)).alias("_whole"))
    base = metric_rule(F.col("metric"))
    rule = F.when(base.isin("DEFAULT", "MEANW") & (F.col("_whole") >= 1) & (F.col("n_numeric") > 0), "SUM").when(base == "DEFAULT", "MEANW").otherwise(base)
    return m.select("metric", "n_cells", "n_numeric", ((F.col("n_cells") > 0) & (F.col("n_numeric") >= 0.5 * F.col("n_cells"))).alias("is_value"), rule.alias("rule"))


def first_rows(long: DataFrame, keys: list[str], row: str, site: str = "site") -> DataFrame:
    """Cells of the first row (least ``row``) of each site and key; other rows go as a whole."""
    first = long.groupBy(site, *keys).agg(F.min(row).alias("_first"))
    same = F.lit(True)
    for c in (site, *keys):
        same = same & F.col(f"l.{c}").eqNullSafe(F.col(f"f.{c}"))
    hit = long.alias("l").join(first.alias("f"), same & F.col(f"l.{row}").eqNullSafe(F.col("f._first")))
    return hit.select("l.*").drop(row)


def pool_keyed(long: DataFrame, keys: list[str], site: str = "site", row: str | None = None) -> DataFrame:
    """Pooled value per key and metric. Means, medians and sds weight by the first known
    sample-size column; without one they stay null. A percentage with a count of the same
    stem is rebuilt from the counts, so it is exact. ``row`` numbers the rows of a site's table: of
    several rows of one key the first counts, whole. Without it a cell may be there once only, and two
    values of one cell fail the job: no site weighs double and no row is mixed from two."""
    if row is not None:
        long = first_rows(long, keys, row, site)
    once = long.groupBy(site, *keys, "metric").agg(F.min("value").alias("value"), F.max("value").alias("_max"))
    twice = F.raise_error(F.lit("a site has two values of one key and metric: number its rows")).cast("boolean")
    long = once.where(F.when(F.col("value") != F.col("_max"), twice).otherwise(F.lit(True))).drop("_max")
    rules = metric_rules(long).where("is_value").select("metric", "rule")
    x = long.withColumn("v", number("value")).join(rules, "metric").select(site, *keys, "metric", "rule", "v")
    order = F.array_position(F.array(*[F.lit(w) for w in WEIGHTS]), F.lower(F.col("metric")))
    weight = rules.where(order > 0).agg(F.min_by("metric", order).alias("_wm"))
    x = attach(x, weight)
    w = x.where(F.col("metric") == F.col("_wm")).select(site, *keys, F.col("v").alias("w"))
    stem = F.regexp_extract(F.lower(F.col("metric")), "^(.+)_n$", 1)
    pairs = x.where(stem != "").select(site, *keys, F.concat(stem, F.lit("_pct")).alias("_pm"), F.col("v").alias("pn"))
    has_pair = rules.where(stem != "").select(F.concat(stem, F.lit("_pct")).alias("_pm")).withColumn("_paired", F.lit(1))
    x = (x.withColumn("_pm", F.lower("metric")).join(w, [site, *keys], "left").join(pairs, [site, *keys, "_pm"], "left").join(has_pair, "_pm", "left"))
    good = F.col("v").isNotNull() & (F.col("w") > 0)
    g = x.groupBy(*keys, "metric", "rule", "_wm", "_paired").agg(
        F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.avg("v").alias("plain"),
        F.sum(F.when(good, F.col("v") * F.col("w"))).alias("vw"), F.sum(F.when(good, F.col("w"))).alias("sw"),
        F.sum("pn").alias("num"), F.sum(F.when(F.col("v") > 0, F.col("pn") / (F.col("v") / 100))).alias("den"), F.count(F.lit(1)).alias("n_sites"))
    weighted = F.when(F.col("_wm").isNotNull(), F.coalesce(F.col("vw") / F.col("sw"), F.col("plain")))
    exact = F.when(F.col("den") > 0, 100 * F.col("num") / F.col("den")).when(F.col("num") == 0, 0.0)
    pooled = (F.when(F.col("_paired") == 1, exact).when(F.col("rule") == "SUM", F.col("s")).when(F.col("rule").isin("MIN", "QLOW"), F.col("lo"))
              .when(F.col("rule").isin("MAX", "QHIGH", "IQRW"), F.col("hi")).otherwise(weighted))
    return g.select(*keys, "metric", "rule", "n_sites", pooled.alias("pooled"))


def with_site_columns(long: DataFrame, pooled: DataFrame, keys: list[str], sites: list[str], site: str = "site") -> DataFrame:
    """Pooled table with one value column per site in front."""
    per = long.groupBy(*keys, "metric").agg(*[F.max(F.when(F.col(site) == s, number("value"))).alias(f"value__{s}") for s in sites])
    return per.join(pooled.select(*keys, "metric", F.col("pooled").alias("value__ALL")), [*keys, "metric"])


def parse_display(cells: DataFrame) -> DataFrame:
    """Kind (n_pct, med_iqr, plain, text, blank) and numbers of display cells."""
    c = F.col("cell")
    part = lambda p, i: F.expr(f"try_cast(replace(regexp_extract(cell, '{p}', {i}), ',', '') AS double)".replace("\\", "\\\\"))
    blank = c.isNull() | (F.trim(c) == "") | (F.lower(F.trim(c)) == "nan")
    kind = (F.when(blank, "blank").when(c.rlike(CELL_N_PCT), "n_pct").when(c.rlike(CELL_MEDIAN), "med_iqr").when(c.rlike(CELL_PLAIN), "plain").otherwise("text"))
    d = cells.withColumn("kind", kind)
    of = lambda k, p, i: F.when(F.col("kind") == k, part(p, i))
    return d.withColumns({"n": F.coalesce(of("n_pct", CELL_N_PCT, 1), of("plain", CELL_PLAIN, 1)), "pct": of("n_pct", CELL_N_PCT, 2), "median": of("med_iqr", CELL_MEDIAN, 1),
                          "q1": of("med_iqr", CELL_MEDIAN, 2), "q3": of("med_iqr", CELL_MEDIAN, 3)})


def pool_display(cells: DataFrame, site: str = "site") -> DataFrame:
    """Pooled display table. Labels match without case but with their indent. Counts add up.
    n (%) divides by the labelled size row when the cell's own denominator is within 5 % of
    it, else by the recovered one. Medians are weighted by site size inside the envelope of
    the quartiles. ``cells`` is (site, pos, label, column, cell)."""
    p = parse_display(cells).withColumn("row_key", F.lower(F.rtrim("label")))
    size = lambda needle: F.col("row_key").contains(needle) & F.col("kind").isin("plain", "n_pct")
    ref = p.groupBy(site, "column").agg(
        F.min_by("n", F.when(size("unique patients"), F.col("pos"))).alias("_pat"), F.min_by("n", F.when(size("encounter blocks"), F.col("pos"))).alias("_enc"),
        F.max(F.when(F.col("row_key").rlike(SIZE_LABEL) & (F.col("kind") == "plain"), F.col("n"))).alias("_size"))
    p = p.join(ref, [site, "column"])
    exact = F.when(F.col("row_key").rlike(PATIENT_LABEL), F.col("_pat")).otherwise(F.col("_enc"))
    own = F.when(F.col("pct") > 0, F.col("n") / (F.col("pct") / 100))
    snap = (exact > 0) & (own.isNull() | (F.abs(own - exact) <= DENOMINATOR_TOLERANCE * exact))
    denom = F.when(F.col("kind") == "n_pct", F.when(snap, exact).otherwise(F.coalesce(own, F.when(exact > 0, exact))))
    w = F.coalesce(F.col("_size"), F.lit(1.0))
    of = lambda k: count_when(F.col("kind") == k)
    med = F.col("kind") == "med_iqr"
    g = p.withColumns({"_d": denom, "_w": w}).groupBy("row_key", "column").agg(
        F.min_by("label", F.struct("pos", site)).alias("label"), F.min("pos").alias("pos"), of("n_pct").alias("_k1"), of("med_iqr").alias("_k2"), of("plain").alias("_k3"),
        of("text").alias("_k4"), F.sum(F.when(F.col("kind") == "n_pct", F.col("n"))).alias("_np"), F.sum("_d").alias("_dp"), F.sum(F.when(F.col("kind") == "plain", F.col("n"))).alias("_nn"),
        (F.sum(F.when(med, F.col("median") * F.col("_w"))) / F.sum(F.when(med, F.col("_w")))).alias("median"), F.min("q1").alias("q1"), F.max("q3").alias("q3"))
    best = F.greatest("_k1", "_k2", "_k3", "_k4")
    dom = (F.when(best == 0, "blank").when(F.col("_k1") == best, "n_pct").when(F.col("_k2") == best, "med_iqr").when(F.col("_k3") == best, "plain").otherwise("text"))
    g = g.withColumn("kind", dom)
    is_med = F.col("kind") == "med_iqr"
    return g.select("row_key", "label", "pos", "column", "kind", F.when(F.col("kind") == "n_pct", F.col("_np")).when(F.col("kind") == "plain", F.col("_nn")).alias("n"),
                    F.when((F.col("kind") == "n_pct") & (F.col("_dp") > 0), 100 * F.col("_np") / F.col("_dp")).alias("pct"),
                    *[F.when(is_med, F.col(c)).alias(c) for c in ("median", "q1", "q3")])


def display_text(pooled: DataFrame) -> DataFrame:
    one = lambda c: F.regexp_replace(F.format_string("%.1f", F.bround(F.col(c), 1)), r"\.0$", "")
    text = (F.when(F.col("kind") == "med_iqr", F.concat(one("median"), F.lit(" ["), one("q1"), F.lit(", "), one("q3"), F.lit("]")))
            .when(F.col("kind").isin("n_pct", "plain"), count_text(F.bround("n", 0), "pct")).otherwise(""))
    return pooled.withColumn("cell", text)


def pool_comorbidities(rows: DataFrame, site: str = "site") -> DataFrame:
    """Counts over the recovered site denominators (median over the conditions of
    n / prevalence). ``rows`` is (site, comorbidity, n_patients, prevalence_percent)."""
    d = rows.withColumn("_d", F.when(F.col("prevalence_percent") > 0, F.col("n_patients") / (F.col("prevalence_percent") / 100)))
    den = with_quantiles(d, [site], [F.count("_d").alias("_c")], {"_d": {"_m": 0.5}}).agg(F.sum(F.bround("_m", 0)).alias("_den"))
    g = rows.groupBy("comorbidity").agg(F.coalesce(F.sum("n_patients"), F.lit(0)).alias("n_patients"))
    return attach(g, den).select("comorbidity", "n_patients", pct(F.col("n_patients"), F.col("_den")).alias("prevalence_percent"),
                                   (pct(F.col("n_patients"), F.col("_den")) * 10).alias("per_1000_hospitalizations"))


def pool_name_value(rows: DataFrame, force_sum: bool = False) -> DataFrame:
    """Count-like labels add up; rates and texts stay per site (null). ``rows`` is
    (site, label, value text)."""
    take = F.lit(True) if force_sum else F.col("label").rlike(SUM_LABEL)
    return rows.groupBy(F.trim("label").alias("label")).agg(F.sum(number("value")).alias("_s")).select("label", F.when(take, F.col("_s")).alias("pooled"))


def pool_crosstab(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """Sum of visible cells; hidden ones count as missing."""
    return rows.groupBy(*keys).agg(F.sum(number(text)).cast("long").alias("pooled"))


def pool_bins(rows: DataFrame, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """Counts added per bin key, shares recomputed (within ``by``)."""
    by = by or []
    g = rows.groupBy(*by, *keys).agg(F.sum("count").alias("count"))
    t = g.groupBy(*by).agg(F.sum("count").alias("_t"))
    g = g.join(t, by) if by else attach(g, t)
    return g.withColumn("percentage", pct(F.col("count"), F.col("_t"))).drop("_t")


def read_sites(spark: SparkSession, root: str, name: str, site: str = "site") -> DataFrame:
    """One result table of every site, with the site: from ``root/<name>`` partitioned by site as
    ``write_sites`` leaves it, else from ``root/<site>/final/<name>``."""
    if exists(spark, f"{root.rstrip('/')}/{name}"):
        return spark.read.parquet(f"{root.rstrip('/')}/{name}")
    df = spark.read.option("basePath", root.rstrip("/")).parquet(f"{root.rstrip('/')}/*/final/{name}")
    return df.withColumn(site, F.regexp_extract("_metadata.file_path", r"/([^/]+)/final/", 1))


def write_sites(df: DataFrame, root: str, name: str, site: str = "site") -> None:
    """The result table of all sites in one job, a folder per site whatever sites there are."""
    df.write.partitionBy(site).parquet(f"{root.rstrip('/')}/{name}")


# Benchmark metrics (name, section, kind, label beginnings).
BENCHMARK = [
    ("Hospitalizations", "Demographics", "count", "N: Hospitalizations"),
    ("Unique patients", "Demographics", "count", "N: Unique patients"),
    ("Age median", "Demographics", "median", "Age at admission"),
    ("Sex Male", "Demographics", "pct", "Sex: male"),
    ("Race White", "Demographics", "pct", "Race: white"),
    ("Race Black", "Demographics", "pct", "Race: black"),
    ("Hospital mortality", "Outcomes", "pct", "Hospital mortality"),
    ("Expired", "Outcomes", "pct", "Expired"),
    ("Discharged to hospice", "Outcomes", "pct", "Discharged to hospice"),
    ("ICU LOS median", "Outcomes", "median", "ICU length of stay"),
    ("Hospital LOS median", "Outcomes", "median", "Hospital length of stay"),
    ("CCI median", "Clinical Scores", "median", "Charlson Comorbidity Index"),
    ("Total SOFA median", "Clinical Scores", "median", "Total SOFA score"),
    ("Invasive MV", "Treatments", "pct", "Invasive mechanical ventilation"),
    ("Vasopressors", "Treatments", "pct", "Vasopressor encounters"),
    ("CRRT", "Treatments", "pct", "CRRT"),
    ("ICU encounters", "Encounter Types", "pct", "ICU encounters"),
    ("Advanced resp support", "Encounter Types", "pct", "Advanced respiratory support"),
]
PCT_POINTS, RELATIVE = 5.0, 0.25


def benchmark(own: DataFrame, reference: DataFrame, metrics: list[tuple] | None = None, minimum: int = 3) -> DataFrame:
    """Own result beside a reference: SIMILAR within 5 points (percent) or 25 % (others),
    else ABOVE or BELOW. Empty when fewer than ``minimum`` metrics match. Both sides are
    (pos, label, cell); a metric takes its first row whose label begins with the prefix."""
    metrics = metrics or BENCHMARK
    m = own.sparkSession.createDataFrame([(i, *x[:3]) for i, x in enumerate(metrics)], "ord int, metric string, section string, kind string")
    known = F.array(*[F.struct(F.lit(n).alias("metric"), F.lit(k).alias("kind"), F.lit(p.lower()).alias("prefix")) for n, _, k, p in metrics])

    def pick(rows, name):
        # the metric list is fixed and short, so each label is tested against it in place
        label = F.lower(F.ltrim("label"))
        d = parse_display(rows).withColumn("_m", F.explode(F.filter(known, lambda x: label.startswith(x["prefix"]))))
        k = F.col("_m.kind")
        v = F.when(k == "pct", F.col("pct")).when(k == "median", F.coalesce("median", "n")).otherwise(F.col("n"))
        return d.groupBy(F.col("_m.metric").alias("metric")).agg(F.min_by(v, "pos").alias(name))
    j = m.join(pick(own, "own_value"), "metric", "left").join(pick(reference, "ref_value"), "metric")
    o, r = F.col("own_value"), F.col("ref_value")
    near = F.when(F.col("kind") == "pct", F.abs(o - r) <= PCT_POINTS).when(r == 0, o <= 0).otherwise(F.abs(o - r) / r <= RELATIVE)
    verdict = F.when(o.isNull(), "N/A").when(F.col("kind") == "count", "").when(near, "SIMILAR").when(o > r, "ABOVE").otherwise("BELOW")
    out = j.select("ord", "section", "metric", "kind", "own_value", "ref_value", verdict.alias("verdict"))
    n = out.agg(F.count("own_value").alias("_n"))
    return attach(out, n).where(F.col("_n") >= minimum).drop("_n")


