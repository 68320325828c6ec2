"""Scans, subsets and sinks (A)."""

from pyspark.sql import functions as F

from bedside.plans import views as V
from bedside.plans.registry import query
from bedside.sources import tables as S


@query("a1_resolve_table", sql="""SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_ids, 1 AS absent_is_none FROM events""")
def a1(spark, sf):
    found = S.find_table(spark, sf, "events", prefixes=("site_", ""))
    missing = S.find_table(spark, sf, "no_such_table", prefixes=("site_", ""))
    return found.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_ids"),
                     F.lit(1 if missing is None else 0).alias("absent_is_none"))


@query("a2_typed_load", sql="""SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(user_id AS VARCHAR) AS user_id,
  epoch_us(timezone('UTC', timezone('US/Central', ts))) AS ts_us, lower(trim(event_type)) AS event_type FROM events""")
def a2(spark, sf):
    S.prepare(spark)
    raw = spark.read.parquet(f"{sf}/events.parquet")
    d = S.conform(raw, "US/Central", {"event_type": "category"})
    return d.select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("ts_us"), "event_type")


@query("a3_filtered_scan", sql="""SELECT event_id, user_id, value FROM events WHERE event_type IN ('view', 'error')
  AND user_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""")
def a3(spark, sf):
    ids = V.table(spark, sf, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    return S.scan(V.table(spark, sf, "events"), ["event_id", "user_id", "value", "no_such_column"],
                  {"event_type": ["view", "error"]}, ids)


COHORT = "o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R' AND l_quantity > 45)"


def _ids(spark, sf):
    return V.table(spark, sf, "lineitem").where("l_returnflag = 'R' and l_quantity > 45").select(
        F.col("l_orderkey").alias("o_orderkey"))


@query("a4_cohort_subset", sql=f"""SELECT count(*) AS rows_kept, round(sum(o_totalprice), 2) AS total,
  (SELECT count(*) FROM orders) AS rows_read FROM orders WHERE {COHORT}""")
def a4(spark, sf):
    dest = S.scratch(spark, "subset")
    read, kept = S.subset_to_cohort(V.table(spark, sf, "orders"), _ids(spark, sf), "o_orderkey", dest, ["o_totalprice"])
    return spark.read.parquet(dest).agg(F.count(F.lit(1)).alias("rows_kept"), F.round(F.sum("o_totalprice"), 2).alias("total"),
                                        F.lit(read).cast("long").alias("rows_read"))


@query("a5_cached_subset", sql=f"""SELECT count(*) AS n, 0 AS first_reused, 1 AS second_reused, 0 AS changed_reused
  FROM orders WHERE {COHORT}""")
def a5(spark, sf):
    src, dest = spark.read.parquet(f"{sf}/orders.parquet"), S.scratch(spark, "cached")
    run = lambda p: S.cached_subset(spark, src, lambda: _ids(spark, sf), "o_orderkey", dest, "1", p)
    _, first = run({"flag": "R", "min": 45})
    _, second = run({"min": 45, "flag": "R"})
    out, third = run({"flag": "R", "min": 46})
    return out.agg(F.count(F.lit(1)).alias("n"), F.lit(int(first)).alias("first_reused"),
                   F.lit(int(second)).alias("second_reused"), F.lit(int(third)).alias("changed_reused"))


@query("a6_table_metadata", sql="""SELECT table_name AS "table", column_name AS "column", (column_index) AS position, n_rows FROM
  (SELECT 'nation' AS table_name, unnest(['n_nationkey', 'n_name', 'n_regionkey']) AS column_name, unnest([0, 1, 2]) AS column_index,
    (SELECT count(*) FROM nation) AS n_rows UNION ALL SELECT 'labels', unnest(['doc_id', 'quality', 'toxic']), unnest([0, 1, 2]),
    (SELECT count(*) FROM labels))""")
def a6(spark, sf):
    return S.table_metadata(spark, {t: V.table(spark, sf, t) for t in ("nation", "labels")}).drop("type")


@query("a7_statistics_sink", sql="""SELECT 'csv' AS kind, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events GROUP BY 2
  UNION ALL SELECT 'json', event_type, count(*), round(avg(value), 6) FROM events GROUP BY 2""")
def a7(spark, sf):
    stats = V.table(spark, sf, "events").groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    dest = S.scratch(spark, "stats")
    S.write_stats(stats, dest)
    schema = "event_type string, n long, mean double"
    return (spark.read.schema(schema).option("header", True).csv(f"{dest}/csv").withColumn("kind", F.lit("csv"))
            .unionByName(spark.read.schema(schema).json(f"{dest}/json").withColumn("kind", F.lit("json"))))


@query("a8_stratum_output", views="visit", sql="""SELECT split_part(s, '/', 1) AS stratum,
  CASE WHEN contains(s, '/') THEN split_part(s, '/', 2) ELSE 'all' END AS sub_stratum, count(*) AS n FROM
  (SELECT unnest(['icu', 'icu/' || location_category]) AS s FROM visit) GROUP BY ALL""")
def a8(spark, sf):
    v = V.visit(spark, sf).select(F.explode(F.array(F.lit("icu"), F.concat(F.lit("icu/"), "location_category"))).alias("stratum"))
    counts = v.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"))
    dest = S.scratch(spark, "strata")
    S.write_by_stratum(counts, dest)
    return spark.read.parquet(dest).select("stratum", "sub_stratum", "n")


@query("a9_separate_sinks", views="visit", sql="""SELECT 'final' AS root, count(*) AS n FROM (SELECT DISTINCT location_category FROM visit)
  UNION ALL SELECT 'intermediate', count(*) FROM visit""")
def a9(spark, sf):
    v = V.visit(spark, sf)
    base = S.scratch(spark, "sinks")
    S.write_separate(v, v.groupBy("location_category").agg(F.count(F.lit(1)).alias("n")),
                     f"{base}/intermediate", f"{base}/final", "visits")
    return (spark.read.parquet(f"{base}/final/visits").agg(F.lit("final").alias("root"), F.count(F.lit(1)).alias("n"))
            .union(spark.read.parquet(f"{base}/intermediate/visits").agg(F.lit("intermediate"), F.count(F.lit(1)))))


