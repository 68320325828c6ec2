"""Table One for many overlapping strata and all years at once.

An encounter carries its strata as one bit mask. Everything is counted once per (mask, year, line,
value), combined before the shuffle, and only the counts are expanded to strata: shuffled rows do
not grow with the number of strata. Patients are counted by the union of their encounters'
masks. Medians are exact: counted values are cut in slices, slice totals per stratum say which slices
hold the wanted ranks, and only their values meet the strata.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bedside.functions.expr import count_when, pct, union_all
from bedside.functions.ordered import value_slice
from bedside.operators.report import BLOCK, Row
from bedside.sources.tables import materialise

OVERALL = "Overall"
PROBS = {"median": 0.5, "q1": 0.25, "q3": 0.75}
KEYS = ["stratum", "col"]


def strata_mask(strata: dict[str, str]) -> Column:
    """Bit i says that the i-th stratum's flag is 1."""
    if len(strata) > 62:
        raise ValueError("a mask holds at most 62 strata")
    out = F.lit(0).cast("long")
    for i, c in enumerate(strata.values()):
        out = out + F.when(F.col(c) == 1, F.lit(1 << i)).otherwise(F.lit(0)).cast("long")
    return out


def _bit(i: Column | int) -> Column:
    return F.col("_mask").bitwiseAND(F.expr(f"shiftleft(1L, {i})") if isinstance(i, int) else F.call_function("shiftleft", F.lit(1).cast("long"), i)) != 0


def _members(strata: dict[str, str]) -> Column:
    """One row per stratum of the mask."""
    return F.explode(F.array_compact(F.array(*[F.when(_bit(i), F.lit(s)) for i, s in enumerate(strata)]))).alias("stratum")


def _expand(counts: DataFrame, strata: dict[str, str], keys: list[str], sums: list[str]) -> DataFrame:
    """Counts per mask and ``col`` as sums per stratum and ``col``."""
    return counts.select("*", _members(strata)).groupBy(*KEYS, *keys).agg(*[F.sum(c).alias(c) for c in sums])


def _with_overall(df: DataFrame) -> DataFrame:
    return df.withColumn("col", F.explode(F.array(F.lit(OVERALL), F.col("_group"))))


def _cols(df: DataFrame, keys: list[str], mask: Column) -> DataFrame:
    """(keys, col, _mask): unions of masks per key and group, and per key over all groups."""
    part = df.groupBy(*keys, "_group").agg(mask.alias("_mask"))
    return part.withColumnRenamed("_group", "col").unionByName(
        part.groupBy(*keys).agg(F.bit_or("_mask").alias("_mask")).withColumn("col", F.lit(OVERALL)))


def table_one(enc: DataFrame, rows: list[Row], strata: dict[str, str], group: str | None = None, block: str = BLOCK,
              patient: str = "patient_id") -> DataFrame:
    """Numeric Table One per stratum (name to flag column) and, with ``group``, per value of it beside 'Overall'.
    Columns stratum, col, pos, label, kind, n, denom, median, q1, q3, pct. A line whose column
    is absent is an error."""
    absent = sorted({c for r in rows for c in (r.column, r.within) if c and c not in enc.columns} | {c for c in strata.values() if c not in enc.columns})
    if absent:
        raise ValueError(f"no columns {', '.join(absent)}")
    rows = list(enumerate(rows))
    inside = lambda r: F.lit(True) if r.within is None else F.col(r.within) == 1
    e = enc.withColumns({"_mask": strata_mask(strata), "_group": F.col(group).cast("string") if group else F.lit(None).cast("string")}).where("_mask != 0")
    cols = _with_overall if group else (lambda df: df.withColumn("col", F.lit(OVERALL)))
    parts = [_counts(e, rows, strata, cols, inside)]

    for i, r in rows:
        if r.kind == "distinct":
            seen = _distinct(e.where(F.col(r.column).isNotNull()), [r.column], group)
            n = _expand(seen.groupBy("_mask", "col").agg(F.count(F.lit(1)).cast("double").alias("n")), strata, [], ["n"])
            parts.append(n.select(*KEYS, F.lit(i).alias("pos"), F.lit(r.label).alias("label"), F.lit("count").alias("kind"), "n"))

    item = lambda i, r: F.struct(F.lit(i).alias("pos"), F.lit(r.label).alias("title"), F.coalesce(F.col(r.column).cast("string"), F.lit("Missing")).alias("level"))
    own = [(i, r) for i, r in rows if r.kind == "levels" and not r.patient]
    if own:
        items = F.array_compact(F.array(*[F.when(inside(r), item(i, r)) for i, r in own]))
        long = e.select("_mask", "_group", F.explode(items).alias("_e")).groupBy("_mask", "_group", "_e").agg(F.count(F.lit(1)).cast("double").alias("n"))
        parts.append(_shares(_expand(cols(long), strata, ["_e"], ["n"])))
    shared = [(i, r) for i, r in rows if r.kind == "levels" and r.patient]
    if shared:
        parts.append(_shares(_patient_levels(e, shared, strata, group, block, patient, item)))
    medians = [(i, r) for i, r in rows if r.kind == "median"]
    if medians:
        parts.append(_medians(e, medians, strata, cols, inside))
    return union_all(parts).withColumn("pct", pct(F.col("n"), F.col("denom")))


def _counts(e, rows, strata, cols, inside):
    null = F.lit(None).cast("double")
    aggs, items = [F.count(F.lit(1)).cast("double").alias("_all")], []
    for i, r in rows:
        if r.kind not in ("count", "sum", "flag", "header"):
            continue
        denom = null
        if r.kind != "header":
            n = {"count": lambda: F.count(F.lit(1)), "sum": lambda: F.sum(F.col(r.column).cast("double")),
                 "flag": lambda: count_when(inside(r) & (F.col(r.column) == 1))}[r.kind]()
            aggs.append(n.cast("double").alias(f"n{i}"))
        if r.kind == "flag":
            denom = F.col("_all")
            if r.within is not None:
                aggs.append(count_when(inside(r)).cast("double").alias(f"d{i}"))
                denom = F.col(f"d{i}")
        items.append(F.struct(F.lit(i).alias("pos"), F.lit(r.label).alias("label"), F.lit(r.kind).alias("kind"),
                              (null if r.kind == "header" else F.col(f"n{i}")).alias("n"), denom.alias("denom")))
    wide = e.groupBy("_mask", "_group").agg(*aggs)
    wide = _expand(cols(wide), strata, [], [c for c in wide.columns if c not in ("_mask", "_group")])
    return wide.select(*KEYS, F.explode(F.array(*items)).alias("_r")).select(*KEYS, "_r.*")


def _distinct(e, keys, group):
    if group:
        return _cols(e, keys, F.bit_or("_mask"))
    return e.groupBy(*keys).agg(F.bit_or("_mask").alias("_mask")).withColumn("col", F.lit(OVERALL))


def _patient_levels(e, shared, strata, group, block, patient, item):
    """Levels of each patient's first encounter in a stratum and column. Where all encounters of a
    patient agree, the union of their masks says all; the others are looked at per stratum."""
    e = e.select("_mask", "_group", F.col(patient).alias("_patient"), F.col(block).alias("_block"), F.array(*[item(i, r) for i, r in shared]).alias("_levels"))
    by = e.groupBy("_patient", "_group").agg(F.bit_or("_mask").alias("_mask"), F.min("_levels").alias("_lo"), F.max("_levels").alias("_hi"))
    by = materialise(by, "patients")
    per = by.groupBy("_patient").agg(F.bit_or("_mask").alias("_mask"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).withColumn("col", F.lit(OVERALL))
    if group:
        per = per.unionByName(by.withColumnRenamed("_group", "col"))
    same = per.where("_lo = _hi").groupBy("_mask", "col", F.col("_lo").alias("_levels")).agg(F.count(F.lit(1)).cast("double").alias("n"))
    same = _expand(same.select("_mask", "col", "n", F.explode("_levels").alias("_e")), strata, ["_e"], ["n"])
    mixed = by.groupBy("_patient").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi")).where("_lo != _hi").select("_patient")
    odd = e.join(mixed.withColumnRenamed("_patient", "_p"), F.col("_patient").eqNullSafe(F.col("_p")), "left_semi")
    odd = (_with_overall(odd) if group else odd.withColumn("col", F.lit(OVERALL))).select("*", _members(strata))
    odd = odd.groupBy(*KEYS, "_patient").agg(F.min_by("_levels", F.struct("_block", "_levels")).alias("_levels"), F.min("_levels").alias("_lo"), F.max("_levels").alias("_hi"))
    # patients whose encounters of this column agree were counted above, in their years
    agree = per.where("_lo = _hi").select(F.col("_patient").alias("_p"), F.col("col").alias("_c"))
    odd = odd.join(agree, F.col("_patient").eqNullSafe(F.col("_p")) & F.col("col").eqNullSafe(F.col("_c")), "left_anti")
    odd = odd.select(*KEYS, F.explode("_levels").alias("_e")).groupBy(*KEYS, "_e").agg(F.count(F.lit(1)).cast("double").alias("n"))
    return same.unionByName(odd).groupBy(*KEYS, "_e").agg(F.sum("n").alias("n"))


def _shares(counts):
    total = Window.partitionBy(*KEYS, "_e.pos")
    return counts.withColumn("denom", F.sum("n").over(total)).select(
        *KEYS, "_e.pos", F.concat("_e.title", F.lit(": "), "_e.level").alias("label"), F.lit("flag").alias("kind"), "n", "denom")


def _medians(e, medians, strata, cols, inside):
    items = F.array(*[F.struct(F.lit(i).alias("pos"), F.when(inside(r), F.col(r.column).cast("double")).alias("v")) for i, r in medians])
    long = e.select("_mask", "_group", F.explode(items).alias("_e")).select("_mask", "_group", "_e.*").where("v is not null and not isnan(v)")
    values = cols(long.groupBy("pos", "_group", "v", "_mask").agg(F.count(F.lit(1)).alias("c")))
    values = materialise(values.select(F.struct("pos", "col").alias("_line"), value_slice("v").alias("_slice"), "v", "_mask", "c"), "values")
    seg = values.groupBy("_line", "_slice").agg(F.array(*[F.sum(F.when(_bit(i), F.col("c")).otherwise(F.lit(0))) for i in range(len(strata))]).alias("_n"))
    seg = seg.select("_line", "_slice", F.posexplode("_n").alias("_s", "_c")).where("_c > 0")
    whole = Window.partitionBy("_line", "_s")
    seg = seg.withColumns({"_n": F.sum("_c").over(whole), "_b": F.coalesce(F.sum("_c").over(
        whole.orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    rank = {p: (F.col("_n") - 1) * F.lit(p) for p in PROBS.values()}
    hit = F.lit(False)
    for h in rank.values():
        hit = hit | ((F.col("_b") <= F.ceil(h)) & (F.floor(h) < F.col("_b") + F.col("_c")))
    hits = materialise(seg.where(hit).drop("_c"), "hits")
    near = values.join(hits, ["_line", "_slice"]).where(_bit(F.col("_s")))
    w = Window.partitionBy("_line", "_slice", "_s").orderBy("v", "_mask").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("_hi", F.col("_b") + F.sum("c").over(w)).withColumn("_lo", F.col("_hi") - F.col("c"))
    at = lambda r: F.max(F.when((F.col("_lo") <= r) & (r < F.col("_hi")), F.col("v")))
    aggs = [F.max("_n").alias("_n")]
    for name, p in PROBS.items():
        aggs += [at(F.floor(rank[p])).alias(f"_l{name}"), at(F.ceil(rank[p])).alias(f"_h{name}")]
    q = near.groupBy("_line", "_s").agg(*aggs)
    out = []
    for name, p in PROBS.items():
        a, b = F.col(f"_l{name}"), F.col(f"_h{name}")
        out.append((a + (b - a) * (rank[p] - F.floor(rank[p]))).alias(name))
    label = F.element_at(F.create_map(*[F.lit(x) for i, r in medians for x in (i, r.label)]), F.col("_line.pos"))
    stratum = F.element_at(F.array(*[F.lit(s) for s in strata]), F.col("_s") + 1)
    return q.select(stratum.alias("stratum"), "_line.col", "_line.pos", label.alias("label"), F.lit("median").alias("kind"), F.col("_n").cast("double").alias("n"), *out)
