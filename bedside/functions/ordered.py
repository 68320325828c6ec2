"""Ordered per-key calculations that stay balanced when one key is huge.

A plain ``Window.partitionBy(key)`` sends every row of a key to one task. Here a
key's rows are first cut into slices along the order column; the window runs per
(key, slice) and only one carry row per slice meets the other slices of its key.
Slices have a fixed width at first; those with more rows than
``spark.bedside.slice.rows`` are cut at quantiles of the order columns (``slices``).
Where no key has more rows than one task orders at ease (``slices.shallow``, counted first), the
plain window over whole keys gives the same columns in one shuffle and one sort.

Slices are a deterministic function of the row, so the detail and the carry rows
agree however often Spark recomputes them. The input feeds both sides, so several
passes in a row should start from a written table (``materialise``); otherwise the
first input would be read twice per pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from bedside.functions import slices

SLICE_HOURS = 24
SLICE_CONF = "spark.bedside.slice.hours"


def time_slice(ts: str, hours: float | None = None) -> Column:
    """Monotone slice number of a timestamp column. The session setting
    ``spark.bedside.slice.hours`` narrows the slices where a key is very dense."""
    if hours is None:
        hours = float(SparkSession.active().conf.get(SLICE_CONF, str(SLICE_HOURS)))
    return F.floor(F.unix_micros(F.col(ts)) / F.lit(int(hours * 3_600_000_000)))


def value_slice(v: str, per_unit: int = 1024) -> Column:
    """Monotone slice number of a double: about 0.1 % relative width.

    ``asinh`` maps every finite double into about [-710, 710], so a group has at
    most about 1.5 million slices whatever its number of rows.
    """
    return F.floor(F.asinh(F.col(v).cast("double")) * per_unit)


class Ordered:
    """Collects ordered columns and computes them in one two-level pass.

    ``order`` must be a total order inside a key (add a tie breaker column) and
    its first column must be the one ``slice_col`` was made from. Null keys are one
    key: keys are compared as one struct. ``apply(keep_slice=True)`` leaves key and slice in under names made of
    keys and order, so a following pass over the same finds its rows already placed and does
    not shuffle again, and a pass over others never mistakes them for its own. Keys that were not cut
    leave a mark instead, and the following pass does not count them again.
    """

    def __init__(self, df: DataFrame, keys: list[str], order: list[str],
                 slice_col: Column | None = None):
        self.df, self.keys, self.order = df, list(keys), list(order)
        # names that only a pass over the same keys and order can have left: no input column is taken for them
        self.key, self.slice = f"_key({', '.join(self.keys)})", f"_slice({', '.join([*self.keys, *self.order])})"
        self.whole = f"_whole({', '.join([*self.keys, *self.order])})"
        # a null order value sorts first, so it gets the lowest slice
        self.slice_col = F.coalesce(time_slice(order[0]) if slice_col is None else slice_col, F.lit(-(1 << 62)))
        self.ops: list[tuple] = []

    def _add(self, kind, name, col, k=1):
        self.ops.append((kind, name, F.col(col) if isinstance(col, str) else col, k))
        return self

    def lag(self, name, col, k=1):
        return self._add("lag", name, col, k)

    def lead(self, name, col, k=1):
        return self._add("lead", name, col, k)

    def fill(self, name, col):
        """Last non-null value at or before the row."""
        return self._add("fill", name, col)

    def fill_before(self, name, col):
        """Last non-null value strictly before the row."""
        return self._add("fillb", name, col)

    def fill_back(self, name, col):
        """First non-null value at or after the row."""
        return self._add("back", name, col)

    def cumsum(self, name, col):
        return self._add("sum", name, col)

    def total(self, name, col):
        """Sum over all rows of the key."""
        return self._add("total", name, col)

    def cummax(self, name, col):
        return self._add("max", name, col)

    def cummax_before(self, name, col):
        """Running maximum of the rows strictly before."""
        return self._add("maxb", name, col)

    def row_number(self, name):
        return self._add("sum", name, F.lit(1).cast("long"))

    def apply(self, keep_slice: bool = False) -> DataFrame:
        known = self.whole in self.df.columns
        if known or (self.slice not in self.df.columns and slices.shallow(self.df, self.keys)):
            return self._over_whole_keys(keep_slice)
        return self._over_slices(keep_slice)

    def _over_whole_keys(self, keep_slice: bool) -> DataFrame:
        part = [F.col(f"`{k}`") for k in self.keys] or [F.lit(0)]
        order = [F.col(f"`{o}`") for o in self.order]
        w = Window.partitionBy(*part).orderBy(*order)
        upto, earlier = (w.rowsBetween(Window.unboundedPreceding, end) for end in (0, -1))
        # a frame up to the last row is counted anew for every row, so later rows are looked at in reverse
        onward = Window.partitionBy(*part).orderBy(*[o.desc_nulls_last() for o in order]).rowsBetween(Window.unboundedPreceding, 0)
        column = {
            "lag": lambda c, k: F.lag(c, k).over(w), "lead": lambda c, k: F.lead(c, k).over(w),
            "fill": lambda c, k: F.last(c, True).over(upto), "fillb": lambda c, k: F.last(c, True).over(earlier),
            "back": lambda c, k: F.last(c, True).over(onward), "sum": lambda c, k: F.sum(c).over(upto),
            "total": lambda c, k: F.sum(c).over(Window.partitionBy(*part)), "max": lambda c, k: F.max(c).over(upto),
            "maxb": lambda c, k: F.max(c).over(earlier)}
        out = [F.col(f"`{c}`") for c in self.df.columns if c not in (self.slice, self.key, self.whole)]
        if keep_slice:
            out.append(F.lit(True).alias(self.whole))
        return self.df.select(*out, *[column[kind](c, k).alias(name) for kind, name, c, k in self.ops])

    def _over_slices(self, keep_slice: bool) -> DataFrame:
        part = [f"`{self.key}`", f"`{self.slice}`"]
        w = Window.partitionBy(*part).orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, 0)
        onward = w.rowsBetween(0, Window.unboundedFollowing)
        cols, tail, head = {"_rn": F.row_number().over(w)}, set(), set()
        for i, (kind, _, c, k) in enumerate(self.ops):
            if kind in ("lag", "lead"):
                boxed = F.struct(c.alias("x"))
                cols[f"_v{i}"] = boxed
                for j in range(1, k + 1):
                    cols[f"_s{i}_{j}"] = (F.lag if kind == "lag" else F.lead)(boxed, j).over(w)
                (tail if kind == "lag" else head).update(
                    [f"_v{i}"] + [f"_s{i}_{j}" for j in range(1, k)])
            elif kind == "fill":
                cols[f"_v{i}"] = F.last(c, True).over(upto)
                tail.add(f"_v{i}")
            elif kind == "back":
                cols[f"_v{i}"] = F.first(c, True).over(onward)
                head.add(f"_v{i}")
            elif kind == "fillb":
                cols[f"_v{i}"] = F.last(c, True).over(upto)
                cols[f"_b{i}"] = F.last(c, True).over(w.rowsBetween(Window.unboundedPreceding, -1))
                tail.add(f"_v{i}")
            elif kind == "maxb":
                cols[f"_v{i}"] = F.max(c).over(upto)
                cols[f"_b{i}"] = F.max(c).over(w.rowsBetween(Window.unboundedPreceding, -1))
                tail.add(f"_v{i}")
            else:
                cols[f"_v{i}"] = (F.max if kind == "max" else F.sum)(c).over(upto)
                tail.add(f"_v{i}")
        base = self.df if self.slice in self.df.columns else self.df.withColumn(self.slice, self.slice_col)
        if self.key not in base.columns:
            base = base.withColumn(self.key, F.struct(*[F.col(k) for k in self.keys]))
        target = slices.target_rows(self.df)
        if self.slice not in self.df.columns and slices.may_exceed(self.df, target):
            base = slices.equi_depth(base, self.key, self.slice, slices.coordinates(self.df, self.order), target)
        local = base.withColumns(cols)

        key_order = F.struct(*[F.col(o) for o in self.order])
        aggs = []
        if tail:
            aggs.append(F.max_by(F.struct(*sorted(tail)), key_order).alias("_tail"))
        if head:
            aggs.append(F.min_by(F.struct(*sorted(head)), key_order).alias("_head"))
        carry = local.groupBy(*part).agg(*aggs)
        ws = Window.partitionBy(part[0]).orderBy(part[1])
        before = ws.rowsBetween(Window.unboundedPreceding, -1)
        after = ws.rowsBetween(1, Window.unboundedFollowing)
        cc = {}
        for i, (kind, _, _, k) in enumerate(self.ops):
            if kind in ("lag", "lead"):
                side, fn = ("_tail", F.lag) if kind == "lag" else ("_head", F.lead)
                near = fn(f"{side}._v{i}", 1).over(ws)
                cc[f"_c{i}_1"] = near
                if k == 2:
                    cc[f"_c{i}_2"] = F.coalesce(fn(f"{side}._s{i}_1", 1).over(ws),
                                                fn(f"{side}._v{i}", 2).over(ws))
            elif kind in ("fill", "fillb"):
                cc[f"_c{i}"] = F.last(f"_tail._v{i}", True).over(before)
            elif kind == "back":
                cc[f"_c{i}"] = F.first(f"_head._v{i}", True).over(after)
            elif kind == "total":
                cc[f"_c{i}"] = F.sum(f"_tail._v{i}").over(Window.partitionBy(part[0]))
            else:
                cc[f"_c{i}"] = (F.sum if kind == "sum" else F.max)(f"_tail._v{i}").over(before)
        carry = carry.withColumns(cc).drop("_tail", "_head")

        both = local.alias("l").join(
            carry.alias("c"),
            [F.col(f"l.{p}") == F.col(f"c.{p}") for p in part], "left")
        out = [F.col(f"l.`{c}`") for c in self.df.columns if c not in (self.slice, self.key)]
        if keep_slice:
            out += [F.col(f"l.{p}") for p in part]
        for i, (kind, name, _, k) in enumerate(self.ops):
            if kind in ("lag", "lead"):
                v = F.col(f"_s{i}_{k}")
                if k == 1:
                    v = F.coalesce(v, F.col(f"_c{i}_1"))
                else:
                    # the nearest neighbour inside the slice decides how far the carry reaches
                    v = F.coalesce(v, F.when(F.col(f"_s{i}_1").isNotNull(), F.col(f"_c{i}_1"))
                                   .otherwise(F.col(f"_c{i}_2")))
                out.append(v["x"].alias(name))
            elif kind == "fillb":
                out.append(F.coalesce(f"_b{i}", f"_c{i}").alias(name))
            elif kind in ("fill", "back"):
                out.append(F.coalesce(f"_v{i}", f"_c{i}").alias(name))
            elif kind == "total":
                out.append(F.col(f"_c{i}").alias(name))
            elif kind in ("max", "maxb"):
                mine = f"_v{i}" if kind == "max" else f"_b{i}"
                out.append(F.greatest(mine, f"_c{i}").alias(name))
            else:
                out.append(F.when(F.col(f"_c{i}").isNull(), F.col(f"_v{i}"))
                           .when(F.col(f"_v{i}").isNull(), F.col(f"_c{i}"))
                           .otherwise(F.col(f"_v{i}") + F.col(f"_c{i}")).alias(name))
        return both.select(*out)
