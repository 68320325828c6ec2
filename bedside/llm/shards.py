"""Proportional stratified interleaving into shards, with DataFrame functions only.

Rows are shuffled by a seeded hash within their source, ranked there, and given the fractional
rank (rank + offset) / rows of the source; in the order of fractional ranks every stretch has
the mixture of the whole, and cutting it into equal stretches gives shards whose counts differ
by one at most.

Neither ranking gathers a source or the table in one task. Both count rows per bucket of the
order (a hash bucket of a source, an interval of fractional ranks), add up the counts of the
buckets before, and number rows inside a bucket. The number of buckets follows from the number
of rows, so a bucket holds about ``bucket_rows`` rows however large a source is.

Only keys, sizes and checksums are shuffled, never texts. Null sources are a stratum of their
own, null texts count as empty, rows equal in all columns are interchangeable, and an empty
table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed whatever the data: a bucket's rows are sorted by one task.
BUCKET_ROWS, LEAST_BUCKETS = 200_000, 256


def _ranked(df: DataFrame, group: list[str], bucket: Column, order: list[Column], name: str) -> DataFrame:
    """Adds the 0-based rank of every row in its group. ``bucket`` never falls along the order."""
    df = df.withColumn("_bucket", bucket)
    keys = [*group, "_bucket"]
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = df.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
    return (inside.join(offsets, keys)
            .withColumn(name, F.col("_before") + F.col("_inside")).drop("_before", "_inside", "_bucket"))


def interleave(df: DataFrame, n_shards: int, source: str = "source", seed: int = 17,
               bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """The rows of ``df`` with ``_shard`` int and ``_slot`` long, gapless from 0 in each shard.

    ``df`` should hold what identifies a row and no more: all its columns are shuffled."""
    columns = df.columns
    total = df.count()
    buckets = max(LEAST_BUCKETS, -(-total // bucket_rows))
    row = F.struct(*[F.col(f"`{c}`") for c in columns])
    df = df.select(row.alias("_row"), F.xxhash64(F.lit("stratum"), f"`{source}`").alias("_source"),
                   F.isnull(f"`{source}`").alias("_none"), F.xxhash64(F.lit(seed), row).alias("_hash"))
    stratum = ["_source", "_none"]
    # the upper bits of the shifted hash, so that buckets keep the order of the hash
    width = (1 << 53) // buckets + 1
    df = _ranked(df, stratum, F.floor(F.shiftrightunsigned("_hash", 11) / width).cast("int"),
                 [F.shiftrightunsigned("_hash", 11), F.col("_hash"), F.col("_row")], "_rank")
    rows = df.groupBy(*stratum).agg(F.count(F.lit(1)).alias("_rows"))
    df = df.join(rows, stratum)
    offset = (F.pmod(F.xxhash64(F.lit(seed), F.col("_source")), F.lit(1_000_003)) + 0.5) / 1_000_003
    df = df.withColumn("_fraction", (F.col("_rank") + offset) / F.col("_rows"))
    df = _ranked(df.withColumn("_all", F.lit(0)), ["_all"],
                 F.least(F.floor(F.col("_fraction") * buckets), F.lit(buckets - 1)).cast("int"),
                 [F.col("_fraction"), F.col("_source"), F.col("_none"), F.col("_rank")], "_position")
    # whole numbers; shard k begins at the least position whose product with n_shards reaches k * total
    shard = f"(_position * {n_shards} DIV {max(total, 1)})"
    first = f"(({shard} * {max(total, 1)} + {n_shards - 1}) DIV {n_shards})"
    return df.select("_row.*", F.expr(shard).cast("int").alias("_shard"),
                     (F.col("_position") - F.expr(first)).alias("_slot"))


def assignment(docs: DataFrame, n_shards: int = 16) -> DataFrame:
    """Shard and slot of each document beside its size and checksum."""
    text = F.coalesce("text", F.lit(""))
    keys = docs.select("doc_id", F.col("source"), (F.octet_length(text) + 1).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).cast("long").alias("text_crc32"))
    return interleave(keys, n_shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("_shard").alias("shard"),
        F.col("_slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
