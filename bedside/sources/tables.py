"""Scans, typed loading, cohort subsets and sinks."""

from __future__ import annotations

import atexit
import hashlib
import json
import re
import shutil
import tempfile
import uuid
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from bedside.functions.expr import norm


#: Where intermediates go, if not to ``spark.checkpoint.dir``.
ROOT_CONF = "spark.bedside.intermediate.dir"
_local: list[str] = []
_written: list[str] = []


def scratch_root(master: str, configured: str | None) -> str:
    """The configured shared folder. A local folder serves a local master alone: on a cluster each
    executor would write to a disk of its own, and what is read back would lack the others' files."""
    if configured:
        return configured.rstrip("/")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"set {ROOT_CONF} or spark.checkpoint.dir to a folder that driver and executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="bedside-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder for written tables under the session's shared root; ``cleanup`` deletes it."""
    configured = spark.conf.get(ROOT_CONF, None) or spark.conf.get("spark.checkpoint.dir", None)
    dest = f"{scratch_root(spark.sparkContext.master, configured)}/bedside/{name}-{uuid.uuid4().hex}"
    _written.append(dest)
    return dest


def cleanup(spark: SparkSession) -> int:
    """Deletes the folders that ``scratch`` has named so far; results not yet written must be.
    Returns how many there were."""
    n = len(_written)
    while _written:
        p = spark._jvm.org.apache.hadoop.fs.Path(_written.pop())
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return n


def prepare(spark: SparkSession) -> None:
    """Session settings the operators rely on: UTC, and splitting of skewed join keys even
    where the split costs one more shuffle afterwards."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.adaptive.enabled", "true")
    spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    spark.conf.set("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate once and read it back: later steps start from files that
    survive lost executors instead of repeating the whole lineage."""
    spark = df.sparkSession
    dest = scratch(spark, name)
    df.write.parquet(dest)
    return spark.read.schema(df.schema).parquet(dest)


def find_table(spark: SparkSession, root: str, name: str, fmt: str = "parquet",
               prefixes: tuple[str, ...] = ("",)) -> DataFrame | None:
    """The first of ``<prefix><name>.<fmt>`` that exists; None when none does."""
    for prefix in prefixes:
        path = f"{root.rstrip('/')}/{prefix}{name}.{fmt}"
        if exists(spark, path):
            reader = spark.read.option("header", True) if fmt == "csv" else spark.read
            return reader.format(fmt).load(path)
    return None


def to_utc(ts: Column, timezone: str) -> Column:
    """Local wall time to UTC. Spark takes the earlier offset on an overlap; a wall
    time that does not exist (spring gap) becomes null, found by a round trip."""
    ntz = ts.cast("timestamp_ntz")
    utc = F.convert_timezone(F.lit(timezone), F.lit("UTC"), ntz)
    back = F.convert_timezone(F.lit("UTC"), F.lit(timezone), utc)
    return F.when(back == ntz, utc)


def conform(df: DataFrame, timezone: str = "UTC", spec: dict[str, str] | None = None) -> DataFrame:
    """Ids to string, categories lower-cased and trimmed, times to UTC, measures to
    double. Columns absent from the file are skipped. ``spec`` overrides the rule by
    column name ('id', 'category', 'local_time', 'double', 'keep')."""
    out = []
    for c, t in df.dtypes:
        rule = (spec or {}).get(c)
        if rule is None:
            rule = ("id" if c.endswith("_id") else
                    "category" if c.endswith("_category") else
                    "local_time" if t == "timestamp_ntz" else "keep")
        col = F.col(c)
        out.append({"id": col.cast("string"), "category": norm(col.cast("string")),
                    "local_time": to_utc(col, timezone), "double": F.expr(f"try_cast(`{c}` AS double)"),
                    "keep": col}[rule].alias(c))
    return df.select(*out)


def scan(df: DataFrame, columns: list[str] | None = None,
         values: dict[str, list] | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Projection, value lists and an id semi join. Value lists reach the file reader;
    the join strategy for the id table is left to the size statistics."""
    for c, allowed in (values or {}).items():
        df = df.where(F.col(c).isin(allowed))
    if ids is not None:
        df = df.join(ids, ids.columns, "left_semi")
    if columns:
        df = df.select(*[c for c in columns if c in df.columns])
    return df


def subset_to_cohort(df: DataFrame, ids: DataFrame, id_column: str, dest: str,
                     columns: list[str] | None = None) -> tuple[int, int]:
    """Write the rows whose id is in the cohort; the id column is always kept and an
    empty result still has the schema. Returns rows read and rows written, counted
    during the write."""
    if id_column not in df.columns:
        raise ValueError(f"no id column {id_column}")
    if columns:
        df = df.select(id_column, *[c for c in columns if c in df.columns and c != id_column])
    rows_in, rows_out = Observation(), Observation()
    kept = (df.observe(rows_in, F.count(F.lit(1)).alias("n"))
            .join(ids.select(id_column).distinct(), id_column, "left_semi")
            .observe(rows_out, F.count(F.lit(1)).alias("n")))
    kept.write.mode("overwrite").parquet(dest)
    written = rows_out.get["n"]
    # an empty id side lets Spark skip the scan, then the input was not counted
    read = rows_in.get.get("n", 0) if written else df.count()
    return read, written


def definition_hash(version: str, params: dict) -> str:
    """Stable hash of a cohort definition: key order does not matter."""
    text = json.dumps({"version": version, "params": params}, sort_keys=True, default=str)
    return hashlib.sha256(text.encode()).hexdigest()


def source_signature(df: DataFrame) -> list:
    """Number of files behind a scan, their total size and one hash over (path, size,
    modification time) of all of them: three numbers however many files there are. Files are listed, no row of them is read."""
    files = [re.sub(r"([\\*?{}\[\]])", r"\\\1", unquote(f)) for f in df.inputFiles()]
    if not files:
        return [0, None, None]
    meta = df.sparkSession.read.format("binaryFile").load(files).select("path", "length", F.unix_micros("modificationTime").alias("mtime"))
    return list(meta.agg(F.count(F.lit(1)), F.sum("length"), F.bit_xor(F.xxhash64("path", "length", "mtime"))).first())


def cached_subset(spark: SparkSession, source: DataFrame, make_ids, id_column: str, dest: str,
                  version: str, params: dict, columns: list[str] | None = None,
                  force_refresh: bool = False) -> tuple[DataFrame, bool]:
    """Reuse ``dest`` while definition and source files are unchanged. ``make_ids`` is
    called only on a miss. Returns the subset and whether it was reused."""
    want = json.dumps([definition_hash(version, params), source_signature(source), columns])
    stamp = hashlib.sha256(want.encode()).hexdigest()
    if not force_refresh and exists(spark, dest + "_manifest"):
        if spark.read.text(dest + "_manifest").first()["value"] == stamp:
            return spark.read.parquet(dest), True
    subset_to_cohort(source, make_ids(), id_column, dest, columns)
    spark.createDataFrame([(stamp,)], "value string").coalesce(1).write.mode("overwrite").text(
        dest + "_manifest")
    return spark.read.parquet(dest), False


def cached_table(spark: SparkSession, name: str, version: str, sources: list[DataFrame], make) -> DataFrame:
    """A derived table under the shared root, made again only when a source file or ``version``
    changes. Its folder is named by both, so runs over different files never meet; ``cleanup`` leaves it."""
    want = json.dumps([name, version, [source_signature(s) for s in sources]])
    configured = spark.conf.get(ROOT_CONF, None) or spark.conf.get("spark.checkpoint.dir", None)
    root = scratch_root(spark.sparkContext.master, configured)
    dest = f"{root}/bedside/{name}-{hashlib.sha256(want.encode()).hexdigest()[:32]}"
    if not exists(spark, f"{dest}/_SUCCESS"):
        make().write.mode("overwrite").parquet(dest)
    return spark.read.parquet(dest)


def table_metadata(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """Row count, column names and types per table, one row per column."""
    parts = None
    for name, df in tables.items():
        cols = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(c).alias("column"),
                                  F.lit(t).alias("type")) for i, (c, t) in enumerate(df.dtypes)])
        one = (df.agg(F.count(F.lit(1)).alias("n_rows"))
               .select(F.lit(name).alias("table"), "n_rows", F.explode(cols).alias("e"))
               .select("table", "n_rows", "e.*"))
        parts = one if parts is None else parts.unionByName(one)
    return parts


def write_stats(df: DataFrame, dest: str, fmt: str = "both") -> None:
    """Statistics as CSV with header and/or JSON lines."""
    if fmt in ("csv", "both"):
        df.write.mode("overwrite").option("header", True).csv(f"{dest}/csv")
    if fmt in ("json", "both"):
        df.write.mode("overwrite").json(f"{dest}/json")


def split_stratum(df: DataFrame, column: str = "stratum") -> DataFrame:
    """``parent/child`` to parent and child columns; child is 'all' for a parent."""
    parts = F.split(F.col(column), "/")
    return df.withColumns({
        "stratum": F.element_at(parts, 1),
        "sub_stratum": F.when(F.size(parts) > 1, F.element_at(parts, 2)).otherwise("all")})


def write_by_stratum(df: DataFrame, dest: str, column: str = "stratum") -> None:
    split_stratum(df, column).write.mode("overwrite").partitionBy("stratum", "sub_stratum").parquet(dest)


def write_separate(row_level: DataFrame, aggregates: DataFrame, private_root: str,
                   shared_root: str, name: str) -> None:
    """Row-level results and shareable aggregates never share a root."""
    if private_root.rstrip("/") == shared_root.rstrip("/"):
        raise ValueError("private and shared roots must differ")
    row_level.write.mode("overwrite").parquet(f"{private_root}/{name}")
    aggregates.write.mode("overwrite").parquet(f"{shared_root}/{name}")
