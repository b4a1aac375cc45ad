"""Yearly stacks and what a run leaves behind: partitioned scans, manifests, all-or-nothing commits, caches.

A stack is Parquet by metric and year, so that a filter on either prunes files before any is opened. A commit of
many tables writes them under a new version and then moves one small pointer: readers find all of the old or all of the
new tables, and a failed task leaves the old ones as they were.
"""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

POINTER = "_current"


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def write_stack(cells: DataFrame, root: str) -> None:
    """cells (metric, year, cell, v) as Parquet by metric and year, a file a task and year."""
    cells.repartition("metric", "year").sortWithinPartitions("metric", "year", "cell").write.partitionBy("metric", "year").parquet(root)


def stack_years(spark: SparkSession, root: str) -> dict[str, list[int]]:
    """The years of each metric, from folder names alone."""
    fs, path = _fs(spark, root)
    found: dict[str, list[int]] = {}
    for m in fs.listStatus(path):
        name = m.getPath().getName()
        if m.isDirectory() and name.startswith("metric="):
            found[name[7:]] = sorted(int(y.getPath().getName()[5:]) for y in fs.listStatus(m.getPath()) if y.getPath().getName().startswith("year="))
    return found


def scan_stack(spark: SparkSession, root: str, metric: str, first: int, last: int) -> DataFrame:
    """cell, year, v of one metric for first..last; a year that is not there is an error, and no other year is opened."""
    there = stack_years(spark, root).get(metric, [])
    gone = sorted(set(range(first, last + 1)) - set(there))
    if gone:
        raise ValueError(f"{metric} lacks {gone[:5]}{' and more' if len(gone) > 5 else ''}")
    rows = spark.read.schema("cell long, v double, metric string, year int").parquet(root)
    return rows.filter((F.col("metric") == metric) & F.col("year").between(first, last)).select("cell", "year", "v")


def manifest_of(spark: SparkSession, root: str) -> DataFrame:
    """path, metric, year, bytes, md5 of a stack's files; contents are hashed where they lie, a file a row."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root)
    part = lambda k: F.regexp_extract("path", f"/{k}=([^/]+)/", 1)
    return files.select("path", part("metric").alias("metric"), part("year").cast("int").alias("year"), F.col("length").alias("bytes"), F.md5("content").alias("md5"))


def manifest_faults(manifest: DataFrame, found: DataFrame) -> DataFrame:
    """path, fault: files that a manifest names and that are missing or changed, and those that it does not name."""
    m, f = manifest.select("path", "md5"), found.select("path", F.col("md5").alias("now"))
    fault = F.when(F.col("now").isNull(), "missing").when(F.col("md5").isNull(), "unknown").when(F.col("md5") != F.col("now"), "changed")
    return m.join(f, "path", "full").select("path", fault.alias("fault")).filter("fault is not null")


def scan_manifest(spark: SparkSession, root: str, manifest: DataFrame, metrics: list[str], years: list[int]) -> DataFrame:
    """metric, year, cell, v of the files that a manifest names for metrics and years; each pair must be named."""
    rows = manifest.filter(F.col("metric").isin(metrics) & F.col("year").isin(years)).select("path", "metric", "year").collect()  # a row a file that is asked for
    gone = {(m, y) for m in metrics for y in years} - {(r.metric, r.year) for r in rows}
    if gone:
        raise ValueError(f"the manifest lacks {sorted(gone)[:3]}")
    return spark.read.schema("cell long, v double, metric string, year int").option("basePath", root).parquet(*sorted(r.path for r in rows)).select("metric", "year", "cell", "v")


def _read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    with_stream = fs.open(p)
    try:
        return bytes(with_stream.readAllBytes()).decode()
    finally:
        with_stream.close()


def write_json(spark: SparkSession, path: str, value) -> None:
    """One JSON file with sorted keys, put in place whole: a reader finds the old or the new one."""
    fs, p = _fs(spark, path)
    jvm = spark.sparkContext._jvm
    part = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    out = fs.create(part, True)
    try:
        out.write(bytearray((json.dumps(value, sort_keys=True, ensure_ascii=False, indent=1) + "\n").encode()))
    finally:
        out.close()
    where = jvm.org.apache.hadoop.fs.FileContext.getFileContext(p.toUri() if p.toUri().getScheme() else fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    where.rename(part, p, how)


def read_json(spark: SparkSession, path: str):
    """The value of a JSON file, or None where there is none."""
    text = _read_text(spark, path)
    return None if text is None else json.loads(text)


def commit_all(spark: SparkSession, root: str, tables: dict[str, DataFrame]) -> str:
    """Write all tables under a new version of root and point to it; what failed to be written is never pointed to."""
    version = f"v-{uuid.uuid4().hex}"
    try:
        for name, df in tables.items():
            df.write.parquet(f"{root}/{version}/{name}")
    except Exception:
        fs, p = _fs(spark, f"{root}/{version}")
        fs.delete(p, True)
        raise
    write_json(spark, f"{root}/{POINTER}", {"version": version, "tables": sorted(tables)})
    return version


def committed(spark: SparkSession, root: str) -> dict[str, DataFrame]:
    """The tables of the version that root points to; none before the first commit."""
    now = read_json(spark, f"{root}/{POINTER}")
    return {} if now is None else {name: spark.read.parquet(f"{root}/{now['version']}/{name}") for name in now["tables"]}


def vacuum(spark: SparkSession, root: str) -> int:
    """Delete the versions that root does not point to; how many went."""
    now, (fs, p) = read_json(spark, f"{root}/{POINTER}"), _fs(spark, root)
    old = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName().startswith("v-") and now and s.getPath().getName() != now["version"]]
    return sum(bool(fs.delete(x, True)) for x in old)


def config_id(config: dict) -> str:
    """Twelve characters for a run's settings, whatever the order of their keys."""
    return hashlib.md5(json.dumps(config, sort_keys=True, ensure_ascii=False).encode()).hexdigest()[:12]


def cached(spark: SparkSession, root: str, config: dict, make: Callable[[], DataFrame]) -> DataFrame:
    """The table of a config: made, and put in place whole, by the first that asks; read by all others."""
    fs, path = _fs(spark, f"{root}/{config_id(config)}")
    if not fs.exists(path):
        part = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root}/part-{uuid.uuid4().hex}")
        make().write.parquet(part.toString())
        if fs.exists(path) or not fs.rename(part, path):  # another was first
            fs.delete(part, True)
    return spark.read.parquet(path.toString())
