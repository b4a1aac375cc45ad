"""Writers: narrow types, key-value tables, publication by rename."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def scaled_int(v: Column, scale: float, nodata: int = -9999) -> Column:
    """rint(v x scale) within 16 bits; a value that would read as missing moves up by one; null becomes missing."""
    n = F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(v * scale))).cast("int")
    return F.when(v.isNull(), F.lit(nodata)).when(n == nodata, F.lit(nodata + 1)).otherwise(n).cast("short")


def key_value(df: DataFrame, ids: list[str], values: list[str]) -> DataFrame:
    """One row a metric: ids, metric, value."""
    return df.select(*ids, *[F.col(v).cast("double").alias(v) for v in values]).unpivot(ids, values, "metric", "value")


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).option("nullValue", "").csv(path)


def publish(df: DataFrame, path: str) -> None:
    """Write beside the target and rename it in; the old table is put aside first, and back if the new one cannot take its place.

    A reader that opens the target between the two renames finds nothing there; it never finds a part.
    """
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    mark = uuid.uuid4().hex
    target, new, old = fs_path(path), fs_path(f"{path}.new-{mark}"), fs_path(f"{path}.old-{mark}")
    df.write.parquet(new.toString())
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    held = fs.exists(target)
    if held and not fs.rename(target, old):
        raise OSError(f"cannot put {path} aside")
    if not fs.rename(new, target):
        if held:
            fs.rename(old, target)
        raise OSError(f"cannot publish {path}")
    if held:
        fs.delete(old, True)
