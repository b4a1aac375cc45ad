"""Readers: tables of a folder, discovered yearly files, manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def plots(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A plot table from CSV by a declared schema; ids stay strings."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").csv(path)


def yearly_files(spark: SparkSession, folder: str, pattern: str = r"(\d{4})") -> DataFrame:
    """path, year, bytes of the files of a folder whose name holds a year; content is not read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    year = F.regexp_extract(F.element_at(F.split("path", "/"), -1), pattern, 1)
    return found.select("path", year.alias("y"), F.col("length").alias("bytes")).filter("y <> ''").select("path", F.col("y").cast("int").alias("year"), "bytes")


def missing_years(files: DataFrame, first: int, last: int) -> DataFrame:
    wanted = files.sparkSession.range(first, last + 1).select(F.col("id").cast("int").alias("year"))
    return wanted.join(files, "year", "left_anti")


def fingerprint(spark: SparkSession, folder: str) -> str:
    """Twelve characters that change with any file's name or content, whatever their order."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    one = rows.select(F.md5(F.concat_ws("|", F.element_at(F.split("path", "/"), -1), F.md5("content"))).alias("h"))
    total = one.agg(F.sum(F.conv(F.substring("h", 1, 12), 16, 10).cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n"))
    return total.select(F.substring(F.md5(F.concat_ws("|", "s", "n")), 1, 12)).first()[0]
