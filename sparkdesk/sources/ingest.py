"""Ingest status of landed CSV files (S12, F11): none found, empty, bad file or ok.

A file is bad if its first line is not the expected header or a line holds a NUL
character (not a text file).  It is empty if nothing follows the header.  The
first line is the one with the smallest place in the file's first block, found by
an aggregate; no file is read whole and no list of files passes the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkdesk.sources.files import list_files

STATUSES = ["none found", "bad file", "empty", "ok"]


def file_report(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """``(path, size, lines, status)`` of every file under ``root`` that has bytes; ``lines`` after
    the header."""
    lines = spark.read.option("recursiveFileLookup", True).text(root).select(
        F.col("_metadata.file_path").alias("path"), "value",
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("place")).alias("at"))
    seen = lines.groupBy("path").agg(
        F.min_by("value", "at").alias("header"), F.bool_or(F.col("value").contains("\0")).alias("binary"),
        F.sum((F.trim("value") != "").cast("long")).alias("filled"))
    names = F.transform(F.split("header", ",", -1), lambda c: F.regexp_replace(F.trim(c), '^"|"$', ""))
    right = ~F.col("binary") & (names == F.array(*[F.lit(c) for c in columns]))
    found = list_files(spark, root).select("path", "size").join(seen, "path", "left")
    data = F.greatest(F.coalesce(F.col("filled"), F.lit(0)) - 1, F.lit(0)).cast("long")
    return found.select("path", "size", data.alias("lines"), F.when(F.coalesce("filled", F.lit(0)) == 0, "empty")
                        .when(~right, "bad file").when(data == 0, "empty").otherwise("ok").alias("status"))


def _files(spark: SparkSession, root: str) -> int:
    """Number of files under ``root``, 0 where there is no such folder; the names stay in Spark's listing."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return 0
    return len(spark.read.option("recursiveFileLookup", True).text(root)._jdf.inputFiles())


def landing_report(spark: SparkSession, roots: Mapping[str, str], columns: Sequence[str]) -> DataFrame:
    """``(source, files, good_files, bytes, lines, status)`` of each landing folder: the worst status of its files,
    empty only if none has rows."""
    def one(name: str, root: str) -> DataFrame:
        status = F.col("status")
        # Spark's readers pass over files without bytes: the listing counts them
        n = _files(spark, root)
        found = (file_report(spark, root, columns) if n
                 else spark.createDataFrame([], "path string, size long, lines long, status string"))
        return found.agg(
            F.lit(name).alias("source"), F.lit(n).cast("long").alias("files"),
            F.count(F.when(status == "ok", 1)).alias("good_files"),
            F.coalesce(F.sum("size"), F.lit(0)).cast("long").alias("bytes"),
            F.coalesce(F.sum(F.when(status == "ok", F.col("lines"))), F.lit(0)).cast("long").alias("lines"),
            F.when(F.lit(n == 0), "none found").when(F.bool_or(status == "bad file"), "bad file")
            .when(F.coalesce(F.bool_and(status == "empty"), F.lit(True)), "empty").otherwise("ok").alias("status"))

    return reduce(DataFrame.unionByName, [one(n, r) for n, r in roots.items()])
