"""File sources and sinks: CSV with header, per-file encoding fallback,
missing tokens, suffix dispatch, whole-file text, tables, ingest status.

Decisions made per file (encoding, format) aggregate on the executors; only
file paths reach the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StringType, StructField, StructType

from sparkdesk.functions import patterns as P
from sparkdesk.functions.exprs import named
from sparkdesk.session import materialize


# a quote inside a quoted field is doubled and a backslash is a plain character, as in
# RFC 4180 and pandas
BAD_LINE = "_bad_line"
QUOTING = {"quote": '"', "escape": '"'}


# CSV with header; explicit schema, inference only when asked (profiling).  A file with
# line breaks inside fields needs ``multiline``, which reads each file in one task.
def read_csv(spark: SparkSession, paths: str | Sequence[str], schema: StructType | str | None = None,
             encoding: str = "UTF-8", multiline: bool = False, source_col: str | None = None,
             bad_col: str | None = None) -> DataFrame:
    r = (spark.read.option("header", True).option("encoding", encoding)
         .options(**QUOTING).option("multiLine", multiline).option("mode", "PERMISSIVE"))
    if bad_col:
        r = r.option("columnNameOfCorruptRecord", bad_col)
    r = r.schema(schema) if schema is not None else r.option("inferSchema", True)
    df = r.csv(paths if isinstance(paths, str) else list(paths))
    if source_col:
        df = df.withColumn(source_col, F.col("_metadata.file_name"))   # P10
    return df


# S1 without types: every column a string, named by the header
def read_csv_strings(spark: SparkSession, paths: str | Sequence[str], multiline: bool = False,
                     encoding: str = "UTF-8") -> DataFrame:
    return (spark.read.option("header", True).option("encoding", encoding).options(**QUOTING)
            .option("multiLine", multiline).csv(paths if isinstance(paths, str) else list(paths)))


# Rows that fit the schema, and the raw lines of those that do not, from one definition
def read_csv_checked(spark: SparkSession, paths: str | Sequence[str], schema_ddl: str,
                     **kw) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad rows as ``line``); no row is dropped or half read.  The files are
    parsed once, into a written table that both read."""
    df = materialize(read_csv(spark, paths, f"{schema_ddl}, {BAD_LINE} string", bad_col=BAD_LINE, **kw))
    bad = F.col(BAD_LINE).isNotNull()
    return df.where(~bad).drop(BAD_LINE), df.where(bad).select(F.col(BAD_LINE).alias("line"))


# S3: pandas default missing tokens -> null on every string column
def normalize_missing(df: DataFrame, tokens: Sequence[str] = P.MISSING_TOKENS) -> DataFrame:
    out = []
    for f in df.schema.fields:
        c = named(f.name)
        if f.dataType.typeName() == "string":
            c = F.when(~c.isin(list(tokens)), c)
        out.append(c.alias(f.name))
    return df.select(*out)


# Per file: valid UTF-8 -> read as UTF-8, else the whole file as Latin-1
def file_encodings(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    lines = spark.read.text(paths if isinstance(paths, str) else list(paths))
    return (lines.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("_ok"))
            .groupBy("path").agg(F.bool_and("_ok").alias("utf8"))
            .select("path", F.when(F.col("utf8"), F.lit("UTF-8")).otherwise(F.lit("ISO-8859-1")).alias("encoding")))


def read_csv_any_encoding(spark: SparkSession, paths: str | Sequence[str],
                          schema: StructType | str, multiline: bool = False) -> DataFrame:
    """Rows of all files with the ``encoding`` of their file.  Everything is parsed once as
    Latin-1, which keeps every byte and the ASCII marks of CSV; fields of valid UTF-8 files
    are then decoded from their bytes.  A file's encoding joins its rows by path on the
    executors; no file list reaches the driver or the plan."""
    fields = spark.createDataFrame([], schema).schema.fields
    strings = StructType([StructField(f.name, StringType()) for f in fields])
    path = "_path"
    rows = read_csv(spark, paths, strings, encoding="ISO-8859-1", multiline=multiline).withColumn(
        path, F.col("_metadata.file_path"))
    both = rows.join(file_encodings(spark, paths).withColumnRenamed("path", path), path)
    utf8 = F.col("encoding") == "UTF-8"

    def decoded(f):
        c = named(f.name)
        return F.when(utf8, F.encode(c, "ISO-8859-1").cast("string")).otherwise(c).try_cast(f.dataType).alias(f.name)

    return both.select(*[decoded(f) for f in fields], "encoding")


# K1: CSV sink with header, no index; a directory of part files
def write_csv(df: DataFrame, path: str, encoding: str = "UTF-8", mode: str = "overwrite") -> str:
    df.write.mode(mode).options(**QUOTING).option("header", True).option("encoding", encoding).csv(path)
    return path


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """Paths and sizes under ``root`` (file contents are not read)."""
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
            .select("path", F.element_at(F.split("path", "/"), -1).alias("file_name"),
                    F.col("length").alias("size")))


def _any_case_glob(suffix: str) -> str:
    return "*" + "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in suffix)


# S4 + F8: dispatch by suffix (any case): .txt and .csv are read, anything else
# is reported as unsupported.  Each format is read with a glob filter, so no
# file list passes through the driver; rows per file come from one read each.
def dispatch(spark: SparkSession, root: str) -> DataFrame:
    files = list_files(spark, root)
    low = F.lower("file_name")
    kind = (F.when(low.endswith(".txt"), F.lit("txt")).when(low.endswith(".csv"), F.lit("csv"))
            .otherwise(F.lit("unsupported")))
    files = files.withColumn("kind", kind)

    def rows_per_file(reader, suffix):
        r = reader.option("recursiveFileLookup", True).option("pathGlobFilter", _any_case_glob(suffix))
        return r

    txt = rows_per_file(spark.read, ".txt").text(root, wholetext=True)
    csv = rows_per_file(spark.read.option("header", True).options(**QUOTING).option("multiLine", True)
                         .schema("line string"),
                        ".csv").csv(root)
    counts = None
    for part in (txt, csv):
        c = part.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.count(F.lit(1)).alias("rows"))
        counts = c if counts is None else counts.unionByName(c)
    out = files.join(counts, "path", "left")
    return out.select("file_name", "kind", "size",
                      F.when(F.col("kind") != "unsupported", F.coalesce(F.col("rows"), F.lit(0))).alias("rows"),
                      F.when(F.col("kind") == "unsupported", F.lit("unsupported"))
                      .when(F.col("size") == 0, F.lit("empty")).otherwise(F.lit("ok")).alias("status"))


# Whole-file text, strict UTF-8: invalid files are quarantined, not decoded
def read_text_files(spark: SparkSession, paths: str | Sequence[str], source_col: str | None = None) -> DataFrame:
    df = spark.read.text(paths if isinstance(paths, str) else list(paths), wholetext=True)
    ok = F.is_valid_utf8("value")
    source = [F.col("_metadata.file_path").alias(source_col)] if source_col else []
    return df.select(*source, F.col("_metadata.file_name").alias("file_name"),
                     F.when(ok, F.col("value")).alias("text"),
                     F.when(ok, F.lit("ok")).otherwise(F.lit("quarantine")).alias("status"))


# K2 + S7: create a Parquet table once, then scan it
def create_table(spark: SparkSession, name: str, schema_ddl: str, location: str) -> None:
    spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({schema_ddl}) USING parquet LOCATION '{location}'")


def scan_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.table(name)


# Co-location for recurring joins: write each side bucketed (and sorted) by
# the join key into the same number of buckets; later joins on that key read
# matching buckets and skip the shuffle.
def write_bucketed(df: DataFrame, name: str, key: str | Sequence[str], buckets: int, path: str) -> DataFrame:
    keys = [key] if isinstance(key, str) else list(key)
    (df.write.mode("errorifexists").bucketBy(buckets, *keys).sortBy(*keys)
     .option("path", path).saveAsTable(name))
    return df.sparkSession.table(name)
