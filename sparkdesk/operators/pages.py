"""Stored pages (W5): rows written once in order, then any page opened from its files.

``store`` range-partitions the rows by the sort key, writes each range to a
folder of its own and beside it an index of one row per folder: its number, how
many rows come before it and how many it holds.  A page looks up the folders it
needs in the index (a page of n rows overlaps n of them at most) and reads those
only.  The first page and the last one take the same path.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from sparkdesk.functions.exprs import row_hash
from sparkdesk.session import scratch_dir


@dataclass(frozen=True)
class PageStore:
    """An ordered table with its index under ``path``; ``columns`` are the stored rows' own."""
    spark: SparkSession
    path: str
    columns: tuple[str, ...]

    def index(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/index")

    def parts_of(self, lo: int, hi: int) -> list[int]:
        """Folders that hold the rows of the 1-based places ``lo`` to ``hi``."""
        hit = (F.col("before") < hi) & (F.col("before") + F.col("rows") >= lo)
        return [r["part"] for r in self.index().where(hit).select("part").collect()]

    def rows(self, lo: int, hi: int, out: str = "row_no") -> DataFrame:
        """The rows at the places ``lo`` to ``hi`` with their place as ``out``."""
        parts = self.parts_of(lo, hi) if hi >= lo else []
        base = f"{self.path}/rows"
        stored = (self.spark.read.option("basePath", base).parquet(*[f"{base}/_folder={p}" for p in parts])
                  if parts else self.spark.read.parquet(base).limit(0))
        before = self.index().where(F.col("part").isin(parts) if parts else F.lit(False))
        place = (F.col("before") + F.col("_at") + 1).cast("long")
        # at most as many index rows as the page has rows
        return (stored.join(F.broadcast(before), F.col("_folder") == F.col("part"))
                .withColumn(out, place).where(F.col(out).between(lo, hi)).select(*self.columns, out))

    def page(self, page_number: int, page_size: int, out: str = "s_no") -> DataFrame:
        """One page, 1-based."""
        if page_size <= 0 or page_number <= 0:
            raise ValueError("page_number and page_size must be positive")
        return self.rows((page_number - 1) * page_size + 1, page_number * page_size, out)

    def count(self) -> int:
        return self.index().agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def store(df: DataFrame, order_by: Sequence[str] | str, path: str | None = None) -> PageStore:
    """Write ``df`` in ascending ``order_by`` (give a unique last key for a total order)."""
    spark = df.sparkSession
    path = path or scratch_dir(spark, "pages")
    keys = [order_by] if isinstance(order_by, str) else list(order_by)
    place = F.monotonically_increasing_id()
    (df.withColumn("_tie", row_hash(df)).repartitionByRange(*keys, "_tie")
     .sortWithinPartitions(*keys, "_tie").drop("_tie").withColumn("_id", place)
     .withColumn("_folder", F.shiftright("_id", 33))
     .withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).drop("_id")
     .write.partitionBy("_folder").parquet(f"{path}/rows"))
    written = spark.read.parquet(f"{path}/rows") if not _is_empty(spark, f"{path}/rows") else None
    if written is None:
        # an empty table has no folder: one empty file gives it a schema
        df.limit(0).withColumn("_at", F.lit(0).cast("long")).write.parquet(f"{path}/rows/_folder=0")
        written = spark.read.parquet(f"{path}/rows")
    sizes = written.groupBy(F.col("_folder").cast("long").alias("part")).agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)     # a row per folder
    (sizes.select("part", "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).cast("long").alias("before"))
     .coalesce(1).write.parquet(f"{path}/index"))
    return PageStore(spark, path, tuple(df.columns))


def _is_empty(spark: SparkSession, path: str) -> bool:
    """Whether a partitioned write left no folder (there was no row)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_folder=*")
    return len(p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p) or []) == 0
