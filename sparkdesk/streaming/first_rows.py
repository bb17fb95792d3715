"""F9 over landings: the first row of every file name, counted once whatever the number of runs.

Each run lands the rows that came into the inbox since the last one (a stream
whose checkpoint remembers the files), reduces them to the first row of each
name by an aggregate with map-side combine, and keeps the names that no earlier
run has.  A run's result is a version folder written once; the run counts as
done when that folder is complete, so a run that broke off is done again with
the same number: the stream repeats its planned batch, and rows it had landed
before are still those of that number.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import IntegerType, StructType

from sparkdesk.operators.bills import first_per_key
from sparkdesk.operators.contacts import snapshot_versions


def first_rows(spark: SparkSession, base: str, schema: StructType) -> DataFrame:
    """The first row of every name landed so far."""
    done = snapshot_versions(spark, f"{base}/first")
    if not done:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{base}/first/v={v}" for v in done])


def land_first_rows(spark: SparkSession, inbox: str, schema: StructType, base: str, key: str = "file",
                    order_by: str = "pos") -> int:
    """One run over the Parquet files in ``inbox``; returns its number.  Rows without a name
    have none to be first of."""
    done = snapshot_versions(spark, f"{base}/first")
    run = done[-1] + 1 if done else 1
    rows = spark.readStream.schema(schema).parquet(inbox).withColumn("run", F.lit(run))
    q = (rows.writeStream.format("parquet").option("path", f"{base}/landed").partitionBy("run")
         .option("checkpointLocation", f"{base}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    landed = StructType([*schema.fields]).add("run", IntegerType())
    new = spark.read.schema(landed).parquet(f"{base}/landed").where((F.col("run") == run) & F.col(key).isNotNull())
    first = first_per_key(new.drop("run"), key, order_by).select(*[f.name for f in schema.fields])
    known = first_rows(spark, base, schema).select(key)
    first.join(known, key, "left_anti").select(*[f.name for f in schema.fields]).write.mode("overwrite").parquet(
        f"{base}/first/v={run}")
    return run
