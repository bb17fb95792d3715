"""ST1: incremental landing of CSV files dropped into an inbox folder.

Each run picks up the files not seen before (the checkpoint remembers them),
tags rows with their source file and appends them to a Parquet table.
``availableNow`` processes what is there and stops, so the same job serves a
scheduled re-run (as the original script was run by hand) or a long-lived
stream.
"""

from __future__ import annotations

from pyspark.sql import SparkSession, functions as F
from pyspark.sql.types import StructType

from sparkdesk.sources.files import QUOTING


def land_csv(spark: SparkSession, inbox: str, schema: StructType | str, table_path: str,
             checkpoint: str, source_col: str = "source_file", timeout_s: float | None = None,
             multiline: bool = False) -> int:
    """Run one ``availableNow`` pass to its end (or, if given, for ``timeout_s`` seconds at
    most); returns the number of micro-batches.  Files are read as ``files.write_csv`` writes
    them; line breaks inside fields need ``multiline``."""
    stream = (spark.readStream.schema(schema).option("header", True).options(**QUOTING)
              .option("multiLine", multiline).csv(inbox)
              .withColumn(source_col, F.col("_metadata.file_name")))
    q = (stream.writeStream.format("parquet").option("path", table_path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    first = q.lastProgress["batchId"] if q.lastProgress else None
    if timeout_s is None:
        q.awaitTermination()
    elif not q.awaitTermination(timeout_s):
        q.stop()
        raise TimeoutError("landing did not finish")
    if q.exception() is not None:
        raise q.exception()
    if not q.lastProgress:
        return 0
    # progress is kept for the last batches only; their ids count all of them
    first = q.recentProgress[0]["batchId"] if first is None else first
    return q.lastProgress["batchId"] - first + 1
