"""Session construction and shared scratch locations."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

# Settings every job here relies on: UTC session zone (driver timestamps are
# zone-less), AQE for runtime coalescing and skew-join splitting, no web UI.
BASE_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


# Applied on a cluster only where the cluster has not set them: start shuffles
# wide and let AQE coalesce to ~256 MB partitions; split skewed partitions.
SCALE_DEFAULTS = {
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "16384",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "256m",
    "spark.sql.files.maxPartitionBytes": "256m",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "512m",
}


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "sparkdesk") -> SparkSession:
    """Return (or create) a session with the settings above.

    On a cluster ``master`` stays None and the launcher decides; tests pass
    ``local[*]``.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for k, v in BASE_CONF.items():
        builder = builder.config(k, v)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if master and master.startswith("local"):
        builder = builder.config("spark.driver.memory", "16g")
        # local runs keep catalog tables out of the working directory
        builder = builder.config("spark.sql.warehouse.dir", tempfile.mkdtemp(prefix="sparkdesk-wh-"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.master.startswith("local"):
        for k, v in SCALE_DEFAULTS.items():
            if spark.conf.get(k, None) in (None, ""):
                spark.conf.set(k, v)
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by ``spark.checkpoint.dir``.

    The cluster names it; only when it is unset in local mode (tests) do we
    create one of our own.
    """
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not d:
        d = tempfile.mkdtemp(prefix="sparkdesk-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(d)
    return d


def scratch_dir(spark: SparkSession, name: str = "scratch") -> str:
    """A fresh sub-folder of the shared checkpoint folder for written tables."""
    base = ensure_checkpoint_dir(spark)
    path = f"{base.rstrip('/')}/sparkdesk-{name}-{uuid.uuid4().hex[:12]}"
    if "://" not in path:
        os.makedirs(path, exist_ok=True)
    # removed when the application ends
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(p)
    return path


def materialize(df):
    """Cut lineage: write ``df`` once as Parquet in the shared checkpoint folder
    and read it back.

    Used before operators that read the same derived input several times.
    The written table survives executor loss (unlike a local checkpoint or a
    cache), and unlike an eager RDD checkpoint the input is computed once.
    """
    path = scratch_dir(df.sparkSession, "table") + "/data"
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df):
    """Give CPU-heavy per-row work (regexes, chunking, Python batches) every
    core when the input arrives in fewer splits than the cluster has slots
    (e.g. one large Parquet row group).  Inputs already split at least that
    finely, as at scale, pass through untouched: no extra shuffle.

    Only exchange-free plans (scans, projections, filters) are inspected:
    counting the partitions of a plan with a shuffle would make adaptive
    execution run that shuffle early, and its partitioning is already the
    shuffle's.
    """
    plan = df._jdf.queryExecution().executedPlan().toString()   # planned, not run
    if "Exchange" in plan or "AdaptiveSparkPlan" in plan:
        return df
    target = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < target:
        return df.repartition(target)
    return df
