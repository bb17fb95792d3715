"""Write side of a contacts table as snapshot transforms.

Plain Parquet has no UPDATE/DELETE/MERGE, so each operation returns the next
snapshot as a DataFrame; ``write_snapshot`` stores it in a new version
folder and never overwrites its own input.  ``log_changes`` stores edits and
deletes of few keys beside the newest snapshot instead; readers merge them in
and ``commit`` or ``compact`` takes them into the next snapshot.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampNTZType

from sparkdesk.operators import numbering
from sparkdesk.operators.facets import fields_present, require_fields
from sparkdesk.operators.joins import join_skipping_null_keys

CONTACT_SCHEMA = StructType([
    StructField("id", LongType(), False),
    StructField("name", StringType(), True),
    StructField("phone", StringType(), True),
    StructField("city", StringType(), True),
    StructField("created_at", TimestampNTZType(), True),
])
FIELDS = ["name", "phone", "city"]


def _ts(run_ts) -> Column:
    if run_ts is None:
        return F.current_timestamp().cast("timestamp_ntz")
    return run_ts if isinstance(run_ts, Column) else F.lit(run_ts).cast("timestamp_ntz")


def _mark(existing: DataFrame, id_mark, key: str) -> Column:
    """High-water mark for new ids: stored mark if given, else max(id) or 0."""
    if id_mark is not None:
        return F.lit(int(id_mark)).cast("long") if not isinstance(id_mark, Column) else id_mark
    return F.coalesce(existing.agg(F.max(key).cast("long")).scalar(), F.lit(0).cast("long"))


# K3: append rows with generated ids and a timestamp
def append_rows(existing: DataFrame, new: DataFrame, order_by: str | list[str],
                key: str = "id", id_mark=None, run_ts=None, ts_col: str = "created_at") -> DataFrame:
    numbered = numbering.number_rows(new, order_by, out="_k")
    added = numbered.select((_mark(existing, id_mark, key) + F.col("_k")).alias(key),
                            *[F.col(c) for c in FIELDS], _ts(run_ts).alias(ts_col))
    return existing.select(key, *FIELDS, ts_col).unionByName(added)


# Upload rows whose (name, phone-as-string) is not in the snapshot taken
# before the import; repeats inside the upload are all kept, null keys never match
def unseen_rows(existing: DataFrame, upload: DataFrame) -> DataFrame:
    up = upload.withColumn("phone", F.col("phone").cast("string"))
    keys = existing.select("name", F.col("phone").cast("string").alias("phone"))
    return join_skipping_null_keys(up, keys, ["name", "phone"], "left_anti")


# K7 + J1: bulk import without duplicates (second app) or with them (dedup=False)
def import_rows(existing: DataFrame, upload: DataFrame, order_by: str | list[str] = "upload_pos",
                dedup: bool = True, validate: bool = False, id_mark=None, run_ts=None) -> DataFrame:
    up = upload.withColumn("phone", F.col("phone").cast("string"))
    if validate:
        up, _ = require_fields(up, FIELDS)
    new = unseen_rows(existing, up) if dedup else up
    return append_rows(existing, new, order_by, id_mark=id_mark, run_ts=run_ts)


# Per upload row status: invalid / duplicate / inserted
def import_report(existing: DataFrame, upload: DataFrame, validate: bool = True) -> DataFrame:
    up = upload.withColumn("phone", F.col("phone").cast("string"))
    keys = (existing.select("name", F.col("phone").cast("string").alias("phone")).distinct()
            .withColumn("_known", F.lit(True)))
    ok = fields_present(FIELDS) if validate else F.lit(True)
    status = F.when(~ok, "invalid").when(F.col("_known"), "duplicate").otherwise("inserted")
    return (join_skipping_null_keys(up, keys, ["name", "phone"], "left")
            .select(*up.columns, status.alias("status")))


# K4 + J5: keyed update of name/phone/city; last seq per key wins; an edit to
# null sticks; an edit without a seq comes before all others; unmatched or null keys change nothing; created_at kept
def update_rows(existing: DataFrame, edits: DataFrame, key: str = "id", seq: str = "seq") -> DataFrame:
    latest = (edits.where(F.col(key).isNotNull()).groupBy(key)
              .agg(F.max_by(F.struct(*[F.col(c) for c in FIELDS]), F.struct(F.col(seq).isNotNull(), seq)).alias("_e")))
    hit = F.col("_e").isNotNull()
    cols = [F.when(hit, F.col(f"_e.{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c)
            for c in existing.columns]
    return existing.join(latest, key, "left").select(*cols)


# K5 + J6: delete by key set
def delete_rows(existing: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return existing.join(keys.select(key).where(F.col(key).isNotNull()), key, "left_anti")


# K6: null timestamps become the run time
def backfill_timestamps(existing: DataFrame, ts_col: str = "created_at", run_ts=None) -> DataFrame:
    return existing.withColumn(ts_col, F.coalesce(F.col(ts_col), _ts(run_ts)))


def write_snapshot(df: DataFrame, base: str, version: int) -> str:
    """Store a snapshot as ``base/v=<version>``; refuses to overwrite."""
    path = f"{base.rstrip('/')}/v={int(version)}"
    df.write.mode("errorifexists").parquet(path)
    return path


def snapshot_versions(spark, base: str) -> list[int]:
    """Versions present under ``base`` (folder names ``v=<n>``), ascending."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if st.isDirectory() and name.startswith("v=") and name[2:].isdigit():
            if fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                out.append(int(name[2:]))
    return sorted(out)


def read_snapshot(spark, base: str, schema=CONTACT_SCHEMA) -> tuple[DataFrame, int]:
    """The newest complete snapshot and its version (an empty table, 0 if none)."""
    versions = snapshot_versions(spark, base)
    if not versions:
        return spark.createDataFrame([], schema), 0
    return spark.read.parquet(f"{base.rstrip('/')}/v={versions[-1]}"), versions[-1]


def _change_base(base: str, version: int) -> str:
    return f"{base.rstrip('/')}/changes/after={version}"


# K4 + K5 on a stored table: only the changed keys are written, as one more folder of changes
# to the newest snapshot
def log_changes(spark, base: str, edits: DataFrame | None = None, deletes: DataFrame | None = None,
                key: str = "id", seq: str = "seq") -> str:
    """Store edits and deletes beside the newest snapshot without rewriting it.  A batch holds a
    row per changed key (the last edit by ``seq``, and whether the key goes); rows without a key
    change nothing.  One writer at a time, as for ``commit``."""
    if edits is None and deletes is None:
        raise ValueError("need edits or deletes")
    snapshot, version = read_snapshot(spark, base)
    key_type = snapshot.schema[key].dataType
    values = [F.col(c).cast(snapshot.schema[c].dataType).alias(c) for c in FIELDS]
    none = F.lit(None).cast(StructType([snapshot.schema[c] for c in FIELDS]))
    parts = []
    if edits is not None:
        parts.append(edits.select(F.col(key).cast(key_type).alias(key), F.col(seq).cast("long").alias("_seq"),
                                  F.struct(*values).alias("_values"), F.lit(False).alias("_gone")))
    if deletes is not None:
        parts.append(deletes.select(F.col(key).cast(key_type).alias(key), F.lit(None).cast("long").alias("_seq"),
                                    none.alias("_values"), F.lit(True).alias("_gone")))
    rows = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    batch = rows.where(F.col(key).isNotNull()).groupBy(key).agg(*_net(F.col("_seq")))
    folder = _change_base(base, version)
    return write_snapshot(batch, folder, max(snapshot_versions(spark, folder), default=0) + 1)


def _net(order: Column) -> list[Column]:
    """What the changes of a key come to: its last edit (one without an order before all others)
    and whether it goes.  A key that goes stays away: keys are never given out again."""
    edit = F.col("_values").isNotNull()
    return [F.max_by("_values", F.when(edit, F.struct(order.isNotNull(), order))).alias("_values"),
            F.bool_or("_gone").alias("_gone")]


def pending_changes(spark, base: str, version: int, key: str = "id") -> DataFrame | None:
    """``(key, _values, _gone)`` of the complete change folders after snapshot ``version``."""
    folder = _change_base(base, version)
    batches = snapshot_versions(spark, folder)
    if not batches:
        return None
    rows = spark.read.option("basePath", folder).parquet(*[f"{folder}/v={b}" for b in batches])
    return rows.groupBy(key).agg(*_net(F.col("v").cast("long")))


def apply_changes(snapshot: DataFrame, changes: DataFrame, key: str = "id") -> DataFrame:
    """A snapshot with its changes merged in.  Changes are small against the table, so adaptive
    execution joins them without moving the snapshot's rows; larger ones are a sort-merge join."""
    hit = F.col("_values").isNotNull()
    cols = [F.when(hit, F.col(f"_values.{c}")).otherwise(F.col(c)).alias(c) if c in FIELDS else F.col(c)
            for c in snapshot.columns]
    return (snapshot.join(changes, key, "left").where(~F.coalesce("_gone", F.lit(False))).select(*cols))


def read_latest(spark, base: str, schema=CONTACT_SCHEMA, key: str = "id") -> tuple[DataFrame, int]:
    """The table as it is now (newest complete snapshot and the changes after it) and the
    snapshot's version (an empty table, 0 if none)."""
    snapshot, version = read_snapshot(spark, base, schema)
    changes = pending_changes(spark, base, version, key)
    return (snapshot if changes is None else apply_changes(snapshot, changes, key)), version


def compact(spark, base: str, key: str = "id") -> str:
    """Write snapshot and changes as the next snapshot, which starts without changes."""
    return commit(spark, base, lambda current: current, key)


def id_mark(spark, base: str, key: str = "id") -> int:
    """Highest id ever given out under ``base``: the stored marks and the newest snapshot
    (which covers a snapshot whose mark was not written any more)."""
    snapshot, _ = read_snapshot(spark, base)        # with the rows that pending changes delete
    path = f"{base.rstrip('/')}/marks"
    top = snapshot.agg(F.coalesce(F.max(key), F.lit(0)).cast("long").alias("mark"))
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        top = top.unionByName(spark.read.schema("mark long").parquet(path))
    return top.agg(F.max("mark")).first()[0]


def commit(spark, base: str, change, key: str = "id") -> str:
    """Apply ``change`` (snapshot -> snapshot) to the newest version and write
    the result as the next version; the input version stays untouched.  The
    highest id so far is stored beside it, so deleted ids are not given out again."""
    current, v = read_latest(spark, base, key=key)
    mark = id_mark(spark, base, key)
    path = write_snapshot(change(current), base, v + 1)
    (spark.read.parquet(path).agg(F.greatest(F.max(key).cast("long"), F.lit(mark)).alias("mark"))
     .write.mode("append").parquet(f"{base.rstrip('/')}/marks"))
    return path


def commit_import(spark, base: str, upload: DataFrame, order_by: str | list[str] = "upload_pos", **kw) -> str:
    """``import_rows`` on the newest snapshot, with ids after the stored mark."""
    mark = id_mark(spark, base)
    return commit(spark, base, lambda cur: import_rows(cur, upload, order_by, id_mark=mark, **kw))
