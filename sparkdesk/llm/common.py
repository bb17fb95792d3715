"""Helpers shared by the operators of this package."""

from __future__ import annotations

import os
import re

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from sparkdesk.session import materialize

PACKAGE_ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
BLOCK = 1 << 20                   # bytes of text whose words are held at once
BLANK = re.compile(rb"[ \t-\r]")  # the blanks bytes.split() cuts at
ARROW_BATCH_BYTES = 8 << 20      # one Arrow batch of texts handed to Python


def bounded_batches(spark: SparkSession) -> None:
    """Ready the session for Python tasks: small Arrow batches whatever the length of the
    texts (a smaller limit set by the user stays), and this package on the workers' path
    (where it is not installed, as in a checkout)."""
    env = spark.sparkContext.environment
    if PACKAGE_ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join([PACKAGE_ROOT, *filter(None, [env.get("PYTHONPATH")])])
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(rows, "10000")) > 2000:
        spark.conf.set(rows, "2000")
    size = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(size, str(2 ** 31 - 1))) > ARROW_BATCH_BYTES:
        spark.conf.set(size, str(ARROW_BATCH_BYTES))


def id_and_bytes(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, body)``: the key and the UTF-8 bytes of the text (null stays null)."""
    return df.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("body"))


def word_blocks(data: bytes):
    """Lists of the words of a text, ASCII letters in lower case, cut at ASCII blanks; at
    most about two BLOCKs of bytes are split at a time."""
    pos = 0
    while pos < len(data):
        hit = BLANK.search(data, pos + BLOCK) if len(data) - pos > 2 * BLOCK else None
        end = hit.end() if hit else len(data)
        yield data[pos:end].lower().split()
        pos = end


def free_name(df: DataFrame, base: str) -> str:
    """A column name that ``df`` does not use yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    name = base
    while name.lower() in taken:
        name += "_"
    return name


def free_names(df: DataFrame, bases: list[str], taken: list[str] = ()) -> list[str]:
    """Different column names that neither ``df`` nor ``taken`` uses."""
    used, names = {c.lower() for c in [*df.columns, *taken]}, []
    for name in bases:
        while name.lower() in used:
            name += "_"
        used.add(name.lower())
        names.append(name)
    return names


def crc_bucket(id_col: Column | str, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo ``modulus``; null for a null key."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(c.cast("string").cast("binary")) % modulus


def connected_components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node on a link, ``root`` the smallest node reachable.

    ``links`` has two long columns ``a`` and ``b``.  Alternating large-star
    and small-star rounds: each hangs a node's neighbours on the smallest one,
    so chains shorten geometrically and hubs never become pairs of leaves.
    Every round is one aggregate with map-side combine, one equi-join and a
    distinct, written to the shared checkpoint folder; the driver sees only a
    count and a checksum.
    """
    edges = materialize(links.where("a <> b")
                        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                        .distinct())
    state = None
    while True:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (both.join(low, "a").where("b > a")
                 .select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a")
        edges = materialize(
            small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .union(small.select("a", F.col("m").alias("b"))).distinct())
        row = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(row) == state:
            break
        state = tuple(row)
    roots = edges.select("b").distinct()
    return (edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            .union(roots.select(F.col("b").alias("node"), F.col("b").alias("root"))))
