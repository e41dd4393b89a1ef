"""Helpers shared by the operators: sessions, folds, hashes,
fixed-size Bloom bitmaps and connected components."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlane import session

# Rows of one Arrow batch handed to Python: bounds a task's memory with
# very long texts (a batch is also cut by bytes by Spark itself).
BATCH_ROWS = 1000


def prepare(spark: SparkSession) -> SparkSession:
    """Session confs of the library plus the Arrow batch size used here."""
    session.prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint root."""
    return session.scratch_path(spark, name)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """scratch_path(), made."""
    path = scratch_path(spark, name)
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)
    return path


def fold(id_col: str | Column, n: int = 5) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % n


_MUL = np.uint64(0x9E3779B97F4A7C15)


def mix64(x: np.ndarray) -> np.ndarray:
    """Multiply-xorshift finaliser on uint64 arrays."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of k consecutive word hashes, in order;
    fewer than k words give one hash of the whole sequence, none gives
    none."""
    n = len(h)
    if n == 0:
        return h
    k = min(k, n)
    acc = h[: n - k + 1] + np.uint64(k)
    for j in range(1, k):
        acc = mix64(acc) * _MUL + h[j: n - k + 1 + j]
    return mix64(acc)


# ---- fixed-size Bloom bitmap -------------------------------------------

BLOOM_LOG2 = 25  # 2^25 bits = 4 MB, whatever the number of keys


def bloom_bitmap(spark: SparkSession, keys: DataFrame, col: str):
    """Broadcast Bloom bitmap (two probes) over a BIGINT column of already
    mixed 64-bit keys.  Its size is fixed, so it can always be sent; with
    very many keys it only lets more rows pass, never fewer."""
    mask = (1 << BLOOM_LOG2) - 1
    k = F.col(col).cast("bigint")
    probes = F.array(k.bitwiseAND(F.lit(mask)),
                     F.shiftrightunsigned(k, 64 - BLOOM_LOG2))
    p = keys.select(F.explode(probes).alias("p"))
    words = (p.groupBy((F.shiftright("p", 6)).alias("w"))
              .agg(F.bit_or(F.expr("shiftleft(1L, cast(p & 63 as int))")).alias("b"))
              .collect())  # at most 2^(BLOOM_LOG2 - 6) rows
    bits = np.zeros(1 << (BLOOM_LOG2 - 6), np.uint64)
    for w, b in words:
        bits[w] = np.uint64(b & 0xFFFFFFFFFFFFFFFF)
    return spark.sparkContext.broadcast(bits)


def bloom_test(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which uint64 keys may be in the bitmap."""
    a = keys & np.uint64((1 << BLOOM_LOG2) - 1)
    b = keys >> np.uint64(64 - BLOOM_LOG2)
    one, s6, m63 = np.uint64(1), np.uint64(6), np.uint64(63)
    return (((bits[a >> s6] >> (a & m63)) & (bits[b >> s6] >> (b & m63))) & one).astype(bool)


def mixed_id(col: str | Column) -> Column:
    """64-bit mix of an id, usable as a Bloom key (NULL stays NULL)."""
    c = F.col(col) if isinstance(col, str) else col
    return F.when(c.isNotNull(), F.xxhash64(c))


# ---- connected components ----------------------------------------------

TASK_LINKS = 50_000

def connected_components(edges: DataFrame) -> DataFrame:
    """(a, b) links of BIGINT vertices -> (node, comp), comp = smallest
    vertex reachable.  Each round takes the least label of a vertex's
    neighbours (partial aggregation, so a hub is pre-aggregated) and then
    jumps to its label's label; rounds grow with the logarithm of the
    longest chain.  Labels are cut from their lineage by checkpoint()."""
    both = (edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
                 .where(F.col("a") != F.col("b")).distinct().checkpoint())
    # a task for every so many links: few links make few tasks and files
    tasks = 1 + both.count() // TASK_LINKS
    both = both.coalesce(tasks)
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
    labels = labels.select("node", F.least("node", "m").alias("comp")).coalesce(tasks).checkpoint()
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").coalesce(tasks)
        said = (near.select(F.col("a").alias("node"), "comp", F.lit(None).cast("bigint").alias("old"))
                    .unionAll(labels.select("node", "comp", F.col("comp").alias("old"))))
        hook = said.groupBy("node").agg(F.min("comp").alias("comp"), F.max("old").alias("old")).coalesce(tasks)
        up = hook.select(F.col("node").alias("comp"), F.col("comp").alias("up"))
        new = (hook.join(up, "comp", "left")
                   .select("node", "old", F.least("comp", F.coalesce("up", "comp")).alias("comp"))
                   .coalesce(tasks).checkpoint())
        if new.where("old != comp").limit(1).count() == 0:
            return new.select("node", "comp")
        labels = new.select("node", "comp")


# ---- written tables ------------------------------------------------------

def saved(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet below the shared checkpoint root and read
    again: cuts the lineage like checkpoint(), but compressed and by
    column."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files of a saved() table that is no longer read."""
    spark = df.sparkSession
    root = session.checkpoint_root(spark)
    for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        if p.toUri().getPath().startswith(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root).toUri().getPath()):
            p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
