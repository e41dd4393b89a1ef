"""Uniform random shards of exact sizes.

The matrix of how many rows each input partition sends to each shard is
drawn exactly: partition after partition takes a multivariate
hypergeometric draw from the places the shards have left.  A partition's
rows, in random order (a seeded hash of the row), are then dealt out by its
line of the matrix, exchanged, and put in random order again inside the
shard.  Every assignment of rows to shards of those sizes is equally
likely, and shard sizes differ by one row at most.

The rows' partitions are written to the shared checkpoint folder first, so
later tasks see the same partitions whatever executors are lost.  Order
inside a shard is kept by sub-shards of about ``slice_rows`` rows, so no
task sorts a whole shard.

Edge cases: null ids and repeated rows count as rows like any other; a null
text has no bytes (size 16, crc32 0); fewer rows than shards leave shards
empty; an empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class ShardParams:
    shards: int = 40
    seed: int = 17
    slice_rows: int = 100_000


def hypergeometric(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Good ones among n drawn; numpy's sampler up to its limit of 10^9,
    ratio of uniforms around the mode beyond."""
    if good + bad < 1_000_000_000:
        return int(rng.hypergeometric(good, bad, n))
    lo, hi = max(0, n - bad), min(n, good)
    if lo == hi:
        return lo
    total = good + bad
    mode = min(hi, max(lo, (n + 1) * (good + 1) // (total + 2)))

    def logp(k: int) -> float:
        return -sum(math.lgamma(x + 1) for x in (k, good - k, n - k, bad - n + k))

    mean = n * good / total
    sd = math.sqrt(mean * (bad / total) * (total - n) / (total - 1) + 0.5)
    top = logp(mode)
    while True:
        u, v = 1.0 - rng.random(), (2 * rng.random() - 1) * 2.0  # box holds the region: width 2 sd
        k = math.floor(mean + 0.5 + sd * v / u)
        if lo <= k <= hi and 2 * math.log(u) <= logp(k) - top:
            return k


def communication_matrix(rows: list[int], shards: int, seed: int) -> np.ndarray:
    """Exact counts (partitions x shards) with the given row sums and
    column sums that differ by one at most."""
    rng = np.random.default_rng(seed)
    n = sum(rows)
    free = [n // shards + (s < n % shards) for s in range(shards)]
    out = np.zeros((len(rows), shards), np.int64)
    for r, take in enumerate(rows):
        rest = sum(free)
        for s in range(shards):
            rest -= free[s]
            k = hypergeometric(rng, free[s], rest, take) if take else 0
            out[r, s] = k
            take -= k
        for s in range(shards):
            free[s] -= int(out[r, s])
    return out


def shard(df: DataFrame, params: ShardParams | None = None) -> DataFrame:
    """``df`` with its columns and ``shard``, ``slot`` (gapless from 0 in
    each shard), which replace columns of these names.  A row travels as one
    column, so no other name can clash."""
    p = params or ShardParams()
    spark, cols = df.sparkSession, [c for c in df.columns if c.lower() not in ("shard", "slot")]
    # a row without columns of its own is still a row
    tag = df.select(F.struct(*cols, F.lit(True).alias("__")).alias("row")).withColumns({"__part": F.spark_partition_id(), "__row": F.monotonically_increasing_id()}).checkpoint()
    sizes = sorted((r["__part"], r["n"]) for r in
                   tag.groupBy("__part").agg(F.count(F.lit(1)).alias("n")).collect())  # one row a partition
    matrix = communication_matrix([n for _, n in sizes], p.shards, p.seed)
    lines = spark.createDataFrame([(part, [int(x) for x in np.cumsum(m)]) for (part, _), m in zip(sizes, matrix)],
                                  "__part int, __upto array<bigint>")
    local = Window.partitionBy("__part").orderBy(F.xxhash64(F.lit(p.seed), "__row"), "__row")
    dealt = (tag.withColumn("__rank", F.row_number().over(local)).join(lines, "__part")
                .withColumn("shard", F.size(F.filter("__upto", lambda c: c < F.col("__rank"))))
                .withColumn("__key", F.xxhash64(F.lit(p.seed + 1), "__row"))
                .drop("__rank", "__upto"))
    n = sum(n for _, n in sizes)
    parts = max(1, -(-n // (p.shards * p.slice_rows)))
    dealt = dealt.withColumn("__sub", F.pmod(F.xxhash64(F.lit(p.seed + 2), "__row"), F.lit(parts)).cast("int"))
    before = Window.partitionBy("shard").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (dealt.groupBy("shard", "__sub").agg(F.count(F.lit(1)).alias("__n"))
                    .withColumn("__off", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"))
    inside = Window.partitionBy("shard", "__sub").orderBy("__key", "__row")
    return (dealt.withColumn("__rn", F.row_number().over(inside)).join(offsets, ["shard", "__sub"])
                 .withColumn("slot", (F.col("__off") + F.col("__rn") - 1).cast("bigint"))
                 .select(*[F.col("row").getField(c).alias(c) for c in cols], "shard", "slot"))
