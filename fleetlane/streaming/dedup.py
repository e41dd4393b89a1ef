"""Duplicate completions collapse to the first (batch twin: O03).

No state grows with the stream.  What is known of an id is what was written
for it: firsts lie in a table partitioned by the day of the id's creation
(version-1 ids carry it), and a batch looks up its ids only in the days it
touches.  A completion comes soon after its task, so batches touch recent
days, whatever the length of the stream; one that comes a year late is
still compared with what was written a year ago.  The completion with the
smallest position wins in whatever order files come: a batch writes an id
again if it holds an earlier line of it, and readers take the smallest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from fleetlane.functions.ids import uuid_v1_time
from fleetlane.streaming.runner import exists, foreach_batch, run_foreach_batch


def creation_day(uuid: Column) -> Column:
    """Day (since 1970) in a version-1 id."""
    return F.unix_date(F.to_date(uuid_v1_time(uuid))).cast("bigint")


def batch_firsts(parsed: DataFrame) -> DataFrame:
    """(uuid, first_pos, path, day) of the valid ids of a batch; partial
    aggregation, so a hot id is folded on every task.  A line without a
    path has ''."""
    first = F.min(F.struct(F.col("pos").alias("first_pos"), F.coalesce("path", F.lit("")).alias("path")))
    return (parsed.groupBy("uuid").agg(first.alias("f"), F.max("valid").alias("v")).where("v")
                  .select("uuid", "f.first_pos", "f.path", creation_day(F.col("uuid")).alias("day")))


def _schema(parsed: DataFrame) -> StructType:
    return StructType([StructField("uuid", StringType()), StructField("first_pos", parsed.schema["pos"].dataType),
                       StructField("path", StringType()), StructField("day", LongType()), StructField("batch", LongType())])


def written(spark: SparkSession, out: str, schema: StructType, days: list[int], before: int) -> DataFrame:
    """What batches before ``before`` wrote for ids of some days: only the
    folders of these days are listed and read."""
    paths = [p for p in (f"{out}/day={d}" for d in days) if exists(spark, p)]
    if not paths:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("basePath", out).parquet(*paths).where(F.col("batch") < before)


def write_firsts(parsed: DataFrame, batch_id: int, out: str) -> None:
    """Write the ids of a batch that are new or come earlier than what was
    written.  A repeated batch replaces its own folders."""
    spark = parsed.sparkSession
    found = batch_firsts(parsed).checkpoint()
    days = [r[0] for r in found.select("day").distinct().collect()]  # one per day touched
    old = written(spark, out, _schema(parsed), days, batch_id)
    old = old.groupBy("uuid").agg(F.min(F.struct("first_pos", "path")).alias("old"))
    new = found.join(old, "uuid", "left").where("old is null or struct(first_pos, path) < old").drop("old")
    (new.withColumn("batch", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(out))


def read_firsts(rows: DataFrame) -> DataFrame:
    """(uuid, first_pos, path) of a table of written firsts."""
    best = rows.groupBy("uuid").agg(F.min(F.struct("first_pos", "path")).alias("f"))
    return best.select("uuid", "f.first_pos", F.nullif(F.col("f.path"), F.lit("")).alias("path"))


def first_completions_stream(spark: SparkSession, parsed: DataFrame, name: str) -> DataFrame:
    """(uuid, first_pos, path): the completion with the smallest position
    of every valid id, whatever order and micro-batches the lines come in."""
    return read_firsts(run_foreach_batch(spark, parsed, name, write_firsts, _schema(parsed)))


def follow_firsts(parsed: DataFrame, out: str, checkpoint: str):
    """Writer of a stream that keeps ``out`` up to date."""
    return foreach_batch(parsed, write_firsts, out, checkpoint)
