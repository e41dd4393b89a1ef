"""Running streams to completion and the end-of-stream marker.

The reference closes a measurement with an ``end`` marker; we do the same
for event-time streams: one marker row far in the future, in a source of
its own under the shared checkpoint folder, unioned into the stream.  It is
written only after the data was read to its end, so results do not depend
on the number of micro-batches.  Once it is read the watermark passes every
real row, and the closing (no-data) micro-batch emits every pending window
and timeout.  Jobs drop the marker rows from their output.

Sinks are exactly-once: the parquet file sink commits through its
``_spark_metadata`` log, ``foreachBatch`` sinks write one folder per batch
id (overwrite, so a retried batch replaces itself).  Checkpoints live in
the shared folder named by ``spark.checkpoint.dir``, so a restarted query
resumes after executor or driver loss.
"""

from __future__ import annotations

import datetime as _dt
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from fleetlane.session import scratch_path

END_TYPE = "__end__"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
END_TS = _dt.datetime(2100, 1, 1)


def file_stream(spark: SparkSession, path: str, schema: StructType,
                fmt: str = "parquet", max_files: int | None = None) -> DataFrame:
    """File source; a single file needs a glob path (``x.parquet*``)."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.load(path)


class EndMarker:
    """A source that stays empty until all data was read; run_append() and
    run_foreach_batch() then write its one row and run the query on, so the
    marker is the newest row however many micro-batches the data took."""

    def __init__(self, spark: SparkSession, schema: StructType, values: dict):
        self.spark, self.schema = spark, schema
        self.row = {f.name: values.get(f.name) for f in schema.fields}
        self.folder = scratch_path(spark, "end-marker")
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(p)

    def stream(self) -> DataFrame:
        return self.spark.readStream.schema(self.schema).parquet(self.folder)

    def write(self) -> None:
        self.spark.createDataFrame([self.row], self.schema).coalesce(1).write.mode("append").parquet(self.folder)


def with_end_marker(spark: SparkSession, stream: DataFrame, schema: StructType,
                    values: dict) -> tuple[DataFrame, EndMarker]:
    """Union the marker's source (``values`` + nulls) into ``stream``."""
    marker = EndMarker(spark, schema, values)
    return stream.unionByName(marker.stream()), marker


def append_end_marker(spark: SparkSession, folder: str, schema: StructType, values: dict) -> str:
    """Write the marker as the newest file of a file source's folder, for
    streams that read the folder on their own."""
    row = {f.name: values.get(f.name) for f in schema.fields}
    sub = scratch_path(spark, "end-marker-file")
    spark.createDataFrame([row], schema).coalesce(1).write.parquet(sub)
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    src_dir = jvm.org.apache.hadoop.fs.Path(sub)
    fs = src_dir.getFileSystem(hconf)
    part = [st.getPath() for st in fs.listStatus(src_dir) if st.getPath().getName().endswith(".parquet")][0]
    dst = jvm.org.apache.hadoop.fs.Path(folder.rstrip("/") + "/zz-end-marker.parquet")
    jvm.org.apache.hadoop.fs.FileUtil.copy(fs, part, dst.getFileSystem(hconf), dst, False, hconf)
    return dst.toString()


@contextmanager
def _confs(spark: SparkSession, confs: dict[str, str]):
    """Session confs for the time of a block."""
    old = {k: spark.conf.get(k, None) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_append(spark: SparkSession, sdf: DataFrame, name: str,
               watermark_policy: str | None = None, marker: EndMarker | None = None,
               rocksdb: bool = False, state_partitions: int | None = None) -> DataFrame:
    """Run an append-mode stream with availableNow into a parquet sink in
    the shared folder, and once more with the marker, if there is one;
    return the sink as a batch DataFrame.

    ``watermark_policy`` ('min'/'max') and the state store are fixed for the
    query at its first batch (they are stored in the checkpoint), so they
    are set only around ``start()``; ``rocksdb`` is what processors with
    several states and timers need.  ``state_partitions`` is for streams
    whose state is known to be small: each partition costs a store."""
    out = scratch_path(spark, f"{name}-out")
    confs = {}
    if watermark_policy:
        confs["spark.sql.streaming.multipleWatermarkPolicy"] = watermark_policy
    if state_partitions:
        confs["spark.sql.shuffle.partitions"] = str(state_partitions)
    if rocksdb:
        confs["spark.sql.streaming.stateStore.providerClass"] = ROCKSDB
    with _confs(spark, confs):
        _run(lambda: sdf.writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", out + "-ckpt")
             .trigger(availableNow=True).queryName(f"{name}_{out[-12:]}").start(), marker)
    return spark.read.schema(sdf.schema).parquet(out)


def _run(start, marker: EndMarker | None) -> None:
    """Read what there is to its end, then the marker."""
    for last in ([False, True] if marker else [False]):
        if last:
            marker.write()
        q = start()
        q.awaitTermination()
        if q.exception() is not None:
            raise RuntimeError(str(q.exception()))


def foreach_batch(sdf: DataFrame, fn, out: str, checkpoint: str, mode: str = "append"):
    """Writer that runs ``fn(batch_df, batch_id, out)`` per micro-batch."""
    return (sdf.writeStream.outputMode(mode).foreachBatch(lambda df, bid: fn(df, bid, out))
               .option("checkpointLocation", checkpoint))


def run_foreach_batch(spark: SparkSession, sdf: DataFrame, name: str, fn, schema: StructType | str,
                      mode: str = "append", marker: EndMarker | None = None) -> DataFrame:
    """Run ``fn(batch_df, batch_id, out_folder)`` per micro-batch with
    availableNow; ``fn`` writes below the folder, a batch's rows in a
    ``batch=<id>`` of their own.  Returns every batch's output as one
    DataFrame of ``schema``."""
    if isinstance(schema, str):
        schema = StructType.fromDDL(schema)
    out = scratch_path(spark, f"{name}-out")
    _run(lambda: foreach_batch(sdf, fn, out, out + "-ckpt", mode).trigger(availableNow=True).start(), marker)
    if not exists(spark, out):  # the stream had no data batch at all
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(out).select(*schema.names)


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.exists(p)


def drop_marker(df: DataFrame, type_col: str = "event_type") -> DataFrame:
    return df.where(F.col(type_col) != END_TYPE)
