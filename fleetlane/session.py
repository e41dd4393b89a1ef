"""Session setup shared by jobs, tests and the bench.

Only runtime-settable SQL confs are touched on a session we did not build,
so a caller's cluster settings win.  ``spark.checkpoint.dir`` is read from
the session and only filled in when the cluster left it unset (tests,
local runs).
"""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Confs every job relies on; all are runtime-settable.
_RUNTIME_CONFS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # map-side top-k before the shuffle for "row_number() <= k" filters
    "spark.sql.optimizer.windowGroupLimitThreshold": "1000",
}


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "fleetlane") -> SparkSession:
    """Session for local runs and tests (the cluster passes its own)."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("FLEETLANE_DRIVER_MEM", "16g"))
          .config("spark.sql.execution.arrow.pyspark.enabled", "true")
          # checkpoint files go when nothing refers to them any more
          .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
          .config("spark.sql.files.maxPartitionBytes", str(128 * 1024 * 1024)))
    for k, v in _RUNTIME_CONFS.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime confs the jobs need to any session (idempotent)
    and make the package importable by the Python workers."""
    for k, v in _RUNTIME_CONFS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    checkpoint_root(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Add this package to the session's Python files (once per app), so
    executors can import it for the Arrow-batched Python steps - what
    ``--py-files`` does on spark-submit.  The zip is placed under the
    shared checkpoint root and added from there."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    staging = tempfile.mkdtemp(prefix="fleetlane-pkg-")
    local_zip = os.path.join(staging, "fleetlane.zip")
    with zipfile.ZipFile(local_zip, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    jvm = sc._jvm
    dst = jvm.org.apache.hadoop.fs.Path(scratch_path(spark, "pkg") + "/fleetlane.zip")
    fs = dst.getFileSystem(sc._jsc.hadoopConfiguration())
    fs.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(local_zip), dst)
    sc.addPyFile(dst.toString())
    _SHIPPED.add(sc.applicationId)


def checkpoint_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints, stream state and staged tables.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) path;
    one is invented only on a local master; elsewhere an unset one is an
    error.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="fleetlane-ckpt-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint root."""
    return f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def input_bytes(spark: SparkSession, paths) -> int:
    """Total size of files under ``paths`` (file-system metadata only)."""
    jvm = spark.sparkContext._jvm
    hconf = spark.sparkContext._jsc.hadoopConfiguration()
    total = 0
    for p in ([paths] if isinstance(paths, str) else paths):
        path = jvm.org.apache.hadoop.fs.Path(p)
        fs = path.getFileSystem(hconf)
        for st in fs.globStatus(path) or []:
            total += fs.getContentSummary(st.getPath()).getLength()
    return total


def size_for_input(spark: SparkSession, paths, bytes_per_partition: int = 256 * 1024 ** 2,
                   lo: int = 8) -> int:
    """Set ``spark.sql.shuffle.partitions`` from the input size, unless the
    cluster set it: a shuffle partition then holds about
    ``bytes_per_partition`` of input before compression, which keeps
    per-task sort/aggregate state within executor memory; AQE coalesces
    small ones to its advisory size (``parallelismFirst`` off)."""
    n = max(lo, -(-input_bytes(spark, paths) // bytes_per_partition))
    if not spark.sparkContext.getConf().contains("spark.sql.shuffle.partitions"):
        spark.conf.set("spark.sql.shuffle.partitions", str(n))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.parallelismFirst", "false")
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
