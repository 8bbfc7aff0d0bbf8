"""Session helpers: local test sessions and the shared scratch folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench (never used by library code)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("popweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder.

    The cluster names it in ``spark.checkpoint.dir``; we only set our own
    (a fresh temp folder) when nothing is configured and driver and executors
    are one process, as in tests (``local-cluster`` is not).
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not (sc.master == "local" or sc.master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a shared folder (machine-local temp dirs are not "
                               "visible to other executors)")
        configured = tempfile.mkdtemp(prefix="popweave-ckpt-")
        atexit.register(shutil.rmtree, configured, True)
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh, unique folder under the shared checkpoint dir for written tables.

    It is deleted when the driver's JVM ends.
    """
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/popweave-{name}-{uuid.uuid4().hex[:12]}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    files.mkdirs(folder)
    files.deleteOnExit(folder)
    files.delete(folder, False)  # the writer makes it; the registration stays
    return path


def stash(df: DataFrame, name: str) -> DataFrame:
    """Write a table of record scale as Parquet in the shared folder and read it back.

    Later reads are pruned to their columns, which a checkpoint's are not.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._popweave_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stash`` wrote, once nothing reads them any more; other tables are left alone.

    The driver's JVM also collects, for Spark's cleaner to remove the shuffle
    files of the steps that are done: they stay until their plans are collected.
    """
    for df in tables:
        path = getattr(df, "_popweave_path", None)
        if path:
            sc = df.sparkSession.sparkContext
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            files = folder.getFileSystem(sc._jsc.hadoopConfiguration())
            files.delete(folder, True)
            files.cancelDeleteOnExit(folder)
    if tables:
        tables[0].sparkSession.sparkContext._jvm.System.gc()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint of a small intermediate (e.g. a cell table).

    Written to the shared checkpoint folder, so downstream stages read a few
    files instead of re-running the record-level plan, and an executor loss
    does not recompute the lineage.  Never a machine-local checkpoint.
    """
    if getattr(df, "_popweave_materialized", False):
        return df
    ensure_checkpoint_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    out._popweave_materialized = True
    return out


def local_path(path: str) -> str:
    """Strip a ``file:`` scheme (for os-level checks in tests only)."""
    return path[5:] if path.startswith("file:") else path


__all__ = ["local_session", "ensure_checkpoint_dir", "scratch_path", "stash", "discard", "materialize", "local_path"]
