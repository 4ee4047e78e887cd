"""Cutting lineage on shared storage.

A job that feeds one intermediate result to several sinks (new table state,
audit rows, messages) checkpoints it once, so a lost executor re-reads the
checkpoint instead of recomputing the whole upstream plan.  The directory is
the context's checkpoint directory, else the session's ``spark.checkpoint.dir``.
Only a local master may run without either: it gets one temporary folder per
driver process.
"""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="seatplan-ckpt-")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for checkpoints: the context's, else the session
    setting's; a local master without one gets a temporary folder, any other
    master raises."""
    sc = spark.sparkContext
    in_context = sc.getCheckpointDir()
    if in_context:
        return in_context
    path = spark.conf.get("spark.checkpoint.dir", None) or \
        sc.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local_dir()
    sc.setCheckpointDir(path)
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint (never a local one): survives executor loss.

    A checkpoint keeps the size that Spark estimated for its plan.  A join's is
    the product of its sides', so over the rounds of a loop it becomes a number
    of millions of digits, and planning takes longer than running.  An estimate
    beyond 64 bits is dropped (with the partitioning, which such a checkpoint forgets).
    """
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    kept = df.checkpoint(eager=True)
    plan = kept._jdf.queryExecution()
    if int(plan.optimizedPlan().stats().sizeInBytes()).bit_length() <= 64:
        return kept
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(plan.toRdd(), kept._jdf.schema(), False), spark)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A folder under the shared checkpoint directory, deleted when the driver's JVM ends."""
    path = os.path.join(ensure_checkpoint_dir(spark), "tables", name)
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def written(df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again.

    Like :func:`materialize`, but columnar and compressed: for wide rows.
    """
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
