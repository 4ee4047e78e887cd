"""Session helper: the few settings every job here relies on."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def importable_on_workers(query: Callable[[SparkSession, str], DataFrame]):
    """``query`` with this package's folder on the Python workers' path.

    For runs from a checkout on one machine; on a cluster install the package
    (``pyproject.toml``) or pass it with ``--py-files``.
    """
    @functools.wraps(query)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
        return query(spark, sf_dir)
    return run


def get_session(master: str | None = None, shuffle_partitions: int | None = None,
                app_name: str = "seatplan") -> SparkSession:
    """Build (or reuse) a session with UTC time, AQE and the UI off.

    On a cluster pass ``master=None`` and let the launcher decide; size
    ``shuffle_partitions`` to the data (AQE coalesces small partitions and
    splits skewed ones at run time).
    """
    b = SparkSession.builder.appName(app_name)
    if master:
        b = b.master(master)
    b = (b.config("spark.ui.enabled", "false")
         .config("spark.ui.showConsoleProgress", "false")
         .config("spark.sql.session.timeZone", "UTC")
         .config("spark.sql.adaptive.enabled", "true")
         .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
         .config("spark.sql.adaptive.skewJoin.enabled", "true")
         .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = b.getOrCreate()
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    from seatplan.plans.lineage import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    return spark
